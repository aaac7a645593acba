"""Consistency of annotated paths around a centre line."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .order import kept, ranked, running_medians
from .sampling import interpolate

#: A path whose largest residual reaches so many deviations is suspect.
SUSPECT = 12.0


def polar(paths: DataFrame, control: DataFrame) -> DataFrame:
    """paths with n (1..), r and the unwrapped angle, in (ts, event_id) order. A step of exactly half a turn is not corrected."""
    w = Window.partitionBy("collection").orderBy("ts", "event_id")
    d = interpolate(paths, control).withColumns({"r": F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")), "a": F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))})
    d = d.withColumns({"n": F.row_number().over(w), "dd": F.col("a") - F.lag("a").over(w)})
    m = F.pmod(F.col("dd") + math.pi, F.lit(2 * math.pi)) - math.pi
    m = F.when((m == -math.pi) & (F.col("dd") > 0), F.lit(math.pi)).otherwise(m)
    fix = F.when(F.abs("dd") < math.pi, 0.0).otherwise(F.coalesce(m - F.col("dd"), F.lit(0.0)))
    return d.withColumn("angle", F.col("a") + F.sum(fix).over(w)).drop("cx", "cy", "a", "dd")


def trend(points: DataFrame) -> DataFrame:
    """points with resid of r ~ 1 + angle + (z - mean z), by centred normal equations; minimum norm where they are singular (one regressor constant, or both). All moments are one mergeable aggregate, joined back once."""
    pair = lambda a, b: F.covar_pop(a, b) * F.count(F.lit(1))
    k = points.groupBy("collection").agg(F.avg("angle").alias("ma"), F.avg("z").alias("mz"), F.avg("r").alias("mr"), *[pair(a, b).alias(n) for n, a, b in (("aa", "angle", "angle"), ("zz", "z", "z"), ("az", "angle", "z"), ("ar", "angle", "r"), ("zr", "z", "r"))])
    det = F.col("aa") * F.col("zz") - F.col("az") * F.col("az")
    # Collinear: the minimum-norm direction is along (da, dz).
    flat = F.col("aa") + F.col("zz")
    full = det > 1e-9 * F.col("aa") * F.col("zz")
    slope = lambda one, two, x, y: F.when(full, (F.col(one) * F.col(x) - F.col(two) * F.col("az")) / det).otherwise(F.coalesce(F.try_divide(F.col(one), flat), F.lit(0.0))).alias(y)
    k = k.select("collection", "ma", "mz", "mr", slope("ar", "zr", "zz", "ca"), slope("zr", "ar", "aa", "cz"))
    c = points.join(k, "collection").withColumns({"da": F.col("angle") - F.col("ma"), "dz": F.col("z") - F.col("mz"), "dr": F.col("r") - F.col("mr")})
    return c.withColumn("resid", F.col("dr") - F.col("ca") * F.col("da") - F.col("cz") * F.col("dz"))


def spread(resid: DataFrame) -> DataFrame:
    """collection, n, mad (+1e-6), worst (largest residual in deviations), radius_med, verdict."""
    m = resid.groupBy("collection").agg(F.median("resid").alias("m"))
    d = resid.join(m, "collection").groupBy("collection").agg(F.count(F.lit(1)).alias("n"), (F.median(F.abs(F.col("resid") - F.col("m"))) + 1e-6).alias("mad"), F.max(F.abs("resid")).alias("top"), F.median("r").alias("radius_med"))
    d = d.withColumn("worst", F.col("top") / (1.4826 * F.col("mad")))
    return d.withColumn("verdict", F.when(F.col("worst") < SUSPECT, "CONSISTENT").otherwise("SUSPECT")).drop("top")


def step_ratio(points: DataFrame) -> DataFrame:
    """Largest over median step of r; 0 for fewer than four steps."""
    w = Window.partitionBy("collection").orderBy("n")
    d = points.withColumn("d", F.abs(F.col("r") - F.lag("r").over(w))).groupBy("collection").agg(F.count("d").alias("steps"), F.max("d").alias("top"), F.median("d").alias("mid"))
    return d.select("collection", F.when(F.col("steps") >= 4, F.col("top") / (F.col("mid") + 1e-6)).otherwise(0.0).alias("step_ratio"))


def changepoint(resid: DataFrame, spread_: DataFrame) -> DataFrame:
    """Largest difference of medians before and after a split, in deviations; 0 below eight points. Medians before a split run along the path, those after it along the path reversed."""
    size = kept(spread_.select("collection", F.col("n").cast("long").alias("size"), "mad"))
    long_ = size.where("size >= 8").select("collection", "size")
    d = ranked(resid.select("collection", F.col("n").cast("long").alias("n"), F.col("resid").alias("v")), "collection", ["v", "n"]).join(long_, "collection")
    # Both directions in one pass, as two paths.
    ways = F.explode(F.array(*[F.struct(F.lit(back).alias("back"), n.alias("n")) for back, n in ((False, F.col("n")), (True, F.col("size") + 1 - F.col("n")))]))
    paths = kept(d.withColumn("way", ways).select(F.struct("collection", "way.back").alias("key"), "way.n", "v", "rank"))
    got = running_medians(paths).select("key.*", "n", "median").join(long_, "collection")
    # Backwards, the median at size - k is that of the points after the split at k.
    split = F.when(F.col("back"), F.col("size") - F.col("n")).otherwise(F.col("n"))
    jumps = got.groupBy("collection", "size", split.alias("k")).agg(F.max(F.when(~F.col("back"), F.col("median"))).alias("before"), F.max(F.when(F.col("back"), F.col("median"))).alias("after"))
    top = jumps.where((F.col("k") >= 3) & (F.col("k") <= F.col("size") - 4)).groupBy("collection").agg(F.max(F.abs(F.col("after") - F.col("before"))).alias("jump"))
    return size.join(top, "collection", "left").select("collection", F.coalesce(F.col("jump") / (1.4826 * F.col("mad")), F.lit(0.0)).alias("hop"))
