"""Agreement of a prediction with a masked scan: per plane, slab, cube and volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

THRESHOLD = 127


def positive(thr: int = THRESHOLD):
    return F.col("pred") > thr


def counts(thr: int = THRESHOLD):
    """positives and phantom (positive where the scan is 0), as partial aggregates."""
    return F.count_if(positive(thr)).alias("positives"), F.count_if(positive(thr) & (F.col("ct") <= 0)).alias("phantom")


def fraction():
    return F.coalesce(F.try_divide(F.col("phantom").cast("double"), F.col("positives").cast("double")), F.lit(0.0))


def align(preds: DataFrame, ct: DataFrame, key: Sequence[str] = ("z", "y", "x")) -> DataFrame:
    """Positional join of two volumes; a voxel without scan counts as 0."""
    return preds.join(ct, list(key), "left").withColumn("ct", F.coalesce("ct", F.lit(0)))


def planes(vox: DataFrame, thr: int = THRESHOLD) -> DataFrame:
    """z, positives, phantom, phantom_frac (0 where there are no positives)."""
    return vox.groupBy("z").agg(*counts(thr)).withColumn("phantom_frac", fraction())


def stride(vox: DataFrame, n: int) -> DataFrame:
    return vox.where(F.col("z") % n == 0)


def plane_list(vox: DataFrame, wanted: Sequence[int], thr: int = THRESHOLD) -> DataFrame:
    """Planes in the given order; a plane named twice is counted twice."""
    names = vox.sparkSession.createDataFrame(list(enumerate(wanted)), "ord int, z long")
    found = planes(vox.where(F.col("z").isin(*set(wanted))), thr)
    return F.broadcast(names).join(found, "z", "left").fillna(0, ["positives", "phantom", "phantom_frac"])


def totals(vox: DataFrame, thr: int = THRESHOLD) -> DataFrame:
    """One row: planes, positives, phantom, fraction, support (1 without positives)."""
    t = planes(vox, thr).agg(F.count(F.lit(1)).alias("planes"), F.sum("positives").alias("positives"), F.sum("phantom").alias("phantom"))
    return t.withColumn("phantom_frac", fraction()).withColumn("support", 1 - F.col("phantom_frac"))


def slabs(vox: DataFrame, chunk: int, every: int, thr: int = THRESHOLD) -> DataFrame:
    """Planes of every so-manieth z-chunk slab."""
    s = vox.withColumn("slab", F.floor(F.col("z") / chunk)).where(F.col("slab") % max(every, 1) == 0)
    return s.groupBy("slab", "z").agg(*counts(thr)).withColumn("phantom_frac", fraction())


def running(slabs_: DataFrame) -> DataFrame:
    """Per slab the fraction of all slabs up to it. One row a slab reaches the window."""
    per = slabs_.groupBy("slab").agg(F.sum("positives").alias("p"), F.sum("phantom").alias("q"))
    w = Window.orderBy("slab").rowsBetween(Window.unboundedPreceding, 0)
    cum = per.select("slab", F.sum("p").over(w).alias("positives"), F.sum("q").over(w).alias("phantom"))
    return cum.withColumn("running_frac", fraction())


def cubes(vox: DataFrame, size: int, z0: int = 0, z1: int | None = None, thr: int = THRESHOLD) -> DataFrame:
    """Support of each cube with positives; cubes start at z0 and those that start before z1 are read to their end."""
    d = vox.where(F.col("z") >= z0)
    if z1 is not None:
        d = d.where(F.col("z") < z0 + -(-(z1 - z0) // size) * size)
    zc = F.floor((F.col("z") - z0) / size) * size + z0
    c = d.groupBy(zc.alias("zc"), (F.floor(F.col("y") / size) * size).alias("yc"), (F.floor(F.col("x") / size) * size).alias("xc")).agg(*counts(thr)).where("positives > 0")
    return c.select("zc", "yc", "xc", "positives", (1 - fraction()).alias("support"))


def keep_drop(cubes_: DataFrame, keep: float = 0.5) -> DataFrame:
    return cubes_.agg(F.count_if(F.col("support") >= keep).alias("kept"), F.count_if(F.col("support") < keep).alias("dropped"))


def clean(vox: DataFrame, z0: int, z1: int) -> DataFrame:
    """The window [z0, z1), z from 0; the raw prediction stays where the scan is above 0."""
    d = vox.where((F.col("z") >= z0) & (F.col("z") < z1))
    return d.select((F.col("z") - z0).alias("z"), "y", "x", F.when(F.col("ct") > 0, F.col("pred")).otherwise(0).alias("pred"))


def lazy_cubes(preds: DataFrame, ct: DataFrame, size: int, thr: int = THRESHOLD) -> DataFrame:
    """cubes(), reading the scan only where a cube has positives."""
    key = [F.floor(F.col(c) / size).alias(f"c{c}") for c in "zyx"]
    hot = preds.where(positive(thr)).select(*key).distinct()
    near = ct.select("*", *key).join(hot, ["cz", "cy", "cx"], "left_semi").drop("cz", "cy", "cx")
    return cubes(align(preds.where(positive(thr)), near), size, thr=thr)
