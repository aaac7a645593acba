"""One-parameter calibration of a saturating model 1 - (1 - p)^k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order

#: Grid of k: points and bounds.
POINTS, LOW, HIGH = 4_000, 1.0, 25.0


def model(p: Column, k: Column) -> Column:
    return 1 - F.pow(1 - p, k)


def fit(anchors: DataFrame, points: int = POINTS) -> DataFrame:
    """(k, sse) of least squared error over anchors(share, frac); the first k on ties. The grid is bounded by `points`."""
    grid = anchors.sparkSession.range(points).select((LOW + F.col("id") * ((HIGH - LOW) / (points - 1))).alias("k"))
    sse = anchors.select("share", "frac").crossJoin(F.broadcast(grid)).groupBy("k").agg(F.sum(F.pow(model(F.col("share"), F.col("k")) - F.col("frac"), F.lit(2))).alias("sse"))
    return sse.agg(F.min_by("k", F.struct("sse", "k")).alias("k"))


def estimates(samples: DataFrame, k: DataFrame) -> DataFrame:
    """Per sample the anchor where there is one, else the model's value."""
    return samples.crossJoin(F.broadcast(k)).withColumn("est", F.coalesce("frac", model(F.col("share"), F.col("k"))))


def residuals(anchors: DataFrame, k: DataFrame) -> DataFrame:
    r = F.abs(F.col("frac") - model(F.col("share"), F.col("k")))
    return anchors.crossJoin(F.broadcast(k)).agg(F.max(r).alias("band"), F.count(F.lit(1)).alias("n"))


def report(samples: DataFrame, k: DataFrame) -> DataFrame:
    """samples(name, share, frac) with the estimate, the band (the largest residual of the anchors; 0 where measured) and whether it was measured; the caller sorts by falling share."""
    est = estimates(samples, k)
    band = residuals(samples.where("frac is not null"), k).select("band")
    measured = F.col("frac").isNotNull()
    return est.crossJoin(F.broadcast(band)).select("name", "share", "est", F.when(measured, 0.0).otherwise(F.col("band")).alias("band"), measured.alias("measured"))


def document(samples: DataFrame, k: DataFrame) -> DataFrame:
    """One row of the calibration: model, k, anchors, band_abs, and the estimates of samples(name, share, frac), rounded to 3 and 4 places. The maps are as long as the list of samples; repeated names keep one entry; without anchors band and k are null."""
    one = report(samples, k).dropDuplicates(["name"])
    entry = F.struct("name", F.round("est", 4).alias("value"))
    lists = one.agg(F.sort_array(F.collect_list(F.when(F.col("measured"), entry))).alias("a"), F.sort_array(F.collect_list(entry)).alias("e"))
    band = residuals(samples.where("frac is not null"), k).select(F.round("band", 4).alias("band_abs"))
    return lists.crossJoin(F.broadcast(band)).crossJoin(F.broadcast(k)).select(
        F.lit("p_voxel = 1 - (1-p_chunk)^k").alias("model"), F.round("k", 3).alias("k"), F.map_from_entries("a").alias("anchors"), "band_abs", F.map_from_entries("e").alias("estimates")
    )


def ranked(rows: DataFrame, ord: str) -> DataFrame:
    """rows with `place` (from 0): by falling share, of equal shares in the order of the catalogue's column."""
    keyed = rows.withColumns({"_all": F.lit(0), "_share": -F.col("share")})
    return order.ranked(keyed, "_all", ["_share", ord], "place").drop("_all", "_share")
