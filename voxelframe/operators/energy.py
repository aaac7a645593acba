"""Two-energy ratio maps with global scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import percentiles


def depth(samples: DataFrame) -> DataFrame:
    """Per pixel the mean of both energies over depth, and the maximum."""
    return samples.groupBy("v", "u").agg(F.avg("v53").alias("m53"), F.avg("v70").alias("m70"), F.max("v53").alias("x53"), F.max("v70").alias("x70"), F.bool_or("valid").alias("valid"))


def layer(samples: DataFrame, offset: int) -> DataFrame:
    """One depth layer: per pixel the mean of both energies at the offset."""
    return samples.where(F.col("offset") == offset).groupBy("v", "u").agg(F.avg("v53").alias("m53"), F.avg("v70").alias("m70"))


def normalise(pixels: DataFrame, col: str) -> DataFrame:
    """u8: the column between its least and greatest value as 0..255, truncated; a range below 1 counts as 1. The bounds are one broadcast row."""
    b = pixels.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    u8 = F.floor((F.col(col) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)) * 255)
    return pixels.crossJoin(F.broadcast(b)).withColumn("u8", u8.cast("long")).drop("_lo", "_hi")


def log_ratio(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("lr", F.log((F.col("m53") + 1) / (F.col("m70") + 1)))


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def zscores(pixels: DataFrame) -> DataFrame:
    """z of the log ratio over all valid pixels of finite ratio (population deviation); 0 elsewhere, and everywhere where they do not differ. The statistics are one broadcast row."""
    fine = F.col("valid") & finite(F.col("lr"))
    s = pixels.where(fine).agg(F.avg("lr").alias("mean"), F.stddev_pop("lr").alias("sd"))
    z = F.coalesce(F.when(fine, F.try_divide(F.col("lr") - F.col("mean"), F.col("sd"))), F.lit(0.0))
    return pixels.crossJoin(F.broadcast(s)).withColumn("zscore", z).drop("mean", "sd")


#: The least width that an intensity range is stretched over.
LEAST_RANGE = 1e-6


def stretch(pixels: DataFrame, col: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Percentile stretch to 0..255, clipped and truncated. The percentiles are exact, over covered (valid) pixels, and selected across partitions; without a covered pixel they are 0 and 1."""
    q = percentiles(pixels.where("valid"), [], col, {"_low": low, "_high": high}).select(F.coalesce("_low", F.lit(0.0)).alias("_low"), F.coalesce("_high", F.lit(1.0)).alias("_high"))
    width = F.greatest(F.col("_high") - F.col("_low"), F.lit(LEAST_RANGE))
    t = F.least(F.greatest((F.col(col) - F.col("_low")) / width, F.lit(0.0)), F.lit(1.0))
    return pixels.crossJoin(F.broadcast(q)).withColumn("u8", F.floor(t * 255).cast("long")).drop("_low", "_high")
