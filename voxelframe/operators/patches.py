"""Square patches of a surface: status, result files, and the canvas that they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.frames import filled

#: A patch of a smaller valid share is empty.
LEAST_VALID = 0.3


def results(pixels: DataFrame, size: int, least: float = LEAST_VALID) -> DataFrame:
    """pixels(v, u, valid, ...) with the patch's corner v0, u0, the place pv, pu in it, and its status: `empty` if less than `least` of its pixels are valid, else `done`. Null validity is none. A patch has at most size x size pixels, so its share is a window over few rows."""
    p = pixels.withColumns({"v0": F.col("v") - F.col("v") % size, "u0": F.col("u") - F.col("u") % size, "pv": F.col("v") % size, "pu": F.col("u") % size})
    share = F.avg(F.coalesce("valid", F.lit(False)).cast("double")).over(Window.partitionBy("v0", "u0"))
    return p.withColumn("status", F.when(share < least, "empty").otherwise("done")).drop("v", "u")


def write(patches: DataFrame, path: str) -> None:
    """One folder a patch, below its status; a folder that is there already is an error. An empty patch keeps no pixels but one row of nulls, so that it counts as done in a later run."""
    keep = ["v0", "u0", "status"]
    blank = patches.where("status = 'empty'").select(*keep).distinct()
    patches.where("status = 'done'").unionByName(blank, allowMissingColumns=True).repartition("v0", "u0").write.partitionBy("status", "v0", "u0").parquet(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of the patches that are not empty; the status is a folder, so others are not read."""
    return spark.read.parquet(path).where("status = 'done'")


def canvas(pixels: DataFrame, size: int, width: int) -> DataFrame:
    """pixels(v0, u0, pv, pu, lr, valid) → row, col, lr, covered on one canvas of patches `width` pixels wide; uncovered and non-finite ratios are 0. Where patches overlap, the one whose file name comes last stays, valid or not."""
    at = lambda corner, inner: (F.floor(F.col(corner) / size) * width + F.col(inner)).cast("long")
    lr = filled(F.when(F.col("valid"), F.col("lr")))
    name = F.concat(F.lit("patch_v"), F.col("v0").cast("string"), F.lit("_u"), F.col("u0").cast("string"), F.lit(".npz"))
    pixel = F.struct(F.when(F.abs(lr) < float("inf"), lr).otherwise(0.0).alias("lr"), F.coalesce("valid", F.lit(False)).alias("covered"))
    placed = pixels.select(at("v0", "pv").alias("row"), at("u0", "pu").alias("col"), name.alias("name"), pixel.alias("pixel"))
    return placed.groupBy("row", "col").agg(F.max_by("pixel", F.struct("name", "pixel")).alias("pixel")).select("row", "col", "pixel.*")
