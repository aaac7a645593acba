"""Runs along rays, and what a ray snaps to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def islands(hits: DataFrame, mid: int, ray: tuple[str, ...] = ("y", "x"), step: str = "z") -> DataFrame:
    """ray, snap: the offset from mid of the centre of the nearest run of hits; on ties the earlier one. Rays without a hit have no row."""
    w = Window.partitionBy(*ray).orderBy(step)
    runs = hits.select(*ray, step, (F.col(step) - F.row_number().over(w)).alias("run")).groupBy(*ray, "run").agg(((F.min(step) + F.max(step)) / 2 - mid).alias("m"))
    return runs.groupBy(*ray).agg(F.min_by("m", F.struct(F.abs("m"), "m")).alias("snap"))


def split_runs(rows: DataFrame, key: str, col: str, gap: int = 64) -> DataFrame:
    """Runs of rows of each key; a gap above `gap` starts a new one."""
    w = Window.partitionBy(key).orderBy(col)
    d = rows.select(key, col).distinct().withColumn("new", (F.col(col) - F.lag(col).over(w) > gap).cast("int"))
    d = d.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(w))
    return d.groupBy(key, "run").agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(F.lit(1)).alias("n"))
