"""Survey results as JSON and CSV, and the anchors of a calibration read back from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.support import fraction

SURVEY = "sampled_positives long, sampled_phantom long, sampled_phantom_frac double, planes_sampled long"
PLANE = ("z", "positives", "phantom", "phantom_frac")


def document(planes: DataFrame, **header) -> DataFrame:
    """One row: the header's values (of a slab survey mode and slab_stride), totals, and the planes in order of z. The list is as long as the volume has planes."""
    one = planes.agg(F.count(F.lit(1)).alias("planes_sampled"), F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"), F.coalesce(F.sum("phantom"), F.lit(0)).alias("phantom"), F.sort_array(F.collect_list(F.struct(*PLANE))).alias("per_plane"))
    total = [F.col("positives").alias("sampled_positives"), F.col("phantom").alias("sampled_phantom"), fraction().alias("sampled_phantom_frac"), (1 - fraction()).alias("sampled_support_frac")]
    return one.select(*[F.lit(v).alias(k) for k, v in header.items()], "planes_sampled", *total, "per_plane")


def write(planes: DataFrame, path: str, name: str, **header) -> None:
    """`<path>/survey_<name>.json` and `<path>/survey_<name>_planes.csv`, folders of Spark's part files; a survey that is there already is an error."""
    document(planes, **header).coalesce(1).write.json(f"{path}/survey_{name}.json")
    planes.select(*PLANE).repartitionByRange(1, "z").sortWithinPartitions("z").write.csv(f"{path}/survey_{name}_planes.csv", header=True)


def anchors(spark: SparkSession, path: str, spelling: str = "") -> DataFrame:
    """name, frac of the surveys under a glob. The name follows `survey_` in the path up to `_` or `.`; of several surveys of a name the last path counts. One without a fraction has no row. A name that begins with `spelling` in any case is spelt that way."""
    d = spark.read.schema(SURVEY).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("at"))
    d = d.withColumn("name", F.regexp_extract("at", r"survey_([^_./]+)[^/]*(?:/[^/]*)?$", 1)).where("name <> '' and sampled_phantom_frac is not null")
    if spelling:
        d = d.withColumn("name", F.when(F.lower("name").startswith(spelling.lower()), F.concat(F.lit(spelling), F.substr("name", F.lit(len(spelling) + 1)))).otherwise(F.col("name")))
    return d.groupBy("name").agg(F.max_by("sampled_phantom_frac", "at").alias("frac"))
