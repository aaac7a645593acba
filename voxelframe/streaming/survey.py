"""A survey kept up to date while chunk files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks
from ..operators.support import THRESHOLD, fraction


def planes(arriving: DataFrame, scan: DataFrame, thr: int = THRESHOLD) -> DataFrame:
    """z, positives, phantom, phantom_frac of the chunks of a streaming chunk table so far, against a scan's chunk table that is there.

    The state is one key a chunk, so that a chunk that comes again counts once (which of
    two unlike ones is the first is the arrival's matter), and two sums a plane, which
    do not depend on the order of arrival.
    """
    first = arriving.dropDuplicates(chunks.KEY)
    return chunks.counts(first, scan, thr).groupBy("z").agg(F.sum("positives").alias("positives"), F.sum("phantom").alias("phantom")).withColumn("phantom_frac", fraction())


def survey(spark: SparkSession, source: str, scan: DataFrame, out: str, thr: int = THRESHOLD, files: int | None = None) -> None:
    """Take up every chunk file (Parquet, chunks.SCHEMA) below `source` that no earlier call has, and write the survey of all so far below `out`.

    Which files are counted is kept with the state in `out`, so a call after a stop, or
    one that was killed between two batches, goes on where the last one ended and counts
    nothing twice. A batch's answer is one folder, written whole or again.
    """
    stream = spark.readStream.schema(chunks.SCHEMA)
    stream = (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/answers/{number:012}")

    writer = planes(stream, scan, thr).writeStream.outputMode("complete").foreachBatch(put)
    writer.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


def answer(spark: SparkSession, out: str) -> DataFrame:
    """The survey after the last batch."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/answers")
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max(f.getPath().toString() for f in system.listStatus(p) if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))
    return spark.read.parquet(last)
