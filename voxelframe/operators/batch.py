"""Batches of jobs that can be stopped and run again: a ledger, errors as rows, results that are added once."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

#: What a run says about a job: its result is stored, has no rows, was there already, or an error and its text.
DONE, EMPTY, CACHED, FAILED = "done", "empty", "cached", "failed"
LEDGER = "job string, run int, status string, message string, seconds double"


def _file(path: str, job: str) -> str:
    """Where a job's result lies; names are hashed, so any text may name a job."""
    return f"{path}/results/{hashlib.sha256(job.encode()).hexdigest()}.parquet"


def _exists(path: str) -> bool:
    system, place = fs.FileSystem.from_uri(path)
    return system.get_file_info(place).type != fs.FileType.NotFound


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """job, run, status, message, seconds: one row a job and run that took it up."""
    if not _exists(f"{path}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger")


def state(spark: SparkSession, path: str) -> DataFrame:
    """The last row of the ledger of each job."""
    last = ledger(spark, path).groupBy("job").agg(F.max_by(F.struct("run", "status", "message", "seconds"), "run").alias("last"))
    return last.select("job", "last.*")


def pending(rows: DataFrame, path: str, job: str = "job") -> DataFrame:
    """rows of the jobs whose last run did not end well, or that no run has taken up."""
    ended = state(rows.sparkSession, path).where(F.col("status") != FAILED).select(F.col("job").alias("_job"))
    return rows.join(ended, F.col(job).cast("string") == F.col("_job"), "left_anti")


def run(rows: DataFrame, work: Callable[[pa.Table], pa.Table | None], path: str, job: str = "job") -> DataFrame:
    """Work on the pending jobs of rows(job, ...), store each result, and return this run's part of the ledger.

    A job's rows (a patch, a plane, a volume's surveys: bounded by what a job is) meet in
    one task, which gives them to `work` and puts what comes back into one file, whole or
    not at all. An error ends the job and not the batch: it becomes the job's row, and
    the next run takes the job up again. Rows of jobs that have ended are not shuffled.
    If a whole run is killed, its ledger is missing but its finished files are not: the
    next run finds them and reports them as cached, without work. Null jobs are left out.
    """
    spark = rows.sparkSession
    number = (ledger(spark, path).agg(F.max("run")).first()[0] or 0) + 1
    schema = pa.schema([("job", pa.string()), ("run", pa.int32()), ("status", pa.string()), ("message", pa.string()), ("seconds", pa.float64())])

    def one(key: tuple, table: pa.Table) -> pa.Table:
        name, began, message = key[0].as_py(), time.time(), None
        place = _file(path, name)
        if _exists(place):
            status = CACHED
        else:
            try:
                out = work(table.drop_columns(["_job"]))
                if out is None or out.num_rows == 0:
                    status = EMPTY
                else:
                    sink = pa.BufferOutputStream()
                    pq.write_table(out.append_column("job", pa.array([name] * out.num_rows, pa.string())) if "job" not in out.column_names else out, sink)
                    files.put(place, sink.getvalue().to_pybytes())
                    status = DONE
            except Exception as error:  # noqa: BLE001 - whatever a job raises is that job's result
                status, message = FAILED, f"{type(error).__name__}: {error}"
        return pa.Table.from_pylist([{"job": name, "run": number, "status": status, "message": message, "seconds": time.time() - began}], schema)

    todo = pending(rows, path, job).withColumn("_job", F.col(job).cast("string")).where("_job is not null")
    todo.groupBy("_job").applyInArrow(one, LEDGER).write.mode("append").parquet(f"{path}/ledger")
    return ledger(spark, path).where(F.col("run") == number)


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored results of all jobs, with the column `job`; empty where none is stored."""
    if not _exists(f"{path}/results"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/results")
