"""Files of formats that Spark does not write: one row a file, written whole by the task that holds it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which all executors share. Where that is unset, a temporary folder serves a local session; a cluster raises."""
    if not (root := spark.conf.get("spark.checkpoint.dir", "")):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{uuid.uuid4().hex}"


def put(path: str, content: bytes) -> None:
    """Write under a hidden name, then move: a task that is lost or runs twice leaves no half file and the same one."""
    system, place = fs.FileSystem.from_uri(path)
    parent, name = place.rsplit("/", 1)
    system.create_dir(parent, recursive=True)
    part = f"{parent}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, place)


def write(files: DataFrame) -> int:
    """Write files(path, content) and return how many there were. A path that comes twice keeps one of its contents; null contents are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                put(path, content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("path", "content").where("content is not null").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
