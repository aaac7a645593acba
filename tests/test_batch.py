"""Batches that fail, are killed, and run again."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import batch


@pytest.fixture
def rows(spark):
    return spark.range(60).select((F.col("id") % 6).alias("job"), "id").repartition(4)


def work(marks, fails=()):
    """Leaves a mark a call, so the test sees which jobs were worked on."""

    def one(table):
        job = table["job"][0].as_py()
        with open(f"{marks}/{job}", "a") as f:
            f.write("x")
        if job in fails:
            raise RuntimeError(f"job {job} broke")
        return None if job == 4 else pa.table({"total": [sum(table["id"].to_pylist())]})

    return one


def worked(marks):
    return {int(f.name): len(f.read_text()) for f in marks.iterdir()}


def test_only_the_failed_job_is_done_again(spark, rows, tmp_path):
    path, marks = f"file://{tmp_path}/b", tmp_path / "marks"
    marks.mkdir()
    first = {r.job: (r.run, r.status, r.message) for r in batch.run(rows, work(marks, {2}), path).collect()}
    assert first == {str(j): (1, *{2: ("failed", "RuntimeError: job 2 broke"), 4: ("empty", None)}.get(j, ("done", None))) for j in range(6)}
    assert [r.job for r in batch.pending(rows, path).select("job").distinct().collect()] == [2]
    again = batch.run(rows, work(marks), path).collect()
    assert [(r.job, r.run, r.status) for r in again] == [("2", 2, "done")]
    assert worked(marks) == {0: 1, 1: 1, 2: 2, 3: 1, 4: 1, 5: 1}
    assert batch.run(rows, work(marks), path).count() == 0 and worked(marks)[2] == 2
    got = {r.job: r.total for r in batch.results(spark, path, "job string, total long").collect()}
    assert got == {str(j): sum(range(j, 60, 6)) for j in range(6) if j != 4}
    assert {r.job: r.status for r in batch.state(spark, path).collect()} == {**{str(j): "done" for j in range(6)}, "4": "empty"}


def test_a_killed_run_keeps_its_finished_jobs(spark, rows, tmp_path):
    """The run's ledger never appears; the files of two jobs do, and their work is not done again."""
    path, marks = f"file://{tmp_path}/b", tmp_path / "marks"
    marks.mkdir()
    batch.run(rows.where("job < 2"), work(marks), path)
    (tmp_path / "b" / "ledger").rename(tmp_path / "lost")
    got = {r.job: r.status for r in batch.run(rows.where("job < 3"), work(marks), path).collect()}
    assert got == {"0": "cached", "1": "cached", "2": "done"} and worked(marks) == {0: 1, 1: 1, 2: 1}


def test_new_jobs_odd_names_and_empty_tables(spark, rows, tmp_path):
    path = f"file://{tmp_path}/b"
    assert batch.run(rows.where("false"), lambda t: t, path).count() == 0
    assert batch.results(spark, path, "job string").count() == 0
    odd = spark.createDataFrame([("a/b ../c", 1), ("", 2), (None, 3), ("a/b ../c", 4)], "job string, v int")
    assert batch.run(odd, lambda t: pa.table({"n": [t.num_rows]}), path).count() == 2
    assert {r.job: r.n for r in batch.results(spark, path, "job string, n long").collect()} == {"a/b ../c": 2, "": 1}
    more = odd.unionAll(spark.createDataFrame([("new", 1)], "job string, v int"))
    assert [r.job for r in batch.run(more, lambda t: pa.table({"n": [t.num_rows]}), path).collect()] == ["new"]
