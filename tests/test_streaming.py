"""Surveys of arriving chunks: any order, restarts, and chunks that come again."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from voxelframe.operators import chunks
from voxelframe.streaming import survey

SHAPE, SIZE = (6, 8, 8), (2, 4, 4)


@pytest.fixture(scope="module")
def volumes(spark):
    rng = np.random.default_rng(12)
    pred, ct = rng.integers(0, 256, SHAPE), rng.integers(0, 2, SHAPE)
    rows = [(int(z), int(y), int(x), int(pred[z, y, x]), int(ct[z, y, x])) for z, y, x in np.ndindex(*SHAPE)]
    d = spark.createDataFrame(rows, "z long, y long, x long, p long, c long")
    return [chunks.pack(d, c, SIZE, SHAPE).cache() for c in "pc"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("z", "positives", "phantom", "phantom_frac").collect())


@pytest.mark.parametrize("order", [p for i, p in enumerate(itertools.permutations(range(3))) if i % 2 == 0])
def test_any_order_of_arrival_gives_the_batch_answer(spark, volumes, order, tmp_path):
    preds, scan = volumes
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for k in order:
        preds.where(f"cz = {k}").repartition(2).write.mode("append").parquet(source)
        survey.survey(spark, source, scan, out, files=1)
    assert rows_of(survey.answer(spark, out)) == rows_of(chunks.planes(preds, scan))
    seen = chunks.planes(preds.where(f"cz in ({order[0]}, {order[1]})"), scan)
    assert rows_of(seen) != rows_of(survey.answer(spark, out))


def test_restarts_and_repeated_chunks_count_once(spark, volumes, tmp_path):
    preds, scan = volumes
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    preds.where("cz < 2").write.mode("append").parquet(source)
    for _ in range(3):
        survey.survey(spark, source, scan, out)
    assert rows_of(survey.answer(spark, out)) == rows_of(chunks.planes(preds.where("cz < 2"), scan))
    preds.write.mode("append").parquet(source)
    survey.survey(spark, source, scan, out)
    assert rows_of(survey.answer(spark, out)) == rows_of(chunks.planes(preds, scan))
