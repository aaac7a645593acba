"""Selection, ranks and running medians against sorting in one place."""

from __future__ import annotations

import statistics
import time

import numpy as np
import pytest

from voxelframe.operators import energy, order, winding


@pytest.mark.parametrize(("bins", "most"), [(256, 100_000), (8, 20)])
def test_percentiles_of_keys(spark, bins, most):
    """A key of one value, one of many ties, one of a wide range, two values, one, and none; nulls and NaN do not count."""
    rng = np.random.default_rng(1)
    groups = {0: [7.0] * 50, 1: [float(x) for x in rng.integers(0, 5, 200)], 2: [float(x) for x in rng.normal(size=300) * 10.0 ** rng.integers(-6, 9, 300)], 3: [1.0, 2.0], None: [5.0], 5: []}
    rows = [(k, v) for k, vs in groups.items() for v in [*vs, None, float("nan")]]
    shares = {"lo": 0.0, "p2": 0.02, "mid": 0.5, "p99": 0.99, "hi": 1.0}
    d = spark.createDataFrame(rows, "k int, v double").repartition(3)
    got = {r.k: r for r in order.percentiles(d.where("k is not null"), ["k"], "v", shares, bins, most).collect()}
    assert set(got) == {0, 1, 2, 3}
    for k, r in got.items():
        for name, p in shares.items():
            assert r[name] == pytest.approx(np.percentile(groups[k], 100 * p), rel=1e-12)
    every = [v for k, vs in groups.items() for v in vs]
    one = order.percentiles(d, [], "v", shares, bins, most).collect()
    assert len(one) == 1 and all(one[0][n] == pytest.approx(np.percentile(every, 100 * p), rel=1e-12) for n, p in shares.items())
    assert tuple(order.percentiles(d.where("false"), [], "v", shares, bins, most).first()) == (None,) * 5


def test_selection_never_sorts_more_than_it_may(spark):
    """A third of all rows share one value; ranks within, below and above it are found though no more than 2,000 rows may be sorted."""
    d = spark.range(200_000).selectExpr("case when id % 3 = 0 then 0.5 else (id * 2654435761 % 200003) / 200003 end v")
    want = np.sort(np.array([r.v for r in d.collect()]))
    ranks = [0, 5, 33_000, 100_000, 140_000, 199_999, 200_000, -1]
    w = spark.createDataFrame([(str(k), k) for k in ranks], "_want string, _k long")
    got = {int(r._want): r._value for r in order.select(d, [], "v", w, bins=32, most=2_000).collect()}
    assert got == {k: want[k] for k in ranks[:-2]}


def test_stretch_without_covered_pixels(spark):
    p = spark.createDataFrame([(0, 0, 0.5, False), (0, 1, 7.0, False)], "v long, u long, m53 double, valid boolean")
    assert {r.u: r.u8 for r in energy.stretch(p, "m53").collect()} == {0: 127, 1: 255}


def test_ranks_of_hot_and_null_keys(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 3 == 0 else int(i % 5), float(rng.integers(0, 9)), i) for i in range(3_000)]
    got = order.ranked(spark.createDataFrame(rows, "key int, v double, n long").repartition(4), "key", ["v", "n"]).collect()
    for key in {r.key for r in got}:
        mine = sorted((r.v, r.n, r["rank"]) for r in got if r.key == key)
        assert [x[2] for x in mine] == list(range(len(mine)))


def test_running_medians_in_blocks(spark, monkeypatch):
    """Blocks of 8 places make several even of short paths; rising, falling, tied and random values."""
    monkeypatch.setattr(order, "LEAST_BLOCK", 8)
    rng = np.random.default_rng(4)
    paths = {"up": np.arange(150.0), "down": -np.arange(130.0), "ties": rng.integers(0, 3, 140).astype(float), "noise": rng.normal(size=200), "turn": np.r_[np.zeros(70), np.ones(90)], "short": np.array([3.0]), "two": np.array([1.0, 4.0]), "edge": rng.normal(size=8), "next": rng.normal(size=9)}
    rows = [(k, i + 1, float(v)) for k, vs in paths.items() for i, v in enumerate(vs)]
    ranks = order.ranked(spark.createDataFrame(rows, "key string, n long, v double").repartition(3), "key", ["v", "n"])
    got = {(r.key, r.n): r["median"] for r in order.running_medians(ranks).collect()}
    assert got == {(k, i + 1): statistics.median(vs[: i + 1]) for k, vs in paths.items() for i in range(len(vs))}


def test_changepoint_of_a_long_path(spark):
    """100,000 points with one step of 2 after the first 60,000, beside short paths."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=100_000) + 2 * (np.arange(100_000) >= 60_000)
    rows = spark.createDataFrame([(1, i + 1, float(x)) for i, x in enumerate(v)] + [(2, i + 1, float(i)) for i in range(7)] + [(3, i + 1, float(i * i)) for i in range(9)], "collection int, n int, resid double")
    about = spark.createDataFrame([(1, 100_000, 1.0), (2, 7, 1.0), (3, 9, 1.0)], "collection int, n long, mad double")
    began = time.time()
    hop = {r.collection: r.hop for r in winding.changepoint(rows, about).collect()}
    assert time.time() - began < 60
    top = max(abs(np.median(v[k:]) - np.median(v[:k])) for k in [*range(3, 99_996, 997), *range(59_900, 60_100)])
    assert hop[1] * 1.4826 >= top and hop[1] * 1.4826 == pytest.approx(2, abs=0.3) and hop[2] == 0
    nine = [float(i * i) for i in range(9)]
    assert hop[3] * 1.4826 == pytest.approx(max(abs(statistics.median(nine[k:]) - statistics.median(nine[:k])) for k in range(3, 6)))
