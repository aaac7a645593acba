"""The centre line's interval join: bisection and range sort alike, against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from voxelframe.operators import sampling


def line(spark, rows):
    return spark.createDataFrame(rows, "z double, x double, y double")


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_interpolation_of_a_long_line(spark, most):
    """100,000 control points, crowded at one end; a third of the points have one z."""
    rng = np.random.default_rng(6)
    z = np.sort(np.r_[rng.random(90_000) * 1e-3, 1 + rng.random(10_000) * 1e3])
    x, y = rng.normal(size=len(z)), np.cumsum(rng.normal(size=len(z)))
    control = line(spark, [tuple(map(float, r)) for r in zip(z, x, y)]).repartition(7)
    at = np.where(np.arange(6_000) % 3 == 0, z[50_000], rng.random(6_000) * 1.2e3 - 100)
    at[::2] *= 1e-6
    points = spark.createDataFrame([(i, float(v), 9) for i, v in enumerate(at)], "id long, z double, cx int").repartition(5)
    got = sampling.interpolate(points, control, most)
    assert got.columns == ["id", "z", "cx", "cy"]
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == 6_000
    for i, v in enumerate(at):
        assert rows[i].cx == pytest.approx(np.interp(v, z, x), abs=1e-6) and rows[i].cy == pytest.approx(np.interp(v, z, y), abs=1e-6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan or most == 0


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_odd_lines_and_points(spark, most):
    p = spark.createDataFrame([(0, None), (1, float("nan")), (2, 1.0), (3, -5.0), (4, 5.0), (4, 5.0), (5, float("inf"))], "id int, z double")
    got = lambda c: {r.id: (r.cx, r.cy) for r in sampling.interpolate(p, c, most).collect()}
    one = got(line(spark, [(1.0, 2.0, 3.0), (None, 7.0, 7.0), (float("nan"), 7.0, 7.0), (1.0, 9.0, 0.0)]))
    assert one == {0: (None, None), 1: (None, None), 2: (2.0, 3.0), 3: (2.0, 3.0), 4: (2.0, 3.0), 5: (2.0, 3.0)}
    two = got(line(spark, [(0.0, 0.0, 0.0), (4.0, 8.0, -4.0)]))
    assert two[2] == (2.0, -1.0) and two[3] == (0.0, 0.0) and two[4] == (8.0, -4.0)
    if most:
        assert set(got(line(spark, [])).values()) == {(None, None)}
    assert sampling.interpolate(p.where("false"), line(spark, [(0.0, 0.0, 0.0)]), most).count() == 0
