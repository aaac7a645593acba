"""Blocked stencils against plain loops, whatever the block size."""

from __future__ import annotations

import math
import statistics

import numpy as np
import pytest

from voxelframe.operators import grids, stencil

H, W = 21, 30


@pytest.fixture(scope="module")
def plane():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 200, (H, W)).astype(float)
    x[rng.random((H, W)) < 0.2] = 0
    return x


@pytest.fixture(scope="module")
def grid(spark, plane):
    """Cells that are 0 have no row; one is repeated with less, some lie outside."""
    rows = [(v, u, float(plane[v, u])) for v in range(H) for u in range(W) if plane[v, u]]
    rows += [(*rows[0][:2], -5.0), (-1, 0, 9.0), (H, 0, 9.0), (0, W, 9.0), (None, 1, 9.0), (0, None, 9.0)]
    return spark.createDataFrame(rows, "v long, u long, value double").repartition(5)


def mirror(i, n):
    return -i if i < 0 else 2 * n - 2 - i if i >= n else i


def repeat(i, n):
    return min(max(i, 0), n - 1) if -3 < i < n + 2 and i in (-1, n) else -i - 1 if i < 0 else 2 * n - 1 - i if i >= n else i


def table(df, *cols, keys=("v", "u")):
    rows = df.collect()
    out = np.full((len(cols), 1 + max(r[keys[0]] for r in rows), 1 + max(r[keys[1]] for r in rows)), np.nan)
    for r in rows:
        for k, c in enumerate(cols):
            assert np.isnan(out[k, r[keys[0]], r[keys[1]]])
            out[k, r[keys[0]], r[keys[1]]] = r[c]
    return out


def convolved(x, weights, border):
    return np.array([[sum(k * x[border(v + i, H), border(u + j, W)] for (i, j), k in weights.items()) for u in range(W)] for v in range(H)])


@pytest.mark.parametrize("size", [4, 7, 16, 256])
def test_median_and_derivatives(grid, plane, size):
    want = [[statistics.median(plane[repeat(v + i, H), repeat(u + j, W)] for i in range(-2, 3) for j in range(-2, 3)) for u in range(W)] for v in range(H)]
    assert np.array_equal(table(stencil.median5(grid, H, W, size), "value")[0], want)
    du = {(i - 2, j - 2): stencil.SMOOTH[i] * stencil.DIFF[j] for i in range(5) for j in range(5)}
    got = table(stencil.sobel(grid, H, W, size), "du", "dv")
    assert np.array_equal(got[0], convolved(plane, du, mirror))
    assert np.array_equal(got[1], convolved(plane, {(i, j): du[j, i] for i, j in du}, mirror))


@pytest.mark.parametrize("size", [12, 13, 64])
def test_gaussian_whose_halo_is_as_wide_as_a_block(grid, plane, size):
    k = {i: math.exp(-i * i / 18) for i in range(-12, 13)}
    total = sum(k.values())
    want = convolved(plane, {(i, j): k[i] * k[j] / total**2 for i in k for j in k}, mirror)
    assert np.allclose(table(stencil.gaussian(grid, H, W, size=size), "value")[0], want)
    with pytest.raises(ValueError):
        stencil.gaussian(grid, H, W, size=11)


@pytest.mark.parametrize("up", [1, 2, 3])
def test_enlargement(grid, plane, up):
    def at(x, n):
        f = min(max((x + 0.5) / up - 0.5, 0), n - 1)
        i = min(int(f), n - 2)
        return i, f - i

    got = table(stencil.resize(grid, H, W, up, 8), "value", keys=("ov", "ou"))[0]
    assert got.shape == (H * up, W * up)
    for ov in range(H * up):
        for ou in range(W * up):
            (i, a), (j, b) = at(ov, H), at(ou, W)
            want = (plane[i, j] * (1 - b) + plane[i, j + 1] * b) * (1 - a) + (plane[i + 1, j] * (1 - b) + plane[i + 1, j + 1] * b) * a
            assert got[ov, ou] == pytest.approx(want)


def test_empty_grids_and_one_row(spark, grid):
    none = stencil.sobel(grid.where("false"), 5, 6, 4).collect()
    assert len(none) == 30 and all(r.du == r.dv == 0 for r in none)
    line = spark.createDataFrame([(0, u, float(u)) for u in range(6)], "v long, u long, value double")
    assert [r.value for r in sorted(stencil.median5(line, 1, 6).collect())] == [1, 1, 2, 3, 4, 4]


def test_cells_are_shuffled_once_and_pieces_are_large(spark):
    """A sorted grid goes as few pieces: one a block and neighbour for each task, not one a cell."""
    g = spark.range(10_000).selectExpr("id div 100 v", "id % 100 u", "cast(id as double) value").coalesce(1)
    sent = g.selectExpr("cast(v as double)", "cast(u as double)", "value").mapInArrow(grids._pieces(100, 100, 25, 2), "bv int, bu int, at binary, vals binary")
    assert sent.count() == 16
    assert sum(len(r.at) // 4 for r in sent.collect()) == (4 * 25 + 2 * 6) ** 2
    plan = stencil.sobel(g, 100, 100, 25)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
