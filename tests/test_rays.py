"""Rays, snapping and rendering against loops over arrays."""

from __future__ import annotations

import math

import numpy as np
import pytest

from voxelframe.operators import chunks, rays

SHAPE, SIZE = (12, 10, 14), (4, 4, 5)
SCHEMA = "id long, x double, y double, z double, nx double, ny double, nz double"


@pytest.fixture(scope="module")
def volume():
    rng = np.random.default_rng(9)
    v = (rng.integers(1, 256, SHAPE) * (rng.random(SHAPE) < 0.6)).astype(np.uint8)
    v[4:8, 4:8, 5:10] = 0
    return v


@pytest.fixture(scope="module")
def table(spark, volume):
    rows = [(int(z), int(y), int(x), int(volume[z, y, x])) for z, y, x in zip(*np.nonzero(volume), strict=True)]
    return chunks.pack(spark.createDataFrame(rows, "z long, y long, x long, v long"), "v", SIZE, SHAPE)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(10)
    rows = [(i, *map(float, rng.uniform(-3, 15, 3)), *map(float, rng.normal(size=3))) for i in range(200)]
    return [*rows, rows[0], rows[0], (900, None, 1.0, 1.0, 0.0, 0.0, 1.0), (901, 1.0, 1.0, 1.0, float("nan"), 0.0, 1.0), (902, 2.5, 3.5, 4.5, 0.0, 0.0, 0.0)]


def voxel(volume, p):
    if any(c is None or not math.isfinite(c) for c in p):
        return 0
    x, y, z = (min(max(round(c), 0), n - 1) for c, n in zip(p, SHAPE[::-1], strict=True))
    return int(volume[z, y, x])


def along(row, t):
    return [None if c is None else c + n * t for c, n in zip(row[1:4], row[4:], strict=True)]


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("gather", [10_000, 7])
def test_samples_of_two_volumes(spark, volume, table, points, monkeypatch, gather):
    """Repeated rays, rays without a place, chunks that are not there, and chunks of so many rays that several tasks share them."""
    monkeypatch.setattr(rays, "GATHER", gather)
    twice = table.withColumn("data", table["data"]).where("cz < 2")
    offsets = (-3, -0.5, 0, 2, 7)
    got = rays.sampled(spark.createDataFrame(points, SCHEMA).repartition(3), {"a": table, "b": twice}, offsets, SIZE, SHAPE).collect()
    half = volume.copy()
    half[8:] = 0
    bad = lambda p: any(any(c is None or not math.isfinite(c) for c in along(p, t)) for t in offsets)
    want = [(p[0], [0] * 5 if bad(p) else [voxel(volume, along(p, t)) for t in offsets], [0] * 5 if bad(p) else [voxel(half, along(p, t)) for t in offsets]) for p in points]
    assert key((r.id, r.a, r.b) for r in got) == key(want)


def test_snapping(spark, volume, table, points):
    got = rays.snapped(spark.createDataFrame(points, SCHEMA), table, SIZE, SHAPE, reach=6, above=127).collect()

    def snap(p):
        hits = [voxel(volume, along(p, t)) > 127 for t in range(-6, 7)]
        runs, start = [], None
        for i, h in enumerate([*hits, False]):
            if h and start is None:
                start = i
            elif not h and start is not None:
                runs.append((start + i - 1) / 2 - 6)
                start = None
        return min(runs, key=lambda m: (abs(m), m)) if runs and p[0] not in (900, 901) else None

    assert key((r.id, r.snap) for r in got) == key((p[0], snap(p)) for p in points)
    assert rays.snapped(spark.createDataFrame([], SCHEMA), table, SIZE, SHAPE).count() == 0


def test_runs_equally_near_go_to_the_earlier():
    hits = np.array([[1, 0, 0, 0, 1], [0, 1, 1, 0, 0], [0, 0, 0, 0, 0], [1, 1, 1, 1, 1], [0, 0, 0, 1, 1]], bool)
    assert np.array_equal(rays.nearest_runs(hits), [-2, -0.5, np.nan, 0, 1.5], equal_nan=True)


@pytest.mark.parametrize("size", [4, 5, 64])
def test_surface_does_not_depend_on_the_blocks(spark, size):
    """Enlarging and derivatives in one kernel equal enlarging the whole image, mirroring it and differentiating it."""
    rng = np.random.default_rng(11)
    mesh = rng.integers(0, 9, (3, 11, 9)).astype(float)
    mesh[:, 6:, :4] = 0
    rows = [(v, u, *map(float, mesh[:, v, u])) for v in range(11) for u in range(9) if mesh[:, v, u].any()]
    got = rays.surface(spark.createDataFrame(rows, "gv long, gu long, x double, y double, z double"), 11, 9, 3, size).collect()

    def at(i, n):
        f = min(max((i + 0.5) / 3 - 0.5, 0), n - 1)
        k = min(int(f), n - 2)
        return k, f - k

    big = np.zeros((3, 33, 27))
    for v in range(33):
        for u in range(27):
            (i, a), (j, b) = at(v, 11), at(u, 9)
            big[:, v, u] = (mesh[:, i, j] * (1 - b) + mesh[:, i, j + 1] * b) * (1 - a) + (mesh[:, i + 1, j] * (1 - b) + mesh[:, i + 1, j + 1] * b) * a
    normal = rays.cross(*[np.pad(c, 2, mode="reflect") for c in big])
    there = {(r.v, r.u): r for r in got}
    assert set(there) == {(v, u) for v in range(33) for u in range(27) if big[:, v, u].any()}
    for (v, u), r in there.items():
        assert (r.x, r.y, r.z) == pytest.approx(tuple(big[:, v, u]), abs=1e-9)
        want = [c[v, u] for c in normal]
        if np.linalg.norm(want) > 0.9:  # else the tangents are parallel and only rounding is left
            assert (r.nx, r.ny, r.nz) == pytest.approx(tuple(want), abs=1e-6)


def test_large_tiles_are_skipped(spark, volume, table):
    """Two tiles: one spans the volume, the other one voxel and its neighbours along z."""
    rows = [(0, u, 1.0 * u, 5.0, 1.0 * u, 0.0, 0.0, 1.0) for u in range(10)] + [(0, u, 3.0, 3.0, 3.0, 0.0, 0.0, 1.0) for u in range(10, 20)]
    p = spark.createDataFrame(rows, "v long, u long, x double, y double, z double, nx double, ny double, nz double")
    got = rays.render(p, table, 1, SIZE, SHAPE, tile=10, most=50).collect()
    assert {(r.layer, r.u): r.value for r in got} == {(k, u): int(volume[2 + k, 3, 3]) for k in range(3) for u in range(10, 20)}
    assert rays.render(p, table, 1, SIZE, SHAPE, tile=10).count() == 60
