"""The chunk layer against numpy, and a round trip through stored arrays."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from voxelframe.operators import chunks
from voxelframe.sources import zarr

SHAPE, SIZE = (10, 9, 14), (4, 8, 5)


def store(root, a, size, separator, codec, skip_empty=True, order="C"):
    """Writes one level in the stored layout: full-size chunks, padded at the edges."""
    root.mkdir(parents=True)
    (root / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": a.shape, "chunks": size, "dtype": "|u1", "fill_value": 0, "order": order, "filters": None, "compressor": {"id": codec} if codec else None, "dimension_separator": separator}))
    for key in np.ndindex(*[-(-n // c) for n, c in zip(a.shape, size)]):
        part = a[tuple(slice(k * c, (k + 1) * c) for k, c in zip(key, size))]
        if skip_empty and not part.any():
            continue
        full = np.full(size, 77, np.uint8)
        full[tuple(map(slice, part.shape))] = part
        raw = full.tobytes(order)
        raw = {"zlib": zlib.compress, "zstd": zstandard.compress, None: bytes}[codec](raw)
        f = root / separator.join(map(str, key))
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(raw)


@pytest.fixture(scope="module")
def volumes():
    rng = np.random.default_rng(5)
    preds, ct = rng.integers(0, 256, SHAPE).astype(np.uint8), (rng.integers(0, 3, SHAPE) > 0).astype(np.uint8)
    preds[:4, :8, :5] = 0
    ct[4:8, :8, 5:10] = 0
    preds[9, 8, 13], preds[9, 8, 12] = 127, 128
    return preds, ct


@pytest.fixture(scope="module", params=[("/", None, "C"), (".", "zlib", "F"), ("/", "zstd", "C")])
def pair(spark, volumes, request, tmp_path_factory):
    root = tmp_path_factory.mktemp("arrays")
    sep, codec, order = request.param
    store(root / "p" / "0", volumes[0], SIZE, sep, codec, order=order)
    store(root / "c" / "2", volumes[1], SIZE, sep, codec, order=order)
    return f"file://{root}/p", f"file://{root}/c"


def test_stored_arrays_against_numpy(spark, volumes, pair):
    preds, ct = volumes
    p, c = zarr.open_pair(spark, *pair)
    pos, phantom = preds > 127, (preds > 127) & (ct == 0)
    got = {r.z: (r.positives, r.phantom) for r in chunks.planes(p, c).collect()}
    assert got == {z: (pos[z].sum(), phantom[z].sum()) for z in range(SHAPE[0])}
    back = np.zeros(SHAPE, np.uint8)
    for r in chunks.unpack(chunks.clean(p, c)).collect():
        back[r.z, r.y, r.x] = r.value
    assert (back == np.where(ct > 0, preds, 0)).all()
    cubes = {(r.cz, r.cy, r.cx): (r.positives, r.support) for r in chunks.cubes(p, c).collect()}
    assert (0, 0, 0) not in cubes and cubes[1, 0, 1][1] == 0.0
    block = np.s_[8:10, 8:9, 10:14]
    assert cubes[2, 1, 2] == (pos[block].sum(), 1 - phantom[block].sum() / pos[block].sum())


def dense(c, shape):
    out = np.zeros(shape, np.uint8)
    for r in chunks.unpack(c).collect():
        out[r.z, r.y, r.x] = r.value
    return out


@pytest.mark.parametrize("size", [(1, 9, 14), (3, 4, 6), (16, 16, 16), SIZE])
def test_rechunk(spark, volumes, pair, size):
    p = zarr.read(spark, pair[0])
    got = chunks.rechunk(p, size, SHAPE)
    assert (dense(got, SHAPE) == volumes[0]).all()
    assert all(list(r["shape"]) == [min(c, n - s) for c, n, s in zip(size, SHAPE, (r.z0, r.y0, r.x0))] for r in got.collect())
    cut = chunks.rechunk(p, size, (5, 9, 10), first=3)
    assert (dense(cut, (5, 9, 10)) == volumes[0][3:8, :, :10]).all()
    assert chunks.rechunk(p.where("false"), size, SHAPE).count() == 0
    twice = chunks.rechunk(p.union(p).withColumn("at", F.lit(1)), size, SHAPE)
    assert (dense(twice, SHAPE) == volumes[0]).all()


def test_pair_on_unequal_grids(spark, volumes, tmp_path):
    preds, ct = volumes
    store(tmp_path / "p" / "0", preds, SIZE, "/", None)
    store(tmp_path / "c" / "2", ct, (3, 9, 6), "/", "zlib")
    roots = f"file://{tmp_path}/p", f"file://{tmp_path}/c"
    for window, planes in (({}, range(10)), ({"z0": 5, "z1": 7}, range(4, 8))):
        got = {r.z: r.phantom for r in chunks.planes(*zarr.open_pair(spark, *roots, **window)).collect()}
        assert got == {z: ((preds[z] > 127) & (ct[z] == 0)).sum() for z in planes}


def test_window_reads_only_its_slabs(spark, pair):
    assert {r.cz for r in zarr.read(spark, pair[0], z0=4, z1=8).collect()} == {1}
    assert {r.cz for r in zarr.read(spark, pair[0], z0=7, z1=99).collect()} == {1, 2}
    assert zarr.read(spark, pair[0], z0=5, z1=5).count() == 0


def test_grids_must_agree(spark, volumes, tmp_path):
    store(tmp_path / "p" / "0", volumes[0], SIZE, "/", None)
    store(tmp_path / "c" / "2", volumes[1][:-1], SIZE, "/", None)
    with pytest.raises(zarr.GridMismatch):
        zarr.open_pair(spark, f"file://{tmp_path}/p", f"file://{tmp_path}/c")
    with pytest.raises(ValueError):
        zarr.parse_meta(json.dumps({"zarr_format": 2, "shape": [1, 1, 1], "chunks": [1, 1, 1], "dtype": "<f4", "fill_value": 0}))


def test_pack_edges(spark):
    rows = [(0, 0, 0, 5), (0, 0, 0, 9), (9, 8, 13, 255), (3, 3, 3, None), (10, 0, 0, 1)]
    v = spark.createDataFrame(rows, "z long, y long, x long, a int")
    p = chunks.pack(v, "a", SIZE, SHAPE)
    assert sorted(tuple(r) for r in chunks.unpack(p).collect()) == [(0, 0, 0, 9), (9, 8, 13, 255)]
    assert {tuple(r["shape"]) for r in p.collect()} == {(4, 8, 5), (2, 1, 4)}
    none = p.where("false")
    assert chunks.planes(none, none).count() == 0 and chunks.clean(none, p).count() == 0
    hollow = p.selectExpr("cz", "cy", "cx", "z0", "y0", "x0", "shape", "cast(null as binary) data", "1 bits", "2 scan")
    assert {(r.positives, r.phantom) for r in chunks.planes(hollow, p).collect()} == {(0, 0)}
    assert sum(r.phantom for r in chunks.planes(p, hollow).collect()) == 1
