"""Formats that this library writes and reads: arrays, blosc frames, patches, annotations, affine files."""

from __future__ import annotations

import json
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from voxelframe.functions import frames
from voxelframe.operators import catalog, chunks, patches, sampling
from voxelframe.plans import file_queries, oracles
from voxelframe.sources import files, zarr

SHAPE, SIZE = (5, 7, 9), (2, 4, 4)


def volume(spark, seed=1):
    a = np.random.default_rng(seed).integers(0, 256, SHAPE).astype(np.uint8)
    a[:2] = 0
    a[4, 6, 8] = 7
    v = spark.createDataFrame([(*map(int, i), int(x)) for i, x in np.ndenumerate(a)], "z long, y long, x long, value long")
    return a, chunks.pack(v, "value", SIZE, SHAPE)


def frame(raw: bytes, block: int, codec: int, pack, flags: int = 0) -> bytes:
    """A blosc frame built by the format's description."""
    parts = []
    for i in range(0, len(raw), block):
        p = pack(raw[i : i + block])
        p = p if len(p) < len(raw[i : i + block]) else raw[i : i + block]
        parts.append(struct.pack("<I", len(p)) + p)
    at = 16 + 4 * len(parts) + np.cumsum([0, *map(len, parts[:-1])])
    body = b"".join(struct.pack("<I", int(o)) for o in at) + b"".join(parts)
    return struct.pack("<BBBBIII", 2, 1, codec << 5 | flags, 1, len(raw), block, 16 + len(body)) + body


@pytest.mark.parametrize(("codec", "pack"), [(1, lambda b: pa.Codec("lz4_raw").compress(b).to_pybytes()), (3, zlib.compress), (4, lambda b: pa.Codec("zstd").compress(b).to_pybytes())])
def test_blosc(codec, pack):
    raw = bytes(np.random.default_rng(2).integers(0, 3, 1000).astype(np.uint8)) + bytes(range(256)) * 2
    for flags in (0, 1, 16):
        assert zarr.decode(frame(raw, 256, codec, pack, flags), "blosc") == raw
    planes = np.packbits(np.unpackbits(np.frombuffer(raw[:256], np.uint8).reshape(-1, 1), axis=1, bitorder="little").T, axis=1, bitorder="little").tobytes()
    assert zarr.blosc(frame(planes, 256, codec, pack, 4)) == raw[:256]
    assert zarr.blosc(struct.pack("<BBBBIII", 2, 1, 2, 1, 3, 3, 19) + b"abc") == b"abc"
    with pytest.raises(ValueError, match="not supported"):
        zarr.blosc(frame(raw, 256, 0, pack))


@pytest.mark.parametrize("codec", [None, "zlib", "zstd"])
def test_array_round_trip(spark, codec):
    a, c = volume(spark)
    path = files.folder(spark)
    # Chunks of zeros are not stored: the first layer of chunks.
    assert zarr.write(c, path, SHAPE, SIZE, "0", codec) == 2 * 2 * 3
    got = np.zeros(SHAPE, np.uint8)
    for r in chunks.unpack(zarr.read(spark, path)).collect():
        got[r.z, r.y, r.x] = r.value
    assert (got == a).all()
    box = ((1, 4), (2, 5), (3, 9))
    some = zarr.read(spark, path, "0", *box[0], y=(0, 4), x=(4, 8))
    assert {(r.cz, r.cy, r.cx) for r in some.collect()} == {(1, 0, 1)}
    want = {(int(z) + 1, int(y) + 2, int(x) + 3) for z, y, x in np.argwhere(a[1:4, 2:5, 3:9])}
    assert {(r.z, r.y, r.x) for r in zarr.read_box(spark, path, box).collect()} == want
    assert zarr.read_box(spark, path, ((0, 5), (7, 9), (0, 3))).count() == 0


def test_array_of_nothing(spark):
    _, c = volume(spark)
    path = files.folder(spark)
    assert zarr.write(c.where("false"), path, SHAPE, SIZE) == 0
    assert zarr.meta(spark, path).shape == SHAPE
    with pytest.raises(ValueError, match="codec"):
        zarr.write(c, path, SHAPE, SIZE, codec="snappy")


def test_lookup_chunks_equals_voxels(spark, monkeypatch):
    """Also where one chunk's points are dealt to several tasks; nulls and absent chunks give 0, repeats stay."""
    monkeypatch.setattr(sampling, "GATHER", 10)
    _, c = volume(spark, 3)
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.uniform(-2, 10, 3))) for i in range(200)] + [(200, None, 1.0, 1.0), (201, 0.5, 1.5, 2.5), (201, 0.5, 1.5, 2.5)]
    p = spark.createDataFrame(rows, "id int, z double, y double, x double")
    want = sorted((r.id, r.value) for r in sampling.lookup(p, chunks.unpack(c), SHAPE, "value").collect())
    assert sorted((r.id, r.value) for r in sampling.lookup_chunks(p, c, SIZE, SHAPE).collect()) == want
    assert sampling.lookup_chunks(p.where("false"), c, SIZE, SHAPE).count() == 0


def test_affine_file(spark):
    path = files.folder(spark) + ".json"
    files.put(path, json.dumps({"params": [[2, 0, 0, 1], [0, 4, 0, 0], [0, 0, 1, -3]]}).encode())
    m = frames.load_affine(spark, path)
    assert m[3] == [0, 0, 0, 1] and frames.inverse(m)[0] == [0.5, 0, 0, -0.5]
    files.put(path, b"{}")
    with pytest.raises(ValueError, match="params"):
        frames.load_affine(spark, path)
    with pytest.raises(ValueError, match="4x4"):
        frames.padded([[1, 2], [3, 4]])


def test_patches(spark):
    """A share of exactly 0.3 is enough; an empty patch leaves one row that the scan skips; NaN is drawn as 0."""
    rows = [(i, j, (float("nan") if (i, j) == (0, 0) else 1.5), (i * 10 + j) < (30 if j < 10 else 0) or (j >= 10 and i == 0 and j < 12)) for i in range(10) for j in range(20)]
    p = spark.createDataFrame(rows, "v int, u int, lr double, valid boolean")
    r = patches.results(p, 10)
    assert {(x.u0, x.status) for x in r.collect()} == {(0, "done"), (10, "empty")}
    path = files.folder(spark)
    patches.write(r, path)
    assert spark.read.parquet(path).where("status = 'empty'").count() == 1
    c = {(x.row, x.col): (x.lr, x.covered) for x in patches.canvas(patches.scan(spark, path), 10, 10).collect()}
    assert len(c) == 100 and c[0, 0] == (0.0, True) and c[2, 9] == (1.5, True) and c[5, 0] == (0.0, False)


def test_annotation(spark):
    """Kinds, numbers, names, null wind_a, and a click beside all valid cells that goes with its collection."""
    mesh = spark.createDataFrame([(v, u, 10.0 * v + u, 1.0, 2.0, (v, u) != (2, 2)) for v in range(3) for u in range(3)], "gv int, gu int, x double, y double, z double, valid boolean")
    clicks = spark.createDataFrame([(1, 1, 1.0, 0.0, "same", 0.0), (1, 2, 2.0, 2.0, "same", 0.0), (2, 1, 99.0, 99.0, "same", 0.0), (3, 1, 0.0, 0.0, "relative", 1.5)], "collection int, seq int, u double, v double, mode string, wind_a double")
    got = {(r.kind, r.k): (r.name, json.loads(r.json)) for r in catalog.export_kinds(catalog.annotate(clicks, mesh, 3, 3, frames.F.lit(0.5)), 100).collect()}
    assert set(got) == {("same", 1), ("relative", 1)}
    name, one = got["same", 1]
    assert name == one["name"] == "same_wrap1" and "autoFillMode" not in one and one["metadata"] == {"winding_is_absolute": False}
    assert one["points"] == {"0": {"creation_time": 100, "p": [0.5, 1.0, 2.0], "wind_a": None}, "1": {"creation_time": 101, "p": [11.0, 1.0, 2.0], "wind_a": None}}
    name, two = got["relative", 1]
    assert name == "wraps3" and two["autoFillMode"] == 1 and two["autoFillConstant"] == 0.0 and two["points"]["0"]["wind_a"] == 1.5


def test_points_file_has_no_row_for_a_place_without_a_point(spark, tmp_path):
    """A last row of two points beside full ones, a gap, and a missing point (all zeros), which stays."""
    ids = [*range(0, 42), *range(166, 400), 100_002]
    e = np.random.default_rng(2).uniform(-1, 1, (len(ids), 64))
    e[2], e[2, :3] = 0, -1
    spark.createDataFrame(list(zip(ids, e.tolist(), strict=True)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = file_queries.points_file(spark, str(tmp_path))
    want = duckdb.connect()
    want.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = want.execute(f"select {', '.join(got.columns)} from ({oracles.oracle_sql()['points_file']})").fetchall()
    rows = sorted(map(tuple, got.collect()))
    assert [r[:2] for r in rows] == sorted((i // 20, i % 20) for i in ids if i // 20 % 2 == 0 and i % 2 == 0)
    assert (0, 2, *[0.0] * 6, False) in rows
    for a, b in zip(rows, sorted(want), strict=True):
        assert a == pytest.approx(b, abs=1e-5)
