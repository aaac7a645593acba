"""Point files, image rows and surveys against numpy and by round trips."""

from __future__ import annotations

import json
import struct

import numpy as np
import pytest

from voxelframe.operators import support
from voxelframe.sources import surfaces, surveys


def test_points(spark, tmp_path):
    grid = np.random.default_rng(1).normal(size=(6, 9, 6))
    grid[2, 3] = 0
    (tmp_path / "a.ppm").write_bytes(b"width: 9\nheight: 6\ndim: 6\n<>\n" + grid.astype("<f8").tobytes())
    path = f"file://{tmp_path}/a.ppm"
    got = {(r.v, r.u): tuple(r)[3:] for r in surfaces.points(spark, path).collect()}
    assert len(got) == 54 and got[2, 3] == (0.0,) * 6 and all(got[k] == tuple(grid[k]) for k in got)
    part = {(r.v, r.u) for r in surfaces.points(spark, path, 1, 2, 4, 3).collect()}
    assert part == {(1, 2), (1, 5), (4, 2), (4, 5)}


def test_short_point_file_raises(spark, tmp_path):
    (tmp_path / "a.ppm").write_bytes(b"width: 9\nheight: 6\n<>\n" + bytes(80))
    with pytest.raises(Exception, match="buffer"):
        surfaces.points(spark, f"file://{tmp_path}/a.ppm").collect()


def test_rows_and_sampling(spark, tmp_path):
    vol = np.random.default_rng(2).integers(0, 65536, (3, 5, 7)).astype("<u2")
    for z in range(3):
        (tmp_path / f"{z:05}.tif").write_bytes(bytes(368) + vol[z].tobytes())
    rows = surfaces.image_rows(spark, f"file://{tmp_path}/*.tif", 7)
    assert {(r.z, r.y): r["values"] for r in rows.collect()} == {(z, y): vol[z, y].tolist() for z in range(3) for y in range(5)}
    pts = spark.createDataFrame([(1, 2.5, 1.5, 0.5), (2, -9.0, 99.0, 2.0), (3, None, 1.0, 1.0)], "id int, x double, y double, z double")
    got = {r.id: r.value for r in surfaces.sample(pts, rows, 3, 5, 7).collect()}
    assert got == {1: vol[0, 2, 2], 2: vol[2, 4, 0], 3: None}
    few = surfaces.image_rows(spark, f"file://{tmp_path}/*.tif", 7, y0=1, y1=2)
    assert {r.id: r.value for r in surfaces.sample(pts, few, 3, 5, 7).collect()}[1] is None


def test_survey_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(1, 0, 0, 200, 0), (1, 0, 1, 200, 3), (0, 0, 0, 1, 1)], "z long, y long, x long, pred long, ct long")
    p, root = support.planes(v), f"file://{tmp_path}"
    surveys.write(p, root, "one_l2", threshold=127)
    surveys.write(p.where("false"), root, "none", threshold=127)
    doc = spark.read.json(f"{root}/survey_one_l2.json").first()
    assert (doc.threshold, doc.planes_sampled, doc.sampled_positives, [r.z for r in doc.per_plane]) == (127, 2, 2, [0, 1])
    assert spark.read.csv(f"{root}/survey_one_l2_planes.csv", header=True).count() == 2
    assert {r.name: r.frac for r in surveys.anchors(spark, f"{root}/survey_*.json").collect()} == {"one": 0.5, "none": 0.0}


def image(a, end="<", rows=2, **other):
    """An uncompressed image file of strips of some rows."""
    h, w = a.shape
    data = a.astype(f"{end}f{a.itemsize}").tobytes()
    strips = [data[i : i + rows * w * a.itemsize] for i in range(0, len(data), rows * w * a.itemsize)]
    offs, at = [], 8
    for s in strips:
        offs.append(at)
        at += len(s)
    lists = struct.pack(f"{end}{len(strips)}I", *offs) + struct.pack(f"{end}{len(strips)}I", *map(len, strips))
    tags = {256: w, 257: h, 258: 8 * a.itemsize, 259: 1, 273: at if len(strips) > 1 else offs[0], 277: 1, 278: rows, 279: at + 4 * len(strips) if len(strips) > 1 else len(strips[0]), 339: 3}
    tags |= {int(k[1:]): v for k, v in other.items()}
    ifd = struct.pack(end + "H", len(tags)) + b"".join(struct.pack(end + "HHII", k, 4, len(strips) if k in (273, 279) else 1, v) for k, v in tags.items())
    return (b"II" if end == "<" else b"MM") + struct.pack(end + "HI", 42, at + len(lists)) + b"".join(strips) + lists + ifd + bytes(4)


@pytest.mark.parametrize(("end", "kind", "rows"), [("<", "f4", 2), (">", "f4", 9), ("<", "f8", 1)])
def test_float_image(end, kind, rows):
    a = np.random.default_rng(3).normal(size=(5, 4)).astype(kind)
    assert (surfaces.float_image(image(a, end, rows)) == a).all()
    for bad in (image(a, end, rows, t259=5), image(a, end, rows, t339=1), b"PNG ....", image(a, end, rows, t322=16)):
        with pytest.raises(ValueError):
            surfaces.float_image(bad)


def test_meshes(spark, tmp_path):
    a = np.random.default_rng(4).uniform(1, 9, (3, 5, 4)).astype(np.float32)
    a[:, 0, 0], a[:, 1, 1], a[0, 2, 2] = 0, -1, np.nan
    for name, meta in (("one", {"scale": [0.05, 0.1]}), ("two", {"scale": 2}), ("three", None)):
        (tmp_path / name).mkdir()
        for c, g in zip("xyz", a):
            (tmp_path / name / f"{c}.tif").write_bytes(image(g))
        if meta:
            (tmp_path / name / "meta.json").write_text(json.dumps(meta))
    (tmp_path / "three" / "z.tif").unlink()
    (tmp_path / "three" / "mask.tif").write_bytes(b"not read")
    got = {(r.mesh.rsplit("/", 1)[1], r.gv, r.gu): r for r in surfaces.meshes(spark, f"file://{tmp_path}").collect()}
    assert len(got) == 60 and [got[m, 0, 1].scale for m in ("one", "two", "three")] == [0.05, 2.0, 1.0]
    assert all((r.x, r.y, r.z) == tuple(a[:, v, u].astype(float)) for (m, v, u), r in got.items() if m == "one" and (v, u) != (2, 2))
    assert {k[1:] for k, r in got.items() if k[0] == "two" and not r.valid} == {(0, 0), (2, 2)}
    assert not any(r.valid for k, r in got.items() if k[0] == "three")
    strict = surfaces.meshes(spark, f"file://{tmp_path}/one", missing="nonpositive")
    assert {(r.gv, r.gu) for r in strict.where("not valid").collect()} == {(0, 0), (1, 1), (2, 2)}
