"""Windows and keys of stored arrays and image rows, and the array sink's all or nothing."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import chunks
from voxelframe.sources import volumes, zarr

SHAPE, SIZE = (10, 9, 14), (4, 8, 5)


@pytest.fixture(scope="module")
def volume():
    rng = np.random.default_rng(8)
    return (rng.integers(0, 256, SHAPE) * (rng.random(SHAPE) < 0.7)).astype(np.uint8)


@pytest.fixture(scope="module")
def table(spark, volume):
    volumes.register(spark)
    rows = [(int(z), int(y), int(x), int(volume[z, y, x])) for z, y, x in zip(*np.nonzero(volume), strict=True)]
    return chunks.pack(spark.createDataFrame(rows, "z long, y long, x long, v long"), "v", SIZE, SHAPE)


def save(df, path, codec="none", mode="append", chunk=SIZE):
    df.write.format("voxel_array").options(path=f"file://{path}", shape=",".join(map(str, SHAPE)), chunks=",".join(map(str, chunk)), codec=codec).mode(mode).save()


def load(spark, path, **options):
    return spark.read.format("voxel_array").options(path=f"file://{path}", **options).load()


@pytest.mark.parametrize("codec", ["none", "zlib", "zstd"])
def test_arrays_come_back(spark, volume, table, codec, tmp_path):
    save(table, tmp_path / "a", codec)
    got = np.zeros(SHAPE, np.uint8)
    for r in load(spark, tmp_path / "a", span=2).collect():
        got[r.z, r.y, r.x] = r.value
    assert np.array_equal(got, volume)
    path = f"file://{tmp_path}/a"
    whole = {(r.cz, r.cy, r.cx): (r.z0, r.y0, r.x0, list(r.shape), bytes(r.data)) for r in volumes.chunks_of(volumes.chunk_keys(spark, path), path).collect()}
    old = {(r.cz, r.cy, r.cx): (r.z0, r.y0, r.x0, list(r.shape), bytes(r.data)) for r in zarr.read(spark, f"file://{tmp_path}/a").collect()}
    assert whole == old and len(whole) == 18


@pytest.mark.parametrize("windows", [{}, {"z": "5,6"}, {"z": "4,7", "x": ",4"}, {"y": "8,", "x": "6,8"}, {"z": "99,"}, {"z": "-5,99", "y": "3,3"}])
def test_windows_cut_voxels(spark, volume, table, windows, tmp_path):
    save(table, tmp_path / "a")
    spans = [[int(v) if v else d for v, d in zip(windows.get(a, ",").split(","), (0, n), strict=True)] for a, n in zip("zyx", SHAPE, strict=True)]
    want = {(int(z), int(y), int(x), int(volume[z, y, x])) for z, y, x in zip(*np.nonzero(volume), strict=True) if all(lo <= i < hi for i, (lo, hi) in zip((z, y, x), spans, strict=True))}
    d = load(spark, tmp_path / "a", span=2, **windows)
    assert {tuple(r) for r in d.collect()} == want
    assert d.where("z = 5").count() == sum(z == 5 for z, *_ in want) and d.count() == len(want)


def test_filters_and_joins_choose_the_files(spark, volume, table, tmp_path):
    """All files but those that may match are spoilt, so reading one raises."""
    path = tmp_path / "a"
    save(table, path, "zlib")
    for name in os.listdir(path / "0"):
        if name[0].isdigit() and name not in ("1.0.1", "1.0.2"):
            (path / "0" / name).write_bytes(b"spoilt")
    keys = volumes.chunk_keys(spark, f"file://{path}")
    want = sorted((int(z), int(y), int(x), int(volume[z, y, x])) for z, y, x in zip(*np.nonzero(volume), strict=True) if 4 <= z < 8 and y < 8 and x >= 5)
    wanted = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 0, 2), (7, 0, 0), (None, 0, 0)], "cz int, cy int, cx int")
    for some in (keys.where("z1 > 4 and z0 < 8 and y0 < 8 and x1 > 5"), keys.where("cz = 1 and cy = 0 and (x0 = 5 or cx * 2 = 4)"), keys.join(wanted, chunks.KEY, "left_semi"), wanted):
        assert sorted(tuple(r) for r in chunks.unpack(volumes.chunks_of(some, f"file://{path}")).collect()) == want
    assert volumes.chunks_of(keys.where("false"), f"file://{path}").count() == 0
    assert keys.count() == 18
    assert keys.selectExpr("sum((z1 - z0) * (y1 - y0) * (x1 - x0))").first()[0] == volume.size
    assert load(spark, path, z="4,8", y=",8", x="5,").rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="incorrect header|Error -3"):
        load(spark, path).count()


def test_of_raw_chunks_only_the_wanted_planes_are_read(spark, volume, table, tmp_path):
    """The file ends after the third plane: planes 0 to 2 can be read, the fourth cannot."""
    path = tmp_path / "a"
    save(table, path)
    os.truncate(path / "0" / "0.0.0", 3 * SIZE[1] * SIZE[2])
    assert load(spark, path, z=",3", y=",8", x=",5").count() == np.count_nonzero(volume[:3, :8, :5])


def test_an_aborted_write_leaves_no_array(spark, table, tmp_path):
    bad = table.withColumn("shape", F.when(F.col("cz") == 2, F.array(F.lit(1), F.lit(1), F.lit(1))).otherwise(F.col("shape"))).repartition(6)
    with pytest.raises(Exception, match="the array's is"):
        save(bad, tmp_path / "a")
    assert not (tmp_path / "a" / "0" / ".zarray").exists()
    with pytest.raises(Exception, match="FileNotFound|No such file"):
        load(spark, tmp_path / "a").count()
    save(table, tmp_path / "a")
    with pytest.raises(Exception, match="FileExistsError"):
        save(table, tmp_path / "a")
    save(table.where("cz = 0"), tmp_path / "a", mode="overwrite")
    assert load(spark, tmp_path / "a").agg(F.max("z")).first()[0] == 3
    with pytest.raises(Exception, match="three sizes"):
        save(table, tmp_path / "b", codec="lz9")


@pytest.fixture
def stack(tmp_path):
    rows = np.arange(7 * 30 * 6, dtype="<u2").reshape(7, 30, 6)
    for z in range(7):
        if z != 3:
            (tmp_path / f"{z:05}.tif").write_bytes(bytes(16) + rows[z].tobytes())
    (tmp_path / "notes.txt").write_text("no slice")
    return tmp_path, rows


def test_image_rows_by_filters_and_runs(spark, stack):
    path, rows = stack
    volumes.register(spark)
    d = lambda **windows: spark.read.format("image_rows").options(path=f"file://{path}", width=6, header=16, rows_a_task=4, **windows).load()
    got = d(z="2,5", y="10,17").collect()
    assert {(r.z, r.y): r["values"] for r in got} == {(z, y): rows[z, y].tolist() for z in (2, 4) for y in range(10, 17)}
    assert d(z="2,3", y="5,6").rdd.getNumPartitions() == 1 and d().count() == 180
    wanted = spark.createDataFrame([(0, 3), (0, 3), (0, 5), (0, 20), (3, 1), (6, 28), (6, 99), (9, 1), (None, 1)], "z long, y long")
    os.truncate(path / "00000.tif", 16 + 12 * 21)  # what lies behind the last wanted row is not needed
    runs = {(r.z, r.y): r["values"] for r in volumes.row_runs(wanted, f"file://{path}", 6, 16, gap=3).collect()}
    assert runs == {(z, y): rows[z, y].tolist() for z, ys in ((0, (3, 4, 5, 20)), (6, (28,))) for y in ys}
