"""Core queries against DuckDB, golden values, and properties of the operators."""

from __future__ import annotations

import math

import duckdb
import pytest

from voxelframe.functions import frames
from pyspark.sql import functions as F

from voxelframe.operators import calibrate, catalog, energy, sampling, snap, stencil, support, winding
from voxelframe.plans import views as V
from voxelframe.plans.oracles import oracle_sql
from voxelframe.plans.queries import QUERIES, _samples

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def same(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = same(map(tuple, df.select(*cols).collect()))
    r = duck.execute(oracle_sql()[name])
    at = [x[0] for x in r.description]
    want = same(tuple(x[at.index(c)] for c in cols) for x in r.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and abs(x - y) <= 2e-4 * max(1, abs(y)) for x, y in zip(a, b, strict=True)), (a, b)


def test_registration_golden(spark):
    p = spark.createDataFrame([(1700.0, 1775.0, 4889.0)], "x double, y double, z double")
    got = p.select(*frames.register(p.x, p.y, p.z)).first()
    assert got == pytest.approx((8169.3656390685, 7864.0400815602, 17672.3741044679), abs=1e-6)
    assert frames.line([(a, b) for a, b, _ in frames.DRIFT]) == pytest.approx((-0.0152380952, -58.6), abs=1e-6)


def test_calibration_golden(spark):
    """16 anchors of known share and fraction made by k = 3.3 are fitted by the nearest grid point."""
    rows = [(0.02 + 0.05 * i, 1 - (1 - (0.02 + 0.05 * i)) ** 3.3) for i in range(16)]
    k = calibrate.fit(spark.createDataFrame(rows, "share double, frac double")).first().k
    assert abs(k - 3.3) < 24 / 3999


def test_survey_edges(spark):
    v = spark.createDataFrame([(0, 0, 0, 127, 5), (0, 0, 1, 128, 0), (1, 0, 0, 3, 0)], "z long, y long, x long, pred long, ct long")
    got = {r.z: (r.positives, r.phantom, r.phantom_frac) for r in support.planes(v).collect()}
    assert got == {0: (1, 1, 1.0), 1: (0, 0, 0.0)}
    assert support.totals(v.where("z = 1")).first().support == 1.0
    assert support.cubes(v, 16).count() == 1
    assert support.totals(v.where("false")).first().planes == 0


def test_clean_is_idempotent(spark):
    v = spark.createDataFrame([(z, 0, x, 10 * x, (x + z) % 2) for z in range(4) for x in range(5)], "z long, y long, x long, pred long, ct long")
    once = support.clean(v, 1, 3)
    again = support.clean(support.align(once, v.selectExpr("z - 1 z", "y", "x", "ct")), 0, 2)
    assert sorted(once.collect()) == sorted(again.collect())


def test_snap_ties_go_to_the_earlier_run(spark):
    hits = spark.createDataFrame([(0, 0, 2), (0, 0, 6), (1, 0, 3), (1, 0, 4)], "y long, x long, z long")
    assert {r.y: r.snap for r in snap.islands(hits, 4).collect()} == {0: -2.0, 1: -0.5}


def test_run_gap_of_64_is_not_split(spark):
    rows = spark.createDataFrame([(0, 0), (0, 64), (0, 129)], "k long, r long")
    assert snap.split_runs(rows, "k", "r").count() == 2


def test_interpolation_is_held_beyond_the_ends(spark):
    c = spark.createDataFrame([(10.0, 1.0, 2.0), (20.0, 3.0, 4.0)], "z double, x double, y double")
    p = spark.createDataFrame([(5.0,), (15.0,), (99.0,)], "z double")
    assert sorted((r.z, r.cx, r.cy) for r in sampling.interpolate(p, c).collect()) == [(5.0, 1.0, 2.0), (15.0, 2.0, 3.0), (99.0, 3.0, 4.0)]


def test_trend_of_degenerate_paths(spark):
    rows = [("one", 1, 5.0, 0.1, 3.0), ("flat", 1, 1.0, 0.0, 2.0), ("flat", 2, 2.0, 0.5, 2.0), ("flat", 3, 3.0, 1.0, 2.0)]
    p = spark.createDataFrame(rows, "collection string, n int, r double, angle double, z double")
    v = {r.collection: r for r in winding.spread(winding.trend(p)).collect()}
    assert v["one"].worst == 0 and v["flat"].worst < 1e-3 and v["flat"].verdict == "CONSISTENT"


def test_constraints_keep_null_fields(spark):
    p = spark.createDataFrame([(7, 1, 1, 1.0, 2.0, 3.0)], "collection long, event_id long, ts long, x double, y double, z double")
    out = catalog.export(p)
    assert '"wind_a":null' in out.first().json
    assert [(r.collection, r.n, r.x) for r in catalog.load(out).collect()] == [(7, 1, 1.0)]


def test_whole_mesh_is_used(spark):
    """At sf0.01 the mesh has 40 rows: points beyond its fourth row and grid rows from 30 on count."""
    d = DATA.replace("0.001", "0.01")
    mesh = {(r.gv, r.gu): (r.x, r.y, r.z) for r in V.mesh(spark, d).where("valid").collect()}
    got = {r.id: r for r in QUERIES["bilinear_lookup"](spark, d).collect()}
    points = V.pts(spark, d).collect()
    assert len(got) == len(points) and sum((p.x - 700) / 100 > 3 for p in points) > 10
    for p in points:
        v, u = (p.x - 700) / 100, (p.y - 700) / 12
        v0, u0 = math.floor(v), math.floor(u)
        if 0 <= v0 < 39 and 0 <= u0 < 49:
            corners = [((v0 + i, u0 + j), (v - v0 if i else 1 - v + v0) * (u - u0 if j else 1 - u + u0)) for i in (0, 1) for j in (0, 1)]
        else:  # one snapped cell or none
            corners = [((min(max(v0, 0), 39), min(max(u0, 0), 49)), 1.0)]
        total = sum(w for at, w in corners if at in mesh)
        for k, name in enumerate("xyz"):
            want = sum(w * mesh[at][k] for at, w in corners if at in mesh) / total if total else None
            assert got[p.vec_id][name] == (want if want is None else pytest.approx(want, abs=2e-5))
    rows = [(r.v, r.u) for r in QUERIES["surface_stride"](spark, d).collect()]
    assert sorted(rows) == [(v, u) for v in range(1, 40, 4) for u in range(0, 50, 5)]


def test_calibration_takes_all_grid_points(spark):
    k = QUERIES["kfit"](spark, DATA).first().k
    rows = {r.z: r for r in _samples(spark, DATA).collect()}
    anchors = [r for r in rows.values() if r.frac is not None]
    grid = [1 + 24 / 3_999 * i for i in range(4_000)]
    assert k == pytest.approx(min(grid, key=lambda k: (sum((1 - (1 - r.share) ** k - r.frac) ** 2 for r in anchors), k)), abs=2e-6)
    model = lambda r: 1 - (1 - r.share) ** k
    for r in QUERIES["calib_estimates"](spark, DATA).collect():
        at = rows[r.z]
        assert r.est == pytest.approx(model(at) if at.frac is None else at.frac, abs=2e-6)
    assert QUERIES["calib_residuals"](spark, DATA).first().band == pytest.approx(max(abs(r.frac - model(r)) for r in anchors), abs=2e-6)


def test_lookup_beyond_the_mesh_takes_one_cell(spark):
    """x = 10 v + u on a 3 x 4 mesh; (0.5, -1) is beyond it and snaps to the cell (0, 0)."""
    mesh = spark.createDataFrame([(v, u, 10.0 * v + u, 1.0, 2.0, (v, u) != (2, 3)) for v in range(3) for u in range(4)], "gv long, gu long, x double, y double, z double, valid boolean")
    at = spark.createDataFrame([(0, 0.5, -1.0), (1, 0.5, 1.5), (2, 9.0, 9.0), (3, 1.5, 3.5), (4, None, 1.0), (5, 1.5, 2.5)], "id long, gv double, gu double")
    got = {r.id: r.x for r in sampling.bilinear(at, mesh, 3, 4).collect()}
    assert got[0] == 0 and got[1] == 6.5 and got[2] is None and got[3] == 13 and got[4] is None
    assert got[5] == pytest.approx((12 + 13 + 22) / 3)


def test_box_counts_all_three_sides(spark):
    p = spark.createDataFrame([("a", 1.2, 2.5, 3.5), ("a", 4.0, 99.0, 5.0), ("b", 0.0, 0.0, -7.0)], "tile string, x double, y double, z double")
    got = {r.tile: (r.minx, r.maxx, r.miny, r.maxy, r.minz, r.maxz, r.volume) for r in sampling.boxes(p, "tile", (10, 50, 10)).collect()}
    assert got == {"a": (1, 4, 2, 49, 4, 5, 4.0 * 48 * 2), "b": (0, 0, 0, 0, 0, 0, 1.0)}
    assert sampling.boxes(p, "tile", (10, 50, 10), most=100).count() == 1


def test_scores_and_stretch_of_odd_maps(spark):
    rows = [(0, 0, 1.0, True), (0, 1, 3.0, True), (0, 2, float("nan"), True), (0, 3, 99.0, False), (0, 4, None, True)]
    p = spark.createDataFrame(rows, "v long, u long, lr double, valid boolean")
    assert {r.u: r.zscore for r in energy.zscores(p).collect()} == {0: -1.0, 1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    flat = spark.createDataFrame([(0, u, 5.0, True) for u in range(3)] + [(0, 9, 500.0, False)], "v long, u long, m53 double, valid boolean")
    assert {r.u: r.u8 for r in energy.stretch(flat, "m53").collect()} == {0: 0, 1: 0, 2: 0, 9: 255}


def test_normals_of_a_plane(spark):
    """The plane (u, v, 2 u) has the normal (-2, 0, 1) / sqrt(5) away from the mirrored border."""
    g = spark.createDataFrame([(v, u, float(u), float(v), 2.0 * u) for v in range(9) for u in range(9)], "v long, u long, x double, y double, z double")
    r = stencil.normals(g, 9, 9).where("v = 4 and u = 4").first()
    assert (r.nx, r.ny, r.nz) == pytest.approx((-2 / 5**0.5, 0, 1 / 5**0.5))


def test_discovery_takes_the_first_of_each_kind(spark):
    rows = [("s", f"r/{x}.zarr/", i) for i, x in enumerate(("other", "m7-L3-b", "m7-L1-a", "masked-2", "masked-1"))] + [("t", "r/m7-L1.zarr/", 9)]
    d = spark.createDataFrame(rows, "sample string, prefix string, ord int")
    got = catalog.discover(d, F.col("prefix").contains("m7"), F.col("prefix").contains("masked"), r"m7-L(\d)").collect()
    assert [tuple(r) for r in got] == [("s", "r/m7-L3-b.zarr/", "r/masked-2.zarr/", "3")]
