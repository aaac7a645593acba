"""Named queries over the given tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import frames
from ..operators import calibrate, catalog, chunks, energy, order, patches, rays, sampling, snap, stencil, support, winding
from . import views as V

QUERIES: dict[str, Callable] = {}
PLANES = (3, 7, 3, 50)
#: A chunk grid that leaves partial blocks at the far edges of 64^3.
CHUNK = (16, 24, 24)
#: Cells on a side of the grids' blocks, small so that these grids have several.
SIDE = 16
#: A fixed 3 x 4 test matrix.
MATRIX = [[0.9, 0.1, 0.0, 5.0], [-0.1, 0.95, 0.05, -3.0], [0.0, 0.02, 1.1, 7.0]]


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Float sums depend on their order; both sides round. Adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in cols})


@query
def survey_planes(s, d):
    return rounded(support.planes(V.vox(s, d)), "phantom_frac")


@query
def survey_stride(s, d):
    return rounded(support.planes(support.stride(V.vox(s, d), 8)), "phantom_frac")


@query
def survey_planes_list(s, d):
    return rounded(support.plane_list(V.vox(s, d), PLANES), "phantom_frac")


@query
def survey_totals(s, d):
    return rounded(support.totals(V.vox(s, d)), "phantom_frac", "support")


@query
def slab_survey(s, d):
    return rounded(support.slabs(V.vox(s, d), 16, 2), "phantom_frac")


@query
def slab_running_ratio(s, d):
    return rounded(support.running(support.slabs(V.vox(s, d), 4, 1)), "running_frac")


@query
def cube_support(s, d):
    return rounded(support.cubes(V.vox(s, d), 16, 5, 40), "support")


@query
def cube_keep_drop(s, d):
    return support.keep_drop(support.cubes(V.vox(s, d), 16), 0.5)


@query
def clean_window(s, d):
    return support.clean(V.vox(s, d), 5, 20)


@query
def lazy_ct_semijoin(s, d):
    v = V.vox(s, d)
    return rounded(support.lazy_cubes(v.select("z", "y", "x", "pred"), v.where("ct > 0").select("z", "y", "x", "ct"), 16), "support")


@query
def phantom_supported_split(s, d):
    p = support.positive()
    kind = F.when(~p, "negative").when(F.col("ct") > 0, "supported").otherwise("phantom")
    return V.vox(s, d).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("voxels"))


def _samples(s, d):
    """Planes as samples: the share of voxels without scan, and every fourth one's phantom fraction as its anchor."""
    v = V.vox(s, d).groupBy("z").agg(F.avg((F.col("ct") <= 0).cast("double")).alias("share"), *support.counts())
    return v.select("z", "share", F.when((F.col("z") % 4 == 0) & (F.col("positives") > 0), support.fraction()).alias("frac"))


@query
def kfit(s, d):
    return rounded(calibrate.fit(_samples(s, d).where("frac is not null")), "k")


@query
def calib_estimates(s, d):
    t = _samples(s, d)
    return rounded(calibrate.estimates(t, calibrate.fit(t.where("frac is not null"))).select("z", "share", "est"), "share", "est")


@query
def calib_residuals(s, d):
    t = _samples(s, d).where("frac is not null")
    return rounded(calibrate.residuals(t, calibrate.fit(t)), "band")


@query
def calib_report(s, d):
    t = _samples(s, d).withColumn("name", F.col("z").cast("string"))
    return rounded(calibrate.report(t, calibrate.fit(t.where("frac is not null"))), "share", "est", "band")


@query
def calib_ranked(s, d):
    """The report by falling share, equal ones in the order of the planes."""
    t = _samples(s, d).withColumn("name", F.col("z").cast("string"))
    r = calibrate.report(t, calibrate.fit(t.where("frac is not null"))).withColumn("share", F.round("share", 2))
    return calibrate.ranked(r.withColumn("z", F.col("name").cast("long")), "z").select("place", "name", "share", "measured")


@query
def drift_fit(s, d):
    return rounded(V.pts(s, d).agg(F.regr_slope("x", "z").alias("slope"), F.regr_intercept("x", "z").alias("intercept")), "slope", "intercept")


@query
def register_points(s, d):
    x, y, z = frames.register(F.col("x"), F.col("y"), F.col("z"))
    return rounded(V.pts(s, d).select("vec_id", x.alias("x"), y.alias("y"), z.alias("z")), "x", "y", "z", places=4)


@query
def normals_transport(s, d):
    """Normals into the new frame by a finite difference of ten voxels."""
    p = [F.col(c) for c in "xyz"]
    tip = [F.col(c) + 10 * F.col(f"n{c}") for c in "xyz"]
    step = [(b - a) / 10 for a, b in zip(frames.register(*p), frames.register(*tip), strict=True)]
    return rounded(V.pts(s, d).select("vec_id", *[c.alias(f"n{k}") for k, c in zip("xyz", frames.unit(*step), strict=True)]), "nx", "ny", "nz", places=5)


@query
def affine_points(s, d):
    a = frames.affine(MATRIX, F.col("x"), F.col("y"), F.col("z"))
    n = frames.rotate(MATRIX, F.col("nx"), F.col("ny"), F.col("nz"))
    return rounded(V.pts(s, d).select("vec_id", *[c.alias(k) for k, c in zip(("x", "y", "z", "nx", "ny", "nz"), [*a, *n], strict=True)]), "x", "y", "z", "nx", "ny", "nz", places=5)


def _grid_points(s, d):
    return V.pts(s, d).select("vec_id", *[((F.col(c) - 500) / 16).alias(c) for c in "xyz"], "nx", "ny", "nz")


def _packed(s, d, *values):
    v = V.vox(s, d)
    return {c: chunks.pack(v, c, CHUNK, (64, 64, 64)) for c in values}


@query
def nearest_sample(s, d):
    return sampling.lookup_chunks(_grid_points(s, d), _packed(s, d, "pred")["pred"], CHUNK, (64, 64, 64)).select("vec_id", "value")


@query
def sample_offsets(s, d):
    got = rays.sampled(_grid_points(s, d), _packed(s, d, "pred"), (-4, 0, 4), CHUNK, (64, 64, 64))
    return got.select("vec_id", F.posexplode("pred").alias("i", "value")).select("vec_id", (F.col("i") * 4.0 - 4.0).alias("t"), F.col("value").cast("long").alias("value"))


@query
def dual_sample(s, d):
    """Both volumes in one gather."""
    got = rays.sampled(_grid_points(s, d), _packed(s, d, "pred", "ct"), (0,), CHUNK, (64, 64, 64))
    a, b = (F.col(c)[0].cast("long") for c in ("pred", "ct"))
    return rounded(got.select("vec_id", a.alias("a"), b.alias("b"), ((a + 1) / (b + 1)).alias("ratio")), "ratio")


@query
def depth_mean_max(s, d):
    return rounded(energy.depth(V.energy(s, d)).drop("valid"), "m53", "m70", places=5)


def _ratio(s, d):
    return energy.log_ratio(energy.depth(V.energy(s, d)))


@query
def log_ratio(s, d):
    return rounded(_ratio(s, d).select("v", "u", "lr"), "lr")


@query
def ratio_percentiles(s, d):
    return rounded(order.percentiles(_ratio(s, d), [], "lr", {"p2": 0.02, "p98": 0.98}), "p2", "p98")


@query
def zscore_high(s, d):
    z = energy.zscores(_ratio(s, d))
    return z.agg(F.count_if(F.col("zscore") > 3).alias("over3"), F.count_if(F.col("zscore") > 4).alias("over4"), F.round(F.max("zscore"), 5).alias("top"))


@query
def intensity_stretch(s, d):
    return energy.stretch(_ratio(s, d), "m53").select("v", "u", "u8")


def _patches(s, d):
    return V.energy(s, d).groupBy(F.floor(F.col("v") / 10).alias("pv"), F.floor(F.col("u") / 10).alias("pu"))


@query
def patch_valid_share(s, d):
    share = F.avg(F.col("valid").cast("double"))
    return rounded(_patches(s, d).agg(share.alias("share"), F.count(F.lit(1)).alias("n")).where("share >= 0.3"), "share")


@query
def canvas_place(s, d):
    """Patches on one canvas; where they overlap the later one (larger offset, then value) stays."""
    e = V.energy(s, d).select((F.col("v") + F.col("offset") % 2 * 5).alias("row"), (F.col("u") % 20).alias("col"), "offset", "v53", "v70")
    return e.groupBy("row", "col").agg(F.max_by("v53", F.struct("offset", "v53")).alias("v53"))


@query
def snap_islands(s, d):
    return snap.islands(V.vox(s, d).where(support.positive()), 32)


@query
def snap_median5(s, d):
    """Snaps on the full (y, x) grid, missing as 0, then the 5 x 5 median."""
    got = snap.islands(V.vox(s, d).where(support.positive()), 32).select(F.col("y").alias("v"), F.col("x").alias("u"), F.col("snap").alias("value"))
    return stencil.median5(got, 64, 64, SIDE)


@query
def snap_microns(s, d):
    """The median of the smoothed snap field in micrometres."""
    mid = order.percentiles(snap_median5(s, d), [], "value", {"mid": 0.5})
    return rounded(mid.select(frames.microns(F.col("mid")).alias("microns")), "microns")


@query
def bbox(s, d):
    """Bounding box of each tile's valid points; tiles without one are skipped."""
    m = V.mesh(s, d).where("valid").withColumn("tile", F.floor(F.col("gu") / 10))
    return sampling.boxes(m, "tile", (100, 2000, 50))


@query
def layer_lut(s, d):
    return V.vox(s, d).select(frames.contrast(F.col("pred")).alias("u8")).groupBy("u8").agg(F.count(F.lit(1)).alias("n"))


def _plane(s, d):
    """A dense 50 x 40 grid of mean intensities."""
    return V.energy(s, d).groupBy("v", "u").agg((F.sum("v53") % 256).cast("double").alias("value"))


def _dense(s, d):
    g = s.range(50).select(F.col("id").alias("v")).crossJoin(s.range(40).select(F.col("id").alias("u")))
    return g.join(_plane(s, d), ["v", "u"], "left").fillna(0.0, ["value"])


@query
def sobel_normals(s, d):
    """Derivatives of the dense map along u and v."""
    return stencil.sobel(_plane(s, d), 50, 40, SIDE)


@query
def surface_normals(s, d):
    """Normals of the surface that the dense map is over its grid, warped so that all three parts vary."""
    g = _dense(s, d).select("v", "u", (F.col("u") * 40 + F.col("v") * F.col("v")).alias("x"), (F.col("v") * 50 - F.col("u") * 6).alias("y"), F.col("value").alias("z"))
    return rounded(stencil.normals(g, 50, 40, SIDE), "nx", "ny", "nz", places=5)


@query
def gaussian_density(s, d):
    """Blurred map of high pixels, over its maximum."""
    hot = _plane(s, d).withColumn("value", (F.col("value") > 200).cast("double"))
    g = stencil.gaussian(hot, 50, 40, size=SIDE)
    return rounded(g.crossJoin(F.broadcast(g.agg(F.max("value").alias("top")))).select("v", "u", F.try_divide("value", "top").alias("density")), "density", places=5)


@query
def mesh_resize(s, d):
    return rounded(stencil.resize(_plane(s, d), 50, 40, 2, SIDE), "value", places=5)


@query
def bilinear_lookup(s, d):
    at = V.pts(s, d).select(F.col("vec_id").alias("id"), ((F.col("x") - 700) / 100).alias("gv"), ((F.col("y") - 700) / 12).alias("gu"))
    m = V.mesh(s, d)
    at = at.crossJoin(F.broadcast(m.agg((F.max("gv") + 1).alias("height"))))
    return rounded(sampling.bilinear(at, m, F.col("height"), 50), "x", "y", "z", places=5)


@query
def centre_interp(s, d):
    return rounded(sampling.interpolate(V.collections(s, d), V.centre(s, d)).select("event_id", "cx", "cy"), "cx", "cy")


def _polar(s, d):
    return winding.polar(V.collections(s, d), V.centre(s, d))


@query
def polar_unwrap(s, d):
    return rounded(_polar(s, d).select("event_id", "n", "r", "angle"), "r", "angle", places=5)


@query
def trend_fit(s, d):
    t = winding.trend(_polar(s, d))
    return rounded(t.groupBy("collection").agg(F.max("ca").alias("per_angle"), F.max("cz").alias("per_z"), F.sum(F.col("resid") * F.col("resid")).alias("sse")), "per_angle", "per_z", "sse", places=4)


@query
def outlier_verdict(s, d):
    return rounded(winding.spread(winding.trend(_polar(s, d))), "mad", "worst", "radius_med", places=4)


@query
def step_ratio(s, d):
    return rounded(winding.step_ratio(_polar(s, d)), "step_ratio", places=4)


@query
def changepoint(s, d):
    t = winding.trend(_polar(s, d))
    return rounded(winding.changepoint(t, winding.spread(t)), "hop", places=4)


@query
def row_runs(s, d):
    t = V.table(s, d, "lineitem").select((F.col("l_partkey") % 100).alias("slice"), (F.col("l_orderkey") * 7 % 9414).alias("row"))
    return snap.split_runs(t, "slice", "row", 64)


@query
def constraint_export(s, d):
    """Every field of the exported JSON, and whether it spells out the null that readers need."""
    j = catalog.export(V.collections(s, d)).withColumn("spelled", F.contains("json", F.lit('"wind_a":null')))
    j = j.select("collection", "spelled", F.explode(F.from_json("json", catalog.CONSTRAINTS)["collections"]).alias("id", "c"))
    j = j.select("collection", "spelled", "id", "c.name", *[F.col("c.color")[i].alias(k) for i, k in enumerate(("red", "green", "blue"))], F.col("c.metadata.winding_is_absolute").alias("absolute"), F.explode("c.points").alias("i", "p"))
    point = [F.col("p.creation_time").alias("created"), *[F.col("p.p")[i].alias(c) for i, c in enumerate("xyz")], F.col("p.wind_a").alias("wind_a")]
    return rounded(j.select("collection", "spelled", "id", "name", "red", "green", "blue", "absolute", F.col("i").cast("long").alias("i"), *point), "x", "y", "z", places=3)


@query
def constraint_import(s, d):
    return rounded(catalog.load(catalog.export(V.collections(s, d))), "x", "y", "z", places=3)


@query
def discover_pairs(s, d):
    p = V.table(s, d, "pages").select(F.regexp_extract("url", r"([a-z]+\.[a-z]+)/", 1).alias("sample"), F.col("url").alias("prefix"), F.col("page_id").alias("ord"))
    return catalog.discover(p, F.col("prefix").startswith("https://"), F.col("prefix").startswith("http://"), r"page=(\d)")


@query
def prefix_listing(s, d):
    p = V.table(s, d, "pages")
    return catalog.prefixes(p.select("page_id", F.col("html").alias("text")), "page_id", "<p>([^<]+)</p>").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("prefix").alias("first"))


@query
def resume_jobs(s, d):
    done = V.table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("job"))
    return catalog.pending(V.table(s, d, "customer").select(F.col("c_custkey").alias("job")), done, "job")


@query
def batch_status(s, d):
    return V.table(s, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("jobs"))


@query
def priority_order(s, d):
    """Names of the list first, in its order; the rest sorted."""
    c = V.table(s, d, "customer").select("c_name", (F.col("c_mktsegment") == "BUILDING").alias("listed"), "c_custkey")
    first = c.where("listed").select("c_name", F.lit(0).alias("tier"), F.col("c_custkey").cast("string").alias("at"))
    rest = c.join(first.select("c_name"), "c_name", "left_anti").select("c_name", F.lit(1).alias("tier"), F.col("c_name").alias("at"))
    return first.unionAll(rest)


@query
def surface_stride(s, d):
    p = V.table(s, d, "part").select((F.col("p_partkey") % 50).alias("u"), F.floor(F.col("p_partkey") / 50).alias("v"), "p_retailprice")
    return p.where((F.col("v") >= 1) & ((F.col("v") - 1) % 4 == 0) & (F.col("u") % 5 == 0))


def _chunked(s, d):
    v = V.vox(s, d)
    return [chunks.pack(v, c, CHUNK, (64, 64, 64)) for c in ("pred", "ct")]


@query
def chunk_survey(s, d):
    return rounded(chunks.planes(*_chunked(s, d)), "phantom_frac")


@query
def chunk_support(s, d):
    return rounded(chunks.cubes(*_chunked(s, d)), "support")


@query
def chunk_clean(s, d):
    return chunks.unpack(chunks.clean(*_chunked(s, d)))


@query
def chunk_rechunk(s, d):
    """The scan comes in other chunks and is brought to the prediction's."""
    v = V.vox(s, d)
    ct = chunks.rechunk(chunks.pack(v, "ct", (24, 10, 64), (64, 64, 64)), CHUNK, (64, 64, 64))
    return rounded(chunks.planes(chunks.pack(v, "pred", CHUNK, (64, 64, 64)), ct), "phantom_frac")


@query
def chunk_clean_window(s, d):
    """Planes 5 to 39 cleaned, counted from 0."""
    return chunks.unpack(chunks.rechunk(chunks.clean(*_chunked(s, d)), (8, 32, 32), (35, 64, 64), first=5))


@query
def snap_normals(s, d):
    """How far along its normal each point has the nearest run of predicted voxels, 12 steps both ways."""
    return rays.snapped(_grid_points(s, d), chunks.pack(V.vox(s, d), "pred", CHUNK, (64, 64, 64)), CHUNK, (64, 64, 64), reach=12).select("vec_id", "snap")


#: Pixels on a side of a rendered tile, and voxels that its box may have.
TILE, TILE_VOXELS = 16, 24_000


@query
def render_mesh(s, d):
    """Three layers of a mesh, enlarged twice, as contrasted bytes; tiles of too large a box are skipped."""
    m = V.mesh(s, d).where("valid").select("gv", "gu", (F.col("gu") + F.col("x") % 3).alias("x"), (F.col("gv") % 61 + F.col("x") % 2).alias("y"), F.col("x").alias("z"))
    h = V.mesh(s, d).agg(F.max("gv") + 1).first()[0] or 0
    got = rays.render(rays.surface(m, h, 50, 2, SIDE), chunks.pack(V.vox(s, d), "pred", CHUNK, (64, 64, 64)), 1, CHUNK, (64, 64, 64), TILE, TILE_VOXELS)
    return got.select("layer", "v", "u", frames.contrast(F.col("value")).alias("u8"))


@query
def canvas_overlap(s, d):
    """Patches at corners 5 apart on a canvas of patches 10 wide: the last file name wins where they overlap."""
    p = _ratio(s, d).select((F.col("v") - F.col("v") % 5).alias("v0"), (F.col("u") - F.col("u") % 5).alias("u0"), (F.col("v") % 5).alias("pv"), (F.col("u") % 5).alias("pu"), "lr", "valid")
    return rounded(patches.canvas(p, 10, 10), "lr")


def queries() -> dict[str, Callable]:
    return dict(QUERIES)
