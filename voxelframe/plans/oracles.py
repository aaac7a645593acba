"""DuckDB SQL of the queries' rows."""

from __future__ import annotations

import math

from ..functions import frames
from ..operators.catalog import PALETTE
from ..operators.stencil import DIFF, SMOOTH
from .file_queries import BOX
from .queries import CHUNK, MATRIX, PLANES, TILE, TILE_VOXELS
from .views import sql

COUNTS = "count(*) FILTER (pred>127) positives, count(*) FILTER (pred>127 AND ct<=0) phantom"
FRAC = "coalesce(round(phantom/nullif(positives,0),6),0)"


def _cubes(size: int, z0: int, where: str) -> str:
    return f"SELECT zc, yc, xc, positives, round(1-phantom/positives,6) support FROM (SELECT (z-{z0})//{size}*{size}+{z0} zc, y//{size}*{size} yc, x//{size}*{size} xc, {COUNTS} FROM vox WHERE {where} GROUP BY 1,2,3) WHERE positives>0"


def _register(x: str, y: str, z: str) -> list[str]:
    (sx, ix), (sy, iy) = frames.line([(a, b) for a, b, _ in frames.DRIFT]), frames.line([(a, c) for a, _, c in frames.DRIFT])
    ca, sa = math.cos(math.radians(frames.ANGLE)), math.sin(math.radians(frames.ANGLE))
    u, cx, cy = f"{frames.UNIT!r}::double", frames.WIDTH / 2, frames.HEIGHT / 2
    zn = f"({frames.Z0}-({z})*{u})"
    qx, qy = f"(({x})*{u}-{cx}-({sx!r}::double*{zn}+({ix!r}::double)))", f"(({y})*{u}-{cy}-({sy!r}::double*{zn}+({iy!r}::double)))"
    return [f"(({frames.WIDTH - 1})-({ca!r}::double*{qx}-({sa!r}::double)*{qy}+{cx}))*32", f"(({sa!r}::double)*{qx}+{ca!r}::double*{qy}+{cy})*32", f"{zn}*32"]


def _key(c: str, n: int) -> str:
    return f"cast(least(greatest(round_even({c},0),0),{n - 1}) as bigint)"


GRID = "gp AS (SELECT vec_id,(x-500)/16 x,(y-500)/16 y,(z-500)/16 z,nx,ny,nz FROM pts)"


def _lookup(src: str, col: str) -> str:
    return f"SELECT p.*, coalesce(q.{col},0) val FROM {src} p LEFT JOIN vox q ON q.z={_key('p.z', 64)} AND q.y={_key('p.y', 64)} AND q.x={_key('p.x', 64)}"


RATIO = "pix AS (SELECT v,u,avg(v53) m53,avg(v70) m70,max(v53) x53,max(v70) x70,bool_or(valid) valid FROM energy GROUP BY v,u), rat AS (SELECT *, ln((m53+1)/(m70+1)) lr FROM pix)"
SAMPLES = f"smp AS (SELECT z, share, CASE WHEN z%4=0 AND positives>0 THEN phantom/positives END frac FROM (SELECT z, avg((ct<=0)::int) share, {COUNTS} FROM vox GROUP BY z)), grid AS (SELECT 1.0::double+i*(24.0::double/3999) k FROM range(4000) t(i)), fit AS (SELECT arg_min(k,(sse,k)) k FROM (SELECT k, sum(pow(1-pow(1-share,k)-frac,2)) sse FROM smp, grid WHERE frac IS NOT NULL GROUP BY k))"
DENSE = "dense AS (SELECT g.v,h.u,coalesce(p.value,0.0::double) AS value FROM range(50) g(v) CROSS JOIN range(40) h(u) LEFT JOIN (SELECT v,u,(sum(v53)%256)::double AS value FROM energy GROUP BY v,u) p ON p.v=g.v AND p.u=h.u)"
MIRROR = "(CASE WHEN {c}<0 THEN -({c}) WHEN {c}>={n} THEN 2*{n}-2-({c}) ELSE {c} END)"
REFLECT = "(CASE WHEN {c}<0 THEN -({c})-1 WHEN {c}>={n} THEN 2*{n}-1-({c}) ELSE {c} END)"
ISLANDS = "isl AS (SELECT y,x,arg_min(m,(abs(m),m)) snap FROM (SELECT y,x,(min(z)+max(z))/2-32 m FROM (SELECT y,x,z,z-row_number() OVER (PARTITION BY y,x ORDER BY z) run FROM vox WHERE pred>127) GROUP BY y,x,run) GROUP BY y,x)"


def _conv(src: str, weights: dict[tuple[int, int], float], agg: str = "sum(w*t.value)", border: str = MIRROR, h: int | str = 50, w: int = 40) -> str:
    rows = ",".join(f"({i},{j},{float(k)!r}::double)" for (i, j), k in weights.items())
    return f"SELECT a.v,a.u,{agg} AS value FROM {src} a CROSS JOIN (VALUES {rows}) k(i,j,w) JOIN {src} t ON t.v={border.format(c='a.v+i', n=h)} AND t.u={border.format(c='a.u+j', n=w)} GROUP BY a.v,a.u"


DU = {(i - 2, j - 2): SMOOTH[i] * DIFF[j] for i in range(5) for j in range(5)}
DV = {(i, j): DU[j, i] for i, j in DU}
GK = [math.exp(-(i * i) / 18.0) for i in range(-12, 13)]
GK = [x / sum(GK) for x in GK]
SEG = "seg AS (SELECT z z0,x x0,y y0,lead(z) OVER (ORDER BY z) z1,lead(x) OVER (ORDER BY z) x1,lead(y) OVER (ORDER BY z) y1 FROM centre), ends AS (SELECT min(z) lo,max(z) hi FROM centre), mid AS (SELECT p.*, x0+coalesce((zc-z0)/(z1-z0),0)*(coalesce(x1,x0)-x0) cx, y0+coalesce((zc-z0)/(z1-z0),0)*(coalesce(y1,y0)-y0) cy FROM (SELECT c.*, least(greatest(z,lo),hi) zc FROM collections c, ends) p JOIN seg ON zc>=z0 AND (zc<z1 OR z1 IS NULL))"
PI2 = f"{2 * math.pi!r}::double"
PI = f"{math.pi!r}::double"
POLAR = f"""{SEG}, po1 AS (SELECT *, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) r, atan2(y-cy,x-cx) a FROM mid),
po2 AS (SELECT *, row_number() OVER w n, a-lag(a) OVER w dd FROM po1 WINDOW w AS (PARTITION BY collection ORDER BY ts,event_id)),
po3 AS (SELECT *, dd+{PI}-floor((dd+{PI})/{PI2})*{PI2}-{PI} m0 FROM po2),
pol AS (SELECT *, a+sum(CASE WHEN abs(dd)<{PI} THEN 0 ELSE coalesce((CASE WHEN m0=-{PI} AND dd>0 THEN {PI} ELSE m0 END)-dd,0) END) OVER (PARTITION BY collection ORDER BY ts,event_id) angle FROM po3)"""
TREND = f"""{POLAR}, cen AS (SELECT *, angle-avg(angle) OVER c da, z-avg(z) OVER c dz, r-avg(r) OVER c dr FROM pol WINDOW c AS (PARTITION BY collection)),
co1 AS (SELECT collection, sum(da*da) aa,sum(dz*dz) zz,sum(da*dz) az,sum(da*dr) ar,sum(dz*dr) zr FROM cen GROUP BY collection),
co AS (SELECT collection, CASE WHEN aa*zz-az*az>1e-9*aa*zz THEN (ar*zz-zr*az)/(aa*zz-az*az) ELSE coalesce(ar/nullif(aa+zz,0),0) END ca, CASE WHEN aa*zz-az*az>1e-9*aa*zz THEN (zr*aa-ar*az)/(aa*zz-az*az) ELSE coalesce(zr/nullif(aa+zz,0),0) END cz FROM co1),
tre AS (SELECT cen.*, ca, cz, dr-ca*da-cz*dz resid FROM cen JOIN co USING (collection))"""
SPREAD = f"""{TREND}, md AS (SELECT collection, median(resid) m FROM tre GROUP BY collection),
spr AS (SELECT collection, count(*) n, median(abs(resid-m))+1e-6 mad, max(abs(resid)) top, median(r) radius_med FROM tre JOIN md USING (collection) GROUP BY collection)"""
NAMED = "row_number() OVER (ORDER BY collection)"


def _mesh_places(places: int) -> str:
    """Points placed on the mesh by its valid corners, or by one cell beyond it."""
    return sql(f", hgt AS (SELECT max(gv)+1 h FROM mesh), att AS (SELECT vec_id id, (x-700)/100 v, (y-700)/12 u, h FROM pts, hgt), ins AS (SELECT *, floor(v)>=0 AND floor(v)<h-1 AND floor(u)>=0 AND floor(u)<49 inner_ FROM att), cor AS (SELECT id, floor(v)+i gv, floor(u)+j gu, (CASE WHEN i=1 THEN v-floor(v) ELSE 1-(v-floor(v)) END)*(CASE WHEN j=1 THEN u-floor(u) ELSE 1-(u-floor(u)) END) w FROM ins, (VALUES (0,0),(0,1),(1,0),(1,1)) c(i,j) WHERE inner_ UNION ALL SELECT id, least(greatest(floor(v),0),h-1), least(greatest(floor(u),0),49), 1.0::double FROM ins WHERE NOT inner_) SELECT id, round(sum(w*m.x)/nullif(sum(w) FILTER (m.valid),0),{places}) x, round(sum(w*m.y)/nullif(sum(w) FILTER (m.valid),0),{places}) y, round(sum(w*m.z)/nullif(sum(w) FILTER (m.valid),0),{places}) z FROM cor LEFT JOIN (SELECT * FROM mesh WHERE valid) m ON m.gv=cor.gv AND m.gu=cor.gu GROUP BY id", "pts", "mesh")


_COLOURS = "".join(f"[{', '.join(str(c[i]) for c in PALETTE)}][(k-1)%6+1]::double {name}, " for i, name in enumerate(("red", "green", "blue")))


def _files(core: dict[str, str], planes: str) -> dict[str, str]:
    """SQL of the queries that go through files."""
    frac = "round(phantom/positives,6) frac"
    axes = ", ".join(f"round({c},6)+0.0 {c}" for c in ("x", "y", "z", "nx", "ny", "nz"))
    inside = " AND ".join(f"{c}>={lo} AND {c}<{hi}" for c, (lo, hi) in zip("zyx", BOX, strict=True))
    ok = "valid AND ((v//10+u//10)%3<>0 OR (v+u)%5=0)"
    clicks = f"hit AS (SELECT b.*, id%7+1 c, CASE WHEN (id%7+1)%2=1 THEN 'same' ELSE 'relative' END kind FROM ({_mesh_places(4)}) b WHERE x IS NOT NULL)"
    lut = "cast(floor(CASE WHEN val<=128 THEN val*0.5 ELSE 64+(val-128)*191.0::double/127 END) as bigint)"
    return {
        "array_survey": sql(planes.format(w=""), "vox"),
        "array_box": sql(f'SELECT z, y, x, pred AS "value" FROM vox WHERE pred>0 AND {inside}', "vox"),
        "array_where": sql(f'SELECT z, y, x, pred AS "value" FROM vox WHERE pred>0 AND {inside}', "vox"),
        "stream_survey": sql(planes.format(w=""), "vox"),
        "array_window": sql(f'SELECT z, y, x, pred AS "value" FROM vox WHERE pred>0 AND {inside}', "vox"),
        "cleaned_array": core["chunk_clean_window"],
        "stack_rows": sql("SELECT z, y, sum(pred)::bigint total FROM vox WHERE z>=5 AND z<20 AND y BETWEEN 8 AND 39 GROUP BY 1,2 HAVING sum(pred)>0", "vox"),
        "array_sample": core["nearest_sample"],
        "points_file": sql(f"SELECT cast(vec_id//20 as int) v, cast(vec_id%20 as int) u, {axes}, (x<>0 OR y<>0 OR z<>0) valid FROM pts WHERE vec_id//20%2=0 AND vec_id%20%2=0", "pts"),
        "image_stack": core["nearest_sample"],
        "mesh_files": sql("SELECT cast(gv as int) gv, cast(gu as int) gu, CASE WHEN valid THEN x ELSE 0 END x, CASE WHEN valid THEN y ELSE 0 END y, CASE WHEN valid THEN z ELSE 0 END z, valid, 0.5::double AS \"scale\" FROM mesh", "mesh"),
        "affine_file": sql("SELECT vec_id, round(" + "+".join(f"{v}*{c}" if c else f"{v}" for v, c in zip(MATRIX[0], ("x", "y", "z", ""), strict=True)) + ",4) x, round(x,4) bx, round(y,4) \"by\", round(z,4) bz FROM pts", "pts"),
        "survey_files": sql(f"SELECT 'Alpha' AS name, {frac} FROM (SELECT {COUNTS} FROM vox) UNION ALL SELECT 'beta', {frac} FROM (SELECT {COUNTS} FROM vox WHERE z%8=0)", "vox"),
        "slab_files": sql(f", p AS (SELECT z, {COUNTS} FROM vox WHERE (z//16)%2=0 GROUP BY 1) SELECT 'slabs' AS mode, 2 slab_stride, 127 threshold, count(*) OVER () planes_sampled, sum(positives) OVER ()::bigint sampled_positives, sum(phantom) OVER ()::bigint sampled_phantom, round(sum(phantom) OVER ()/sum(positives) OVER (),6) sampled_phantom_frac, round(1-sum(phantom) OVER ()/sum(positives) OVER (),6) sampled_support_frac, z, positives, phantom, {FRAC} phantom_frac FROM p", "vox"),
        "cube_files": sql(f"SELECT *, 16 AS \"cube\", 127 threshold, 0.5::double keep_threshold, support>=0.5 keep FROM ({_cubes(16, 0, 'true')})", "vox"),
        "calib_file": sql(f", {SAMPLES}, band AS (SELECT max(abs(frac-(1-pow(1-share,k)))) band FROM smp, fit WHERE frac IS NOT NULL) SELECT z::varchar AS name, round(coalesce(frac,1-pow(1-share,k)),4) est, round(k,3) k, round(band,4) band_abs, round(frac,4) anchor FROM smp, fit, band", "vox"),
        "patch_canvas": sql(f', {RATIO}, pat AS (SELECT v,u,lr,{ok} ok FROM rat), shr AS (SELECT *, avg(ok::int) OVER (PARTITION BY v//10,u//10) share FROM pat) SELECT v AS "row", u col, CASE WHEN ok THEN round(lr,6)+0.0 ELSE 0 END lr, ok covered FROM shr WHERE share>=0.3', "energy"),
        "batch_resume": sql(f""", {RATIO}, job AS (SELECT v//10 pv,u//10 pu,avg(valid::int)>=0.3 ok,count(*) FILTER (valid) n,avg(lr) FILTER (valid) mean,(v//10+u//10)%3=0 broken FROM rat GROUP BY v//10,u//10),
runs AS (SELECT *, 1 AS run, CASE WHEN broken THEN 'failed' WHEN ok THEN 'done' ELSE 'empty' END status FROM job UNION ALL SELECT *, 2, CASE WHEN ok THEN 'done' ELSE 'empty' END FROM job WHERE broken)
SELECT 'patch_'||pv||'_'||pu job, run, status, CASE WHEN status='failed' THEN 'OSError: no answer' END message, CASE WHEN ok THEN round(mean,6)+0.0 END mean, CASE WHEN ok THEN n END n FROM runs""", "energy"),
        "annotate_export": f"WITH {clicks} SELECT kind, cast(dense_rank() OVER (PARTITION BY kind ORDER BY c) as int) k, (CASE WHEN kind='same' THEN 'same_wrap' ELSE 'wraps' END)||c AS name, CASE WHEN kind<>'same' THEN 1 END fill, cast(row_number() OVER (PARTITION BY c ORDER BY id)-1 as int) i, x, y, z, CASE WHEN kind<>'same' THEN c*0.5::double END wind_a FROM hit",
        "constraint_files": f"WITH {clicks} SELECT kind, dense_rank() OVER (PARTITION BY kind ORDER BY c) collection, cast(row_number() OVER (PARTITION BY c ORDER BY id) as int) n, x, y, z FROM hit",
        "export_counts": f"WITH {clicks} SELECT kind, count(DISTINCT c) collections FROM hit GROUP BY 1",
        "mid_layer": sql('SELECT v, u, round(avg(v53),5) m53, round(avg(v70),5) m70 FROM energy WHERE "offset"=4 GROUP BY 1,2', "energy"),
        "projection_u8": sql("SELECT v, u, cast(floor((x53-lo)/greatest(hi-lo,1)*255) as bigint) u8 FROM (SELECT v,u,max(v53) x53 FROM energy GROUP BY 1,2), (SELECT min(m) lo, max(m) hi FROM (SELECT max(v53) m FROM energy GROUP BY v,u))", "energy"),
        "slice_p99": sql("SELECT z, round(quantile_cont(ct,0.99),6) p99 FROM vox GROUP BY 1", "vox"),
        "layer_table": sql(f", {GRID}, go AS (SELECT vec_id, t, x+nx*t x, y+ny*t y, z+nz*t z FROM gp, (VALUES (-1.0::double),(0.0::double),(1.0::double)) o(t)) SELECT vec_id, cast(t+1 as int) layer, {lut} u8 FROM ({_lookup('go', 'pred')})", "pts", "vox"),
    }


SNAP_NORMALS = f"""go AS (SELECT vec_id,t,x+nx*t x,y+ny*t y,z+nz*t z FROM gp, (SELECT (range-12)::double t FROM range(25))),
hit AS (SELECT vec_id,t FROM ({_lookup('go', 'pred')}) WHERE val>127),
run AS (SELECT vec_id,(min(t)+max(t))/2 m FROM (SELECT vec_id,t,t-row_number() OVER (PARTITION BY vec_id ORDER BY t) g FROM hit) GROUP BY vec_id,g),
best AS (SELECT vec_id,arg_min(m,(abs(m),m)) snap FROM run GROUP BY 1)
SELECT vec_id,snap FROM pts LEFT JOIN best USING (vec_id)"""


def _render() -> str:
    """Mesh cells, enlarged pixels, derivatives by joins of shifted pixels, tiles, and samples."""
    axes = "".join(f", s{c} AS (SELECT v,u,hh,{c} AS value FROM px)" for c in "xyz")
    slopes = "".join(f", {c}{d} AS ({_conv('s' + c, w, h='a.hh', w=100)})" for c in "xyz" for d, w in (("u", DU), ("v", DV)))
    ends = ", ".join(f"max(greatest({lo},{hi}))-min(least({lo},{hi}))+1 \"b{c}\"" for c in "xyz" for lo, hi in ((_key(f"{c}-n{c}", 64), _key(f"{c}+n{c}", 64)),))
    value = "cast(floor(CASE WHEN val<=128 THEN val*0.5 ELSE 64+(val-128)*191.0::double/127 END) as bigint)"
    return f"""hgt AS (SELECT max(gv)+1 h FROM mesh),
mm AS (SELECT v,u,h,coalesce(m.x,0)::double x,coalesce(m.y,0)::double y,coalesce(m.z,0)::double z FROM (SELECT h,unnest(range(h)) v FROM hgt) CROSS JOIN (SELECT range u FROM range(50)) LEFT JOIN (SELECT gv,gu,gu+x%3 x,gv%61+x%2 y,x z FROM mesh WHERE valid) m ON m.gv=v AND m.gu=u),
px AS (SELECT ov v,ou u,2*f.h hh,sum(k*x) x,sum(k*y) y,sum(k*z) z FROM (SELECT *,(CASE WHEN i=1 THEN fv-floor(fv) ELSE 1-(fv-floor(fv)) END)*(CASE WHEN j=1 THEN fu-floor(fu) ELSE 1-(fu-floor(fu)) END) k FROM (SELECT h,ov,least(greatest((ov+0.5)/2-0.5,0),h-1)::double fv FROM (SELECT h,unnest(range(2*h)) ov FROM hgt)) CROSS JOIN (SELECT range ou,least(greatest((range+0.5)/2-0.5,0),49)::double fu FROM range(100)) CROSS JOIN (VALUES (0,0),(0,1),(1,0),(1,1)) c(i,j)) f JOIN mm ON mm.v=least(floor(fv)+i,f.h-1) AND mm.u=least(floor(fu)+j,49) GROUP BY ALL){axes}{slopes},
cr AS (SELECT v,u,yu.value*zv.value-zu.value*yv.value a,zu.value*xv.value-xu.value*zv.value b,xu.value*yv.value-yu.value*xv.value c FROM xu JOIN xv USING (v,u) JOIN yu USING (v,u) JOIN yv USING (v,u) JOIN zu USING (v,u) JOIN zv USING (v,u)),
pn AS (SELECT v,u,x,y,z,a/greatest(sqrt(a*a+b*b+c*c),1e-9) nx,b/greatest(sqrt(a*a+b*b+c*c),1e-9) ny,c/greatest(sqrt(a*a+b*b+c*c),1e-9) nz FROM px JOIN cr USING (v,u) WHERE x<>0 OR y<>0 OR z<>0),
til AS (SELECT v//{TILE} tv,u//{TILE} tu,{ends} FROM pn GROUP BY 1,2),
go AS (SELECT v,u,t,x+nx*t x,y+ny*t y,z+nz*t z FROM pn JOIN til ON tv=v//{TILE} AND tu=u//{TILE} AND "bx"*"by"*"bz"<={TILE_VOXELS}, (VALUES (-1.0::double),(0.0::double),(1.0::double)) o(t))
SELECT cast(t+1 as int) layer,v,u,{value} u8 FROM ({_lookup('go', 'pred')})"""


def oracle_sql() -> dict[str, str]:
    planes = f"SELECT z, positives, phantom, {FRAC} phantom_frac FROM (SELECT z, {COUNTS} FROM vox {{w}} GROUP BY z)"
    reg, tip = _register("x", "y", "z"), _register("x+10*nx", "y+10*ny", "z+10*nz")
    step = [f"((({b})-({a}))/10)" for a, b in zip(reg, tip, strict=True)]
    norm = f"greatest(sqrt({'+'.join(f'{c}*{c}' for c in step)}),1e-9)"
    aff = [f"{r[0]}*x+({r[1]})*y+({r[2]})*z+({r[3]})" for r in MATRIX]
    scale = sum(math.sqrt(sum(MATRIX[i][j] ** 2 for i in range(3))) for j in range(3)) / 3
    rot = [f"(({r[0]}*nx+({r[1]})*ny+({r[2]})*nz)/{scale!r}::double)" for r in MATRIX]
    rlen = f"greatest(sqrt({'+'.join(f'{c}*{c}' for c in rot)}),1e-9)"
    box = {(i, j): 1.0 for i in range(-2, 3) for j in range(-2, 3)}
    out = {
        "survey_planes": sql(planes.format(w=""), "vox"),
        "survey_stride": sql(planes.format(w="WHERE z%8=0"), "vox"),
        "survey_planes_list": sql(f"SELECT o.ord, o.z, coalesce(positives,0) positives, coalesce(phantom,0) phantom, {FRAC} phantom_frac FROM (VALUES {','.join(f'({i},{z})' for i, z in enumerate(PLANES))}) o(ord,z) LEFT JOIN (SELECT z, {COUNTS} FROM vox GROUP BY z) USING (z)", "vox"),
        "survey_totals": sql(f"SELECT planes, positives, phantom, {FRAC} phantom_frac, round(1-coalesce(phantom/nullif(positives,0),0),6) support FROM (SELECT count(distinct z) planes, {COUNTS} FROM vox)", "vox"),
        "slab_survey": sql(f"SELECT slab, z, positives, phantom, {FRAC} phantom_frac FROM (SELECT z//16 slab, z, {COUNTS} FROM vox WHERE (z//16)%2=0 GROUP BY 1,2)", "vox"),
        "slab_running_ratio": sql(f"SELECT slab, positives, phantom, {FRAC} running_frac FROM (SELECT slab, cast(sum(positives) OVER (ORDER BY slab) as bigint) positives, cast(sum(phantom) OVER (ORDER BY slab) as bigint) phantom FROM (SELECT z//4 slab, {COUNTS} FROM vox GROUP BY 1))", "vox"),
        "cube_support": sql(_cubes(16, 5, "z>=5 AND z<53"), "vox"),
        "cube_keep_drop": sql(f"SELECT count(*) FILTER (support>=0.5) kept, count(*) FILTER (support<0.5) dropped FROM ({_cubes(16, 0, 'true').replace('round(1-phantom/positives,6)', '1-phantom/positives')})", "vox"),
        "clean_window": sql("SELECT z-5 z, y, x, CASE WHEN ct>0 THEN pred ELSE 0 END pred FROM vox WHERE z>=5 AND z<20", "vox"),
        "lazy_ct_semijoin": sql(_cubes(16, 0, "true"), "vox"),
        "phantom_supported_split": sql("SELECT CASE WHEN pred<=127 THEN 'negative' WHEN ct>0 THEN 'supported' ELSE 'phantom' END kind, count(*) voxels FROM vox GROUP BY 1", "vox"),
        "kfit": sql(f", {SAMPLES} SELECT round(k,6) k FROM fit", "vox"),
        "calib_estimates": sql(f", {SAMPLES} SELECT z, round(share,6) share, round(coalesce(frac,1-pow(1-share,k)),6) est FROM smp, fit", "vox"),
        "calib_residuals": sql(f", {SAMPLES} SELECT round(max(abs(frac-(1-pow(1-share,k)))),6) band, count(*) n FROM smp, fit WHERE frac IS NOT NULL", "vox"),
        "drift_fit": sql("SELECT round(regr_slope(x,z),6) slope, round(regr_intercept(x,z),6) intercept FROM pts", "pts"),
        "register_points": sql("SELECT vec_id, " + ", ".join(f"round({c},4) {k}" for k, c in zip("xyz", reg, strict=True)) + " FROM pts", "pts"),
        "normals_transport": sql("SELECT vec_id, " + ", ".join(f"round({c}/{norm},5)+0.0 n{k}" for k, c in zip("xyz", step, strict=True)) + " FROM pts", "pts"),
        "affine_points": sql("SELECT vec_id, " + ", ".join([f"round({c},5) {k}" for k, c in zip("xyz", aff, strict=True)] + [f"round({c}/{rlen},5)+0.0 n{k}" for k, c in zip("xyz", rot, strict=True)]) + " FROM pts", "pts"),
        "nearest_sample": sql(f", {GRID} SELECT vec_id, val AS value FROM ({_lookup('gp', 'pred')})", "pts", "vox"),
        "sample_offsets": sql(f", {GRID}, go AS (SELECT vec_id, t, x+nx*t x, y+ny*t y, z+nz*t z FROM gp, (VALUES (-4.0::double),(0.0::double),(4.0::double)) o(t)) SELECT vec_id, t, val AS value FROM ({_lookup('go', 'pred')})", "pts", "vox"),
        "dual_sample": sql(f", {GRID} SELECT a.vec_id, a.val a, b.val b, round((a.val+1)/(b.val+1),6) ratio FROM ({_lookup('gp', 'pred')}) a JOIN ({_lookup('gp', 'ct')}) b ON a.vec_id=b.vec_id", "pts", "vox"),
        "depth_mean_max": sql(f", {RATIO} SELECT v,u,round(m53,5) m53,round(m70,5) m70,x53,x70 FROM pix", "energy"),
        "log_ratio": sql(f", {RATIO} SELECT v,u,round(lr,6) lr FROM rat", "energy"),
        "ratio_percentiles": sql(f", {RATIO} SELECT round(quantile_cont(lr,0.02),6) p2, round(quantile_cont(lr,0.98),6) p98 FROM rat", "energy"),
        "zscore_high": sql(f", {RATIO}, st AS (SELECT avg(lr) m, stddev_pop(lr) sd FROM rat WHERE valid), zs AS (SELECT CASE WHEN valid THEN coalesce((lr-m)/nullif(sd,0),0) ELSE 0 END zscore FROM rat, st) SELECT count(*) FILTER (zscore>3) over3, count(*) FILTER (zscore>4) over4, round(max(zscore),5) top FROM zs", "energy"),
        "intensity_stretch": sql(f", {RATIO}, q AS (SELECT quantile_cont(m53,0.02) lo, quantile_cont(m53,0.98) hi FROM rat WHERE valid) SELECT v,u,cast(floor(least(greatest((m53-lo)/greatest(hi-lo,1e-6),0),1)*255) as bigint) u8 FROM rat, q", "energy"),
        "patch_valid_share": sql("SELECT pv,pu,round(share,6) share,n FROM (SELECT v//10 pv,u//10 pu,avg(valid::int) share,count(*) n FROM energy GROUP BY 1,2) WHERE share>=0.3", "energy"),
        "canvas_place": sql("SELECT v+\"offset\"%2*5 AS row, u%20 AS col, arg_max(v53,(\"offset\",v53)) v53 FROM energy GROUP BY 1,2", "energy"),
        "snap_islands": sql(f", {ISLANDS} SELECT y,x,snap FROM isl", "vox"),
        "snap_median5": sql(f", {ISLANDS}, dense AS (SELECT g.v,h.u,coalesce(snap,0.0::double) AS value FROM range(64) g(v) CROSS JOIN range(64) h(u) LEFT JOIN isl ON isl.y=g.v AND isl.x=h.u) {_conv('dense', box, 'median(t.value)', REFLECT, 64, 64)}", "vox"),
        "bbox": sql(f"SELECT *, (maxx-minx+1)::double*(maxy-miny+1)*(maxz-minz+1) volume FROM (SELECT gu//10 tile,"+",".join(f"{f}({_key(c,n)}) {f}{c}" for c,n in (("x",50),("y",2000),("z",100)) for f in ("min","max"))+" FROM mesh WHERE valid GROUP BY 1) WHERE volume<=1.5e9", "mesh"),
        "layer_lut": sql("SELECT cast(floor(CASE WHEN pred<=128 THEN pred*0.5 ELSE 64+(pred-128)*191.0::double/127 END) as bigint) u8, count(*) n FROM vox GROUP BY 1", "vox"),
        "sobel_normals": sql(f", {DENSE} SELECT v,u,a.value du,b.value dv FROM ({_conv('dense', DU)}) a JOIN ({_conv('dense', DV)}) b USING (v,u)", "energy"),
        "surface_normals": sql(f", {DENSE}, " + ", ".join(f"s{c} AS (SELECT v,u,({e})::double AS value FROM dense)" for c, e in (("x", "u*40+v*v"), ("y", "v*50-u*6"), ("z", "value"))) + ", " + ", ".join(f"{c}{d} AS ({_conv('s' + c, w)})" for c in "xyz" for d, w in (("u", DU), ("v", DV))) + ", cr AS (SELECT v,u,yu.value*zv.value-zu.value*yv.value a,zu.value*xv.value-xu.value*zv.value b,xu.value*yv.value-yu.value*xv.value c FROM xu JOIN xv USING (v,u) JOIN yu USING (v,u) JOIN yv USING (v,u) JOIN zu USING (v,u) JOIN zv USING (v,u)) SELECT v,u," + ",".join(f"round({k}/greatest(sqrt(a*a+b*b+c*c),1e-9),5)+0.0 n{n}" for k, n in zip("abc", "xyz", strict=True)) + " FROM cr", "energy"),
        "calib_report": sql(f", {SAMPLES}, band AS (SELECT max(abs(frac-(1-pow(1-share,k)))) band FROM smp, fit WHERE frac IS NOT NULL) SELECT z::varchar AS name, round(share,6) share, round(coalesce(frac,1-pow(1-share,k)),6) est, CASE WHEN frac IS NULL THEN round(band,6) ELSE 0 END band, frac IS NOT NULL measured FROM smp, fit, band", "vox"),
        "calib_ranked": sql(f", {SAMPLES} SELECT row_number() OVER (ORDER BY round(share,2) DESC, z)-1 place, z::varchar AS name, round(share,2) share, frac IS NOT NULL measured FROM smp", "vox"),
        "gaussian_density": sql(f", {DENSE}, hot AS (SELECT v,u,(value>200)::int::double AS value FROM dense), g1 AS ({_conv('hot', {(0, i - 12): x for i, x in enumerate(GK)})}), g2 AS ({_conv('g1', {(i - 12, 0): x for i, x in enumerate(GK)})}) SELECT v,u,round(value/nullif((SELECT max(value) FROM g2),0),5)+0.0 density FROM g2", "energy"),
        "mesh_resize": sql(f", {DENSE}, av AS (SELECT i ov, least(greatest((i+0.5)/2-0.5,0),49)::double f FROM range(100) t(i)), au AS (SELECT i ou, least(greatest((i+0.5)/2-0.5,0),39)::double f FROM range(80) t(i)) SELECT ov,ou,round(sum((CASE WHEN i=1 THEN av.f-floor(av.f) ELSE 1-(av.f-floor(av.f)) END)*(CASE WHEN j=1 THEN au.f-floor(au.f) ELSE 1-(au.f-floor(au.f)) END)*d.value),5) AS value FROM av CROSS JOIN au CROSS JOIN (VALUES (0,0),(0,1),(1,0),(1,1)) c(i,j) JOIN dense d ON d.v=least(floor(av.f)+i,49) AND d.u=least(floor(au.f)+j,39) GROUP BY 1,2", "energy"),
        "bilinear_lookup": _mesh_places(5),
        "centre_interp": sql(f", {SEG} SELECT event_id, round(cx,6) cx, round(cy,6) cy FROM mid", "collections", "centre"),
        "polar_unwrap": sql(f", {POLAR} SELECT event_id, n::int n, round(r,5) r, round(angle,5)+0.0 angle FROM pol", "collections", "centre"),
        "trend_fit": sql(f", {TREND} SELECT collection, round(max(ca),4)+0.0 per_angle, round(max(cz),4)+0.0 per_z, round(sum(resid*resid),4) sse FROM tre GROUP BY 1", "collections", "centre"),
        "outlier_verdict": sql(f", {SPREAD} SELECT collection, n, round(mad,4) mad, round(radius_med,4) radius_med, round(top/(1.4826*mad),4) worst, CASE WHEN top/(1.4826*mad)<12 THEN 'CONSISTENT' ELSE 'SUSPECT' END verdict FROM spr", "collections", "centre"),
        "step_ratio": sql(f", {POLAR}, dif AS (SELECT collection, abs(r-lag(r) OVER (PARTITION BY collection ORDER BY n)) d FROM pol) SELECT collection, round(CASE WHEN count(d)>=4 THEN max(d)/(median(d)+1e-6) ELSE 0 END,4) step_ratio FROM dif GROUP BY 1", "collections", "centre"),
        "changepoint": sql(f", {SPREAD}, jmp AS (SELECT t.collection, k.n k, abs(median(t.resid) FILTER (t.n>k.n)-median(t.resid) FILTER (t.n<=k.n)) j FROM tre k JOIN spr s ON s.collection=k.collection AND s.n>=8 AND k.n BETWEEN 3 AND s.n-4 JOIN tre t ON t.collection=k.collection GROUP BY 1,2), top AS (SELECT collection, max(j) j FROM jmp GROUP BY 1) SELECT spr.collection, round(coalesce(j/(1.4826*mad),0),4) hop FROM spr LEFT JOIN top USING (collection)", "collections", "centre"),
        "row_runs": "WITH r AS (SELECT DISTINCT l_partkey%100 slice, l_orderkey*7%9414 AS row FROM lineitem), n AS (SELECT *, (row-lag(row) OVER (PARTITION BY slice ORDER BY row)>64)::int nw FROM r), g AS (SELECT *, cast(sum(coalesce(nw,0)) OVER (PARTITION BY slice ORDER BY row) as bigint) run FROM n) SELECT slice, run, min(row) lo, max(row) hi, count(*) n FROM g GROUP BY 1,2",
        "constraint_export": sql(f", k AS (SELECT collection, row_number() OVER (ORDER BY collection) k FROM (SELECT DISTINCT collection FROM collections)) SELECT collection, true spelled, collection::varchar id, 'same'||k AS name, {_COLOURS} false absolute, i, i created, round(x,3)+0.0 x, round(y,3)+0.0 y, round(z,3)+0.0 z, NULL::double wind_a FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY ts,event_id) i FROM collections) JOIN k USING (collection)", "collections"),
        "canvas_overlap": sql(f", {RATIO} SELECT arow AS \"row\", acol col, arg_max(r,fname) lr, arg_max(valid,fname) covered FROM (SELECT v//10*10+v%5 arow, u//10*10+u%5 acol, 'patch_v'||(v-v%5)||'_u'||(u-u%5)||'.npz' fname, CASE WHEN valid THEN round(lr,6)+0.0 ELSE 0 END r, valid FROM rat) GROUP BY 1,2", "energy"),
        "constraint_import": sql("SELECT collection, row_number() OVER (PARTITION BY collection ORDER BY ts,event_id)::int n, round(x,3)+0.0 x, round(y,3)+0.0 y, round(z,3)+0.0 z FROM collections", "collections"),
        "discover_pairs": "WITH l AS (SELECT regexp_extract(url,'([a-z]+\\.[a-z]+)/',1) sample, url, page_id FROM pages), p AS (SELECT sample, arg_min(url,page_id) preds FROM l WHERE starts_with(url,'https://') GROUP BY 1), c AS (SELECT sample, arg_min(url,page_id) ct FROM l WHERE starts_with(url,'http://') GROUP BY 1) SELECT sample, preds, ct, CASE WHEN regexp_extract(preds,'page=(\\d)',1)='' THEN '2' ELSE regexp_extract(preds,'page=(\\d)',1) END AS level FROM p JOIN c USING (sample)",
        "prefix_listing": "SELECT page_id, count(*) n, min(x) AS first FROM (SELECT page_id, unnest(regexp_extract_all(html,'<p>([^<]+)</p>',1)) x FROM pages) GROUP BY 1",
        "resume_jobs": "SELECT c_custkey job FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F')",
        "chunk_survey": sql(planes.format(w=""), "vox"),
        "chunk_support": sql(f"SELECT z//{CHUNK[0]} cz, y//{CHUNK[1]} cy, x//{CHUNK[2]} cx, count(*) FILTER (pred>127) positives, round(1-(count(*) FILTER (pred>127 AND ct<=0))/(count(*) FILTER (pred>127)),6) support FROM vox GROUP BY 1,2,3 HAVING count(*) FILTER (pred>127)>0", "vox"),
        "chunk_clean": sql("SELECT z, y, x, pred AS \"value\" FROM vox WHERE ct>0 AND pred>0", "vox"),
        "chunk_rechunk": sql(planes.format(w=""), "vox"),
        "chunk_clean_window": sql("SELECT z-5 z, y, x, pred AS \"value\" FROM vox WHERE ct>0 AND pred>0 AND z>=5 AND z<40", "vox"),
        "snap_normals": sql(f", {GRID}, {SNAP_NORMALS}", "pts", "vox"),
        "render_mesh": sql(f", {_render()}", "mesh", "vox"),
        "batch_status": "SELECT o_orderstatus, count(*) jobs FROM orders GROUP BY 1",
        "priority_order": "SELECT c_name, 0 tier, c_custkey::varchar AS at FROM customer WHERE c_mktsegment='BUILDING' UNION ALL SELECT c_name, 1, c_name FROM customer WHERE c_name NOT IN (SELECT c_name FROM customer WHERE c_mktsegment='BUILDING')",
        "surface_stride": "SELECT p_partkey%50 u, p_partkey//50 v, p_retailprice FROM part WHERE p_partkey//50 >=1 AND (p_partkey//50-1)%4=0 AND (p_partkey%50)%5=0",
    }
    out["snap_microns"] = f"SELECT round(median(s.value)*9.6,6)+0.0 microns FROM ({out['snap_median5']}) s"
    out |= _files(out, planes)
    return {k: v.replace(") , ", "), ") for k, v in out.items()}
