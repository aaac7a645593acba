"""Sampling of volumes and meshes at points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.frames import nearest
from .order import kept, ranked


def lookup(points: DataFrame, vox: DataFrame, shape: tuple[int, int, int], value: str = "pred") -> DataFrame:
    """points(x, y, z) with the nearest voxel's value: rounded and clipped keys, an equi-join; no voxel: 0."""
    p = points.withColumns({f"k{c}": nearest(F.col(c), n) for c, n in zip("zyx", shape, strict=True)})
    v = vox.select(F.col("z").alias("kz"), F.col("y").alias("ky"), F.col("x").alias("kx"), F.col(value).alias("value"))
    return p.join(v, ["kz", "ky", "kx"], "left").withColumn("value", F.coalesce("value", F.lit(0))).drop("kz", "ky", "kx")


def along_normal(points: DataFrame, offsets: Sequence[float]) -> DataFrame:
    """Each point at each offset along its normal."""
    p = points.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in offsets])))
    return p.withColumns({c: F.col(c) + F.col(f"n{c}") * F.col("t") for c in "xyz"})


def bilinear(at: DataFrame, mesh: DataFrame, height: int | Column, width: int) -> DataFrame:
    """at(id, gv, gu) with x, y, z of the mesh, height x width cells (height may be a column of at).

    Inside, four corners are weighted over the valid ones, null if none weighs. At or
    beyond the last row or column, or below 0, the one cell that the floored place is
    clipped to counts, null if it is not valid. Null places give null.
    """
    rows = height if isinstance(height, Column) else F.lit(height)
    a = at.select("id", F.col("gv").alias("v"), F.col("gu").alias("u"), F.floor("gv").alias("v0"), F.floor("gu").alias("u0"), rows.alias("h"))
    inside = (F.col("v0") >= 0) & (F.col("v0") < F.col("h") - 1) & (F.col("u0") >= 0) & (F.col("u0") < width - 1)
    near = lambda f, i: f if i else 1 - f
    fv, fu = F.col("v") - F.col("v0"), F.col("u") - F.col("u0")
    corners = F.array(*[F.struct((F.col("v0") + i).alias("gv"), (F.col("u0") + j).alias("gu"), (near(fv, i) * near(fu, j)).alias("w")) for i in (0, 1) for j in (0, 1)])
    clip = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0)), n).cast("long")
    one = F.array(F.struct(clip("v0", F.col("h") - 1).alias("gv"), clip("u0", F.lit(width - 1)).alias("gu"), F.lit(1.0).alias("w")))
    known = F.col("v0").isNotNull() & F.col("u0").isNotNull()
    c = a.select("id", F.explode_outer(F.when(known, F.when(inside, corners).otherwise(one))).alias("c")).select("id", "c.*")
    m = c.join(mesh.where("valid"), ["gv", "gu"], "left").withColumn("w", F.when(F.col("valid"), F.col("w")).otherwise(0.0))
    got = m.groupBy("id").agg(*[F.sum(F.col("w") * F.coalesce(k, F.lit(0.0))).alias(f"s{k}") for k in "xyz"], F.sum("w").alias("w"))
    return got.select("id", *[F.when(F.col("w") > 0, F.col(f"s{k}") / F.col("w")).alias(k) for k in "xyz"])


#: A box of more voxels is not read.
MOST_VOXELS = 1.5e9


def boxes(points: DataFrame, key: str, shape: tuple[int, int, int], most: float = MOST_VOXELS) -> DataFrame:
    """Per key the box of voxels (minx, maxx, ...) that its points' nearest voxels span, ends included, and its volume; boxes above `most` voxels are left out."""
    p = points.withColumns({f"k{c}": nearest(F.col(c), n) for c, n in zip("zyx", shape, strict=True)})
    box = p.groupBy(key).agg(*[f(f"k{c}").alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])
    side = lambda c: (F.col(f"max{c}") - F.col(f"min{c}") + 1).cast("double")
    return box.withColumn("volume", side("x") * side("y") * side("z")).where(F.col("volume") <= most)


#: Control points (24 bytes each) that are broadcast; a longer centre line meets the points in a range sort.
MOST_CONTROL = 1_000_000


def interpolate(points: DataFrame, control: DataFrame, most: int = MOST_CONTROL) -> DataFrame:
    """points(z, ...) with cx, cy of the centre line control(z, x, y) at z: linear between control points, held beyond them.

    Up to `most` control points are sorted once and broadcast, and each point finds its
    segment by bisection, without a shuffle. Of control points at one z the least (x, y)
    counts, those without z do not; a point without z, or any point without control
    points, gets nulls.
    """
    line = control.where("z is not null and not isnan(z)").groupBy(F.col("z").cast("double").alias("z")).agg(F.min(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("at")).select("z", "at.x", "at.y")
    keep = [c for c in points.columns if c not in ("cx", "cy")]
    if line.count() > most:
        return _interpolate_sorted(points.select(F.struct(*keep).alias("p")), line)
    rows = line.toArrow().sort_by("z")
    shared = points.sparkSession.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("z", "x", "y")))

    @F.arrow_udf("struct<cx:double,cy:double>")
    def at(z: pa.Array) -> pa.Array:
        zs, *coords = shared.value
        v = z.to_numpy(zero_copy_only=False).astype(np.float64)
        none = np.isnan(v) | (len(zs) == 0)
        if len(zs) == 0:
            got = [np.zeros(len(v))] * 2
        else:
            v = np.clip(np.where(none, zs[0], v), zs[0], zs[-1])
            i = np.searchsorted(zs, v, "right") - 1
            k = np.minimum(i + 1, len(zs) - 1)
            f = np.divide(v - zs[i], zs[k] - zs[i], out=np.zeros(len(v)), where=k > i)
            got = [c[i] + f * (c[k] - c[i]) for c in coords]
        return pa.StructArray.from_arrays([pa.array(g, mask=none) for g in got], names=["cx", "cy"])

    return points.select(*keep, at(F.col("z").cast("double")).alias("_at")).select(*keep, "_at.cx", "_at.cy")


def _interpolate_sorted(packed: DataFrame, line: DataFrame) -> DataFrame:
    """The same for any number of control points: segments and points in one range sort by z, where a point takes the last segment before it, from its own partition or from those before. Points of one z may fill many partitions."""
    c = ranked(line.withColumn("one", F.lit(0)), "one", ["z"])
    after = c.select((F.col("rank") - 1).alias("rank"), F.col("z").alias("z1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    seg = c.join(after, "rank", "left").select("z", F.struct(F.col("z").alias("z0"), F.col("x").alias("x0"), F.col("y").alias("y0"), "z1", "x1", "y1").alias("seg"))
    ends = line.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    z = F.col("p.z").cast("double")
    known = z.isNotNull() & ~F.isnan(z)
    p = packed.where(known).crossJoin(F.broadcast(ends)).select(F.least(F.greatest(z, F.col("lo")), F.col("hi")).alias("z"), "p", F.lit(None).cast(seg.schema["seg"].dataType).alias("seg"), F.xxhash64("p").alias("h"))
    s = seg.select("z", F.lit(None).cast(packed.schema["p"].dataType).alias("p"), "seg", F.lit(None).cast("long").alias("h"))
    # A segment has no hash and so stands before the points of its z.
    both = kept(p.unionByName(s).repartitionByRange("z", "h").sortWithinPartitions("z", "h").withColumn("part", F.spark_partition_id()))
    last = both.where("seg is not null").groupBy("part").agg(F.max_by("seg", "z").alias("seg"))
    parts = both.select("part").distinct().join(last, "part", "left")
    carried = parts.select("part", F.last("seg", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    here = F.last("seg", ignorenulls=True).over(Window.partitionBy("part").orderBy("z", "h").rowsBetween(Window.unboundedPreceding, 0))
    got = both.withColumn("here", here).where("p is not null").join(F.broadcast(carried), "part").select("z", "p", F.coalesce("here", "carried").alias("s"))
    f = F.coalesce((F.col("z") - F.col("s.z0")) / (F.col("s.z1") - F.col("s.z0")), F.lit(0.0))
    on = lambda a: F.col(f"s.{a}0") + f * (F.coalesce(f"s.{a}1", f"s.{a}0") - F.col(f"s.{a}0"))
    none = F.lit(None).cast("double")
    return got.select("p.*", on("x").alias("cx"), on("y").alias("cy")).unionAll(packed.where(~known).select("p.*", none.alias("cx"), none.alias("cy")))


#: Points of one chunk that one task gathers; a chunk of more meets several tasks.
GATHER = 50_000


def lookup_chunks(points: DataFrame, chunks: DataFrame, size: tuple[int, int, int], extent: tuple[int, int, int]) -> DataFrame:
    """points(x, y, z, ...) with `value` of the nearest voxel of a chunk table of this grid; 0 where no chunk is, or a place is null.

    Only chunks that points fall into are shuffled, once for each GATHER of their
    points, and voxels are never rows. Repeated points count each time.
    """
    key = ["_cz", "_cy", "_cx"]
    at = {c: nearest(F.col(c), n) for c, n in zip("zyx", extent, strict=True)}
    p = points.withColumns({f"_k{c}": k for c, k in at.items()}).withColumns({f"_c{c}": F.floor(F.col(f"_k{c}") / n).cast("int") for c, n in zip("zyx", size, strict=True)})
    dim = {c: F.least(F.lit(n), F.lit(e) - F.col(f"_c{c}") * n) for c, n, e in zip("zyx", size, extent, strict=True)}
    inner = {c: F.col(f"_k{c}") - F.col(f"_c{c}") * n for c, n in zip("zyx", size, strict=True)}
    p = p.withColumn("_off", ((inner["z"] * dim["y"] + inner["y"]) * dim["x"] + inner["x"]).cast("int")).select(F.struct(*points.columns).alias("p"), *key, "_off")
    known = p.where("_off is not null")
    parts = known.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / GATHER).cast("int").alias("_parts")).where("_parts > 1")
    dealt = known.join(parts, key, "left").withColumn("_part", F.pmod(F.xxhash64("p"), F.coalesce("_parts", F.lit(1))))
    lists = dealt.groupBy(*key, "_part").agg(F.collect_list("p").alias("ps"), F.collect_list("_off").alias("offs"))
    blocks = chunks.select(*[F.col(c).alias(f"_{c}") for c in ("cz", "cy", "cx")], "data")
    out = StructType([StructField("p", p.schema["p"].dataType), StructField("value", LongType())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.zeros(len(o), np.int64) if d is None else np.frombuffer(d, np.uint8)[o].astype(np.int64) for o, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).flatten(), pa.array(np.concatenate(got) if got else np.zeros(0, np.int64))], names=["p", "value"])

    found = lists.join(blocks, key, "left").select("ps", "offs", "data").mapInArrow(gather, out)
    return found.unionAll(p.where("_off is null").select("p", F.lit(0).cast("long"))).select("p.*", "value")
