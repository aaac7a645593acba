"""Rays through chunked volumes: samples along normals, what they snap to, and layers of a surface.

A ray is a row of points(x, y, z, nx, ny, nz, ...). Each goes once to every chunk that its
samples fall into, not once a sample; several volumes on one grid are read in one gather.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from . import grids
from .chunks import KEY
from .grids import BLOCK, REPEAT
from .sampling import MOST_VOXELS
from .stencil import cross

#: Pieces of rays that one task gathers from one chunk; a chunk of more meets several tasks.
GATHER = 10_000
_AXES, _NORMALS = ("z", "y", "x"), ("nz", "ny", "nx")


def _cut(offsets: np.ndarray, size: tuple[int, int, int], extent: tuple[int, int, int]):
    """Rays -> pieces: the ray, a chunk, the numbers of the samples in it (16-bit) and their places in the chunk's block (32-bit). A ray with a null place goes whole to no chunk (nulls)."""
    grid = [-(-e // s) for e, s in zip(extent, size, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, along = (np.stack([b.column(i + k).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(3)])[:, :, None] for k in (1, 4))
            place = at + along * offsets[None, None, :]
            fine = np.isfinite(place).all(axis=(0, 2))
            place = np.where(fine[None, :, None], place, 0)
            v = [np.clip(np.rint(p), 0, e - 1).astype(np.int64) for p, e in zip(place, extent, strict=True)]
            c = [p // s for p, s in zip(v, size, strict=True)]
            # Blocks at the far edges are smaller.
            dim = [np.minimum(s, e - k * s) for k, s, e in zip(c, size, extent, strict=True)]
            inner = [p - k * s for p, k, s in zip(v, c, size, strict=True)]
            off = ((inner[0] * dim[1] + inner[1]) * dim[2] + inner[2]).astype(np.int32)
            chunk = (c[0] * grid[1] + c[1]) * grid[2] + c[2]
            chunk[~fine] = -1
            order = np.argsort(chunk, axis=1, kind="stable")
            sorted_ = np.take_along_axis(chunk, order, 1)
            new = np.c_[np.ones(len(chunk), bool), sorted_[:, 1:] != sorted_[:, :-1]].reshape(-1)
            first = np.flatnonzero(new)
            ends = np.r_[first[1:], new.size]
            row, key = first // len(offsets), sorted_.reshape(-1)[first]
            nth, offs = order.astype(np.int16).reshape(-1), np.take_along_axis(off, order, 1).reshape(-1)
            none = key < 0
            keys = [pa.array(k.astype(np.int32), mask=none) for k in (key // (grid[1] * grid[2]), key // grid[2] % grid[1], key % grid[2])]
            parts = [pa.array([a[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary()) for a in (nth, offs)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *keys, *parts], names=["p", *KEY, "nth", "off"])

    return run


def sampled(points: DataFrame, volumes: dict[str, DataFrame], offsets: Sequence[float], size: tuple[int, int, int], extent: tuple[int, int, int]) -> DataFrame:
    """points with an array a volume: the nearest voxel (rounded half to even, clipped) at each offset along the normal.

    The volumes are chunk tables of one grid; 0 where no chunk is, and everywhere on a
    ray with a null or non-finite place. Repeated rows come back each. What shuffles
    are the rays, once a chunk that they cross, with 6 bytes a sample, the chunks that
    any ray crosses, and the samples back, 3 bytes each and volume.
    """
    names, at = list(volumes), np.array(offsets, float)
    p = points.select(F.struct(*points.columns).alias("p"), *[F.col(c).cast("double") for c in (*_AXES, *_NORMALS)])
    kind = p.schema["p"].dataType
    key_fields = [StructField(k, IntegerType()) for k in KEY]
    pieces = p.mapInArrow(_cut(at, size, extent), StructType([StructField("p", kind), *key_fields, StructField("nth", BinaryType()), StructField("off", BinaryType())]))
    known = pieces.where("cz is not null")
    hot = known.groupBy(*KEY).agg(F.ceil(F.count(F.lit(1)) / GATHER).cast("int").alias("_parts")).where("_parts > 1")
    dealt = known.join(hot, KEY, "left").withColumn("_part", F.pmod(F.xxhash64("p"), F.coalesce("_parts", F.lit(1))))
    lists = dealt.groupBy(*KEY, "_part").agg(F.collect_list(F.struct("p", "nth", "off")).alias("rays"))
    blocks = None
    for name, chunks in volumes.items():
        one = chunks.where("data is not null").select(*KEY, F.col("data").alias(name))
        blocks = one if blocks is None else blocks.join(one, KEY, "full")
    met = lists.join(blocks, KEY, "left").select("rays", *[F.col(n).alias(f"_{i}") for i, n in enumerate(names)])
    vals = [StructField(f"_{i}", BinaryType()) for i in range(len(names))]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                rays = b.column(0).slice(row, 1).flatten()
                blocks = [None if (d := b.column(i + 1)[row].as_py()) is None else np.frombuffer(d, np.uint8) for i in range(len(names))]
                nth = rays.field("nth")
                offs = [np.frombuffer(o, np.int32) for o in rays.field("off").to_pylist()]
                got = [pa.array([bytes(len(o)) if blk is None else blk[o].tobytes() for o in offs], pa.binary()) for blk in blocks]
                yield pa.RecordBatch.from_arrays([rays.field("p"), nth, *got], names=["p", "nth", *[f"_{i}" for i in range(len(names))]])

    back = met.mapInArrow(gather, StructType([StructField("p", kind), StructField("nth", BinaryType()), *vals]))
    nowhere = pieces.where("cz is null").select("p", "nth", *[F.lit(None).cast("binary").alias(f"_{i}") for i in range(len(names))])
    whole = back.unionAll(nowhere).groupBy("p").agg(F.collect_list(F.struct("nth", *[f"_{i}" for i in range(len(names))])).alias("got"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], [[] for _ in names]
            for i, got in enumerate(b.column(1).to_pylist()):
                values = np.zeros((len(names), len(at)), np.int32)
                copies = 0
                for piece in got:
                    nth = np.frombuffer(piece["nth"], np.int16)
                    copies += int((nth == 0).any())
                    for k in range(len(names)):
                        if (v := piece[f"_{k}"]) is not None:
                            values[k, nth] = np.frombuffer(v, np.uint8)
                rows += [i] * copies
                for k in range(len(names)):
                    out[k] += [values[k]] * copies
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *[pa.array(o, pa.list_(pa.int32())) for o in out]], names=["p", *[f"_{i}" for i in range(len(names))]])

    done = whole.mapInArrow(merge, StructType([StructField("p", kind), *[StructField(f"_{i}", ArrayType(IntegerType())) for i in range(len(names))]]))
    return done.select("p.*", *[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])


def nearest_runs(hits: np.ndarray) -> np.ndarray:
    """Per row of hits (rays x samples) the centre of the run of hits nearest to the middle sample, counted from it; of two equally near the earlier one. NaN without a hit."""
    mid = hits.shape[1] // 2
    step = np.diff(np.pad(hits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1] - 1
    m = (start + end) / 2 - mid
    order = np.lexsort((m, np.abs(m), row))
    out = np.full(len(hits), np.nan)
    first = order[np.r_[True, np.diff(row[order]) != 0]] if len(row) else order
    out[row[first]] = m[first]
    return out


def snapped(points: DataFrame, chunks: DataFrame, size: tuple[int, int, int], extent: tuple[int, int, int], reach: int = 40, above: int = 127) -> DataFrame:
    """points with `snap`: how far along its normal, in steps of its length, the middle of the nearest run of voxels above `above` lies, within `reach` steps both ways; null where none is."""
    got = sampled(points, {"_hits": chunks}, range(-reach, reach + 1), size, extent)

    @F.arrow_udf("double")
    def snap(values: pa.Array) -> pa.Array:
        m = nearest_runs(values.flatten().to_numpy().reshape(len(values), -1) > above) if len(values) else np.zeros(0)
        return pa.array(m, mask=np.isnan(m))

    return got.withColumn("snap", snap("_hits")).drop("_hits")


def surface(mesh: DataFrame, h: int, w: int, up: int, size: int = BLOCK) -> DataFrame:
    """v, u, x, y, z, nx, ny, nz of the pixels of a mesh(gv, gu, x, y, z) enlarged `up` times (bilinear), with unit normals by 5 x 5 derivatives of the enlarged coordinates; pixels of all zeros have no row.

    Absent cells are zeros. Enlarging and derivatives are one kernel, so mesh cells are
    shuffled, not the `up` squared times as many pixels.
    """

    def kernel(arrays, edges):
        wide = [_mirrored(_enlarged(a, up), edges) for a in arrays]
        return [*[a[2:-2, 2:-2] for a in wide], *cross(*wide)]

    out = grids.apply(mesh.select(F.col("gv").alias("v"), F.col("gu").alias("u"), "x", "y", "z"), h, w, ["x", "y", "z"], 3, REPEAT, kernel, ["x", "y", "z", "nx", "ny", "nz"], size, up, edges=True)
    return out.where("x <> 0 or y <> 0 or z <> 0")


def _enlarged(a: np.ndarray, up: int) -> np.ndarray:
    """Bilinear enlargement of an array with a halo of three cells, down to a halo of two pixels."""
    for axis in (0, 1):
        at = (np.arange(-2, (a.shape[axis] - 6) * up + 2) + 0.5) / up + 2.5
        i = np.floor(at).astype(int)
        f = (at - i).reshape((-1, 1) if axis == 0 else (1, -1))
        a = np.take(a, i, axis) * (1 - f) + np.take(a, i + 1, axis) * f
    return a


def _mirrored(a: np.ndarray, edges: tuple[bool, bool, bool, bool]) -> np.ndarray:
    """At the image's own edges (top, bottom, left, right) the halo of two pixels is the mirror of the pixels inside."""
    top, bottom, left, right = (2 * e for e in edges)
    return np.pad(a[top : a.shape[0] - bottom, left : a.shape[1] - right], ((top, bottom), (left, right)), mode="reflect")


def render(pixels: DataFrame, chunks: DataFrame, layers: int, size: tuple[int, int, int], extent: tuple[int, int, int], tile: int = 150, most: float = MOST_VOXELS) -> DataFrame:
    """layer (0 .. 2 layers), v, u, value of each pixel(v, u, x, y, z, nx, ny, nz) at one voxel's spacing along its normal.

    Tiles of tile x tile pixels whose samples span a box of more than `most` voxels are
    skipped. All layers of a pixel come from one gather, of the chunks that it crosses.
    """
    ends = {c: [F.least(F.greatest(F.rint(F.col(c) + F.col(f"n{c}") * float(k)), F.lit(0.0)), F.lit(float(n - 1))) for k in (-layers, layers)] for c, n in zip(_AXES, extent, strict=True)}
    tiled = pixels.withColumns({"_tv": F.floor(F.col("v") / tile), "_tu": F.floor(F.col("u") / tile)})
    # Along a ray every coordinate runs one way, so its ends bound the box.
    side = [F.max(F.greatest(*e)) - F.min(F.least(*e)) + 1 for e in ends.values()]
    large = tiled.groupBy("_tv", "_tu").agg((side[0] * side[1] * side[2]).alias("_box")).where(F.col("_box") > most)
    some = tiled.join(large, ["_tv", "_tu"], "left_anti").drop("_tv", "_tu")
    got = sampled(some, {"_layers": chunks}, range(-layers, layers + 1), size, extent)
    return got.select("v", "u", F.posexplode("_layers").alias("layer", "value")).select("layer", "v", "u", F.col("value").cast("long").alias("value"))
