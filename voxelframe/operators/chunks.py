"""Volumes as tables of chunks: dense blocks of unsigned bytes in C order.

A chunk row is cz, cy, cx, z0, y0, x0, shape, data. One row is one block, so memory
is bounded by the chunk size. What joins shuffle are masks of one bit a voxel, not
the blocks. A missing chunk, or null data, counts as zeros. Columns beside these are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import THRESHOLD, fraction

KEY = ["cz", "cy", "cx"]
PLACE = ["z0", "y0", "x0", "shape"]
SCHEMA = "cz int, cy int, cx int, z0 int, y0 int, x0 int, shape array<int>, data binary"
_HEAD = "cz int, cy int, cx int, z0 int, shape array<int>"


def _block(data: bytes | None, shape: list[int]) -> np.ndarray:
    return (np.zeros(int(np.prod(shape)), np.uint8) if data is None else np.frombuffer(data, np.uint8)).reshape(shape)


def _bits(bits: bytes | None, shape: list[int]) -> np.ndarray:
    n = int(np.prod(shape))
    return (np.zeros(n, bool) if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)).reshape(shape)


def pack(vox: DataFrame, value: str, size: tuple[int, int, int], extent: tuple[int, int, int]) -> DataFrame:
    """Chunks of a voxel table (z, y, x, value of 0..255) of the given extent; blocks at the far edges are smaller. Of repeated voxels the largest value stays; a null value is 0."""
    at = {c: F.floor(F.col(c) / n).cast("int") for c, n in zip("zyx", size, strict=True)}
    d = vox.where(" and ".join(f"{c} >= 0 and {c} < {e}" for c, e in zip("zyx", extent, strict=True)))
    dim = {c: F.least(F.lit(n), F.lit(e) - at[c] * n) for c, n, e in zip("zyx", size, extent, strict=True)}
    inner = {c: F.col(c) % n for c, n in zip("zyx", size, strict=True)}
    off = (inner["z"] * dim["y"] + inner["y"]) * dim["x"] + inner["x"]
    d = d.select(*[at[c].alias(f"c{c}") for c in "zyx"], off.cast("int").alias("off"), F.coalesce(value, F.lit(0)).cast("int").alias("value"))
    g = d.groupBy(*KEY).agg(F.collect_list("off").alias("offs"), F.collect_list("value").alias("vals"))
    start = [(F.col(f"c{c}") * n).alias(f"{c}0") for c, n in zip("zyx", size, strict=True)]
    shape = F.array(*[F.least(F.lit(n), F.lit(e) - F.col(f"c{c}") * n) for c, n, e in zip("zyx", size, extent, strict=True)])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for shp, offs, vals in zip(*(b.column(i).to_pylist() for i in (6, 7, 8)), strict=True):
                block = np.zeros(int(np.prod(shp)), np.uint8)
                np.maximum.at(block, np.array(offs), np.array(vals, np.uint8))
                out.append(block.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(out, pa.binary())], names=[*KEY, *PLACE, "data"])

    return g.select(*KEY, *start, shape.alias("shape"), "offs", "vals").mapInArrow(fill, SCHEMA)


def unpack(chunks: DataFrame) -> DataFrame:
    """z, y, x, value of the voxels that are not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z0, y0, x0, shp, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block = _block(data, shp)
                z, y, x = np.nonzero(block)
                yield pa.RecordBatch.from_arrays([pa.array(z + z0), pa.array(y + y0), pa.array(x + x0), pa.array(block[z, y, x].astype(np.int64))], names=["z", "y", "x", "value"])

    return chunks.select(*PLACE, "data").mapInArrow(run, "z long, y long, x long, value long")


def rechunk(chunks: DataFrame, size: tuple[int, int, int], extent: tuple[int, int, int], first: int = 0) -> DataFrame:
    """Chunks of another grid: planes from `first` on become z = 0, 1, ..., and what lies outside the extent goes.

    Only pieces that are not all 0 are shuffled, by the new block's key; the pieces of
    one block hold no more than the block, unless chunks overlap, where the largest
    value stays. Blocks of zeros have no row; an empty table gives none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z0, y0, x0, shp, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block, at, rows = _block(data, shp), (z0 - first, y0, x0), []
                spans = [(max(a, 0), min(a + n, e)) for a, n, e in zip(at, shp, extent, strict=True)]
                for key in product(*[range(lo // c, -(-hi // c)) for (lo, hi), c in zip(spans, size, strict=True)]):
                    lo = [max(s[0], k * c) for s, k, c in zip(spans, key, size, strict=True)]
                    hi = [min(s[1], (k + 1) * c) for s, k, c in zip(spans, key, size, strict=True)]
                    piece = block[tuple(slice(p - a, q - a) for p, q, a in zip(lo, hi, at, strict=True))]
                    if piece.any():
                        rows.append([*key, [p - k * c for p, k, c in zip(lo, key, size, strict=True)], list(piece.shape), piece.tobytes()])
                types = [*[pa.int32()] * 3, *[pa.list_(pa.int32())] * 2, pa.binary()]
                cols = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=[*KEY, "at", "dims", "part"])

    def paste(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for shp, pieces in zip(b.column(6).to_pylist(), b.column(7).to_pylist(), strict=True):
                block = np.zeros(shp, np.uint8)
                for p in pieces:
                    into = block[tuple(slice(a, a + n) for a, n in zip(p["at"], p["dims"], strict=True))]
                    np.maximum(into, _block(p["part"], p["dims"]), out=into)
                out.append(block.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(out, pa.binary())], names=[*KEY, *PLACE, "data"])

    parts = chunks.select(*PLACE, "data").where("data is not null").mapInArrow(cut, "cz int, cy int, cx int, at array<int>, dims array<int>, part binary")
    g = parts.groupBy(*KEY).agg(F.collect_list(F.struct("at", "dims", "part")).alias("pieces"))
    start = [(F.col(k) * n).alias(p) for k, p, n in zip(KEY, PLACE[:3], size, strict=True)]
    shape = F.array(*[F.least(F.lit(n), F.lit(e) - F.col(k) * n) for k, n, e in zip(KEY, size, extent, strict=True)])
    return g.select(*KEY, *start, shape.alias("shape"), "pieces").mapInArrow(paste, SCHEMA)


def mask(chunks: DataFrame, above: int) -> DataFrame:
    """One bit a voxel: value > above. Null where no voxel is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = [_block(d, s) > above for s, d in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([np.packbits(m).tobytes() if m.any() else None for m in blocks], pa.binary())], names=[*KEY, "z0", "shape", "bits"])

    return chunks.select(*KEY, "z0", "shape", "data").mapInArrow(run, f"{_HEAD}, bits binary")


def counts(preds: DataFrame, ct: DataFrame, thr: int = THRESHOLD) -> DataFrame:
    """cz, cy, cx, z, positives, phantom: one row a plane of each chunk of preds. Both volumes lie on one chunk grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cz, cy, cx, z0, shp, p, c in zip(*(col.to_pylist() for col in b.columns), strict=True):
                pos = _bits(p, shp)
                phantom = pos & ~_bits(c, shp)
                key = [pa.array(np.full(shp[0], k, np.int32)) for k in (cz, cy, cx)]
                yield pa.RecordBatch.from_arrays([*key, pa.array(np.arange(z0, z0 + shp[0])), pa.array(pos.sum((1, 2))), pa.array(phantom.sum((1, 2)))], names=[*KEY, "z", "positives", "phantom"])

    scan = mask(ct, 0).where("bits is not null").select(*KEY, F.col("bits").alias("scan"))
    both = mask(preds, thr).join(scan, KEY, "left").select(*KEY, "z0", "shape", "bits", "scan")
    return both.mapInArrow(run, "cz int, cy int, cx int, z long, positives long, phantom long")


def planes(preds: DataFrame, ct: DataFrame, thr: int = THRESHOLD) -> DataFrame:
    """z, positives, phantom, phantom_frac, as support.planes of the voxels."""
    return counts(preds, ct, thr).groupBy("z").agg(F.sum("positives").alias("positives"), F.sum("phantom").alias("phantom")).withColumn("phantom_frac", fraction())


def cubes(preds: DataFrame, ct: DataFrame, thr: int = THRESHOLD) -> DataFrame:
    """Support of each chunk that has positives."""
    c = counts(preds, ct, thr).groupBy(*KEY).agg(F.sum("positives").alias("positives"), F.sum("phantom").alias("phantom")).where("positives > 0")
    return c.select(*KEY, "positives", (1 - fraction()).alias("support"))


def clean(preds: DataFrame, ct: DataFrame) -> DataFrame:
    """Chunks of preds with 0 where the scan is 0; other values stay as they are, below the threshold too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in (6, 7, 8)), strict=True)
            out = [np.where(_bits(bits, shp), _block(data, shp), 0).astype(np.uint8).tobytes() for shp, data, bits in rows]
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(out, pa.binary())], names=[*KEY, *PLACE, "data"])

    scan = mask(ct, 0).where("bits is not null").select(*KEY, "bits")
    return preds.select(*KEY, *PLACE, "data").join(scan, KEY, "left").select(*KEY, *PLACE, "data", "bits").mapInArrow(run, SCHEMA)
