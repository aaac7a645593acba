"""Kernels on blocks of a dense grid with a halo: each cell is shuffled once, and once more for each block whose border it is near."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells on a block's side. A block with its halo is what one kernel holds.
BLOCK = 256
#: Cells that a task holds back to send them on in larger pieces.
HELD = 1 << 20
#: Border rules: the edge is repeated, or it is the mirror and is not.
REPEAT, MIRROR = "symmetric", "reflect"

Kernel = Callable[..., Sequence[np.ndarray]]


def _pieces(h: int, w: int, size: int, reach: int):
    """Cells -> pieces (bv, bu, at, values): for each block that has a cell in its halo window, the cells' places in the window and their values."""
    tall, wide = -(-h // size), -(-w // size)
    side = size + 2 * reach

    def send(v: np.ndarray, u: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        blocks, places, picked = [], [], []
        for dv in (-1, 0, 1):
            for du in (-1, 0, 1):
                bv, bu = v // size + dv, u // size + du
                iv, iu = v - bv * size + reach, u - bu * size + reach
                ok = np.flatnonzero((bv >= 0) & (bv < tall) & (bu >= 0) & (bu < wide) & (iv >= 0) & (iv < side) & (iu >= 0) & (iu < side))
                blocks.append((bv * wide + bu)[ok])
                places.append((iv * side + iu)[ok])
                picked.append(ok)
        block, place, pick = map(np.concatenate, (blocks, places, picked))
        order = np.argsort(block, kind="stable")
        block, place, pick = block[order], place[order].astype(np.int32), pick[order]
        at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, int)
        ends = np.r_[at[1:], len(block)]
        rows = [(place[a:b].tobytes(), np.ascontiguousarray(values[:, pick[a:b]]).tobytes()) for a, b in zip(at, ends, strict=True)]
        if rows:
            key = block[at]
            yield pa.RecordBatch.from_arrays([pa.array((key // wide).astype(np.int32)), pa.array((key % wide).astype(np.int32)), *[pa.array(list(c), pa.binary()) for c in zip(*rows, strict=True)]], names=["bv", "bu", "at", "vals"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            cells = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns])
            inside = (cells[0] >= 0) & (cells[0] < h) & (cells[1] >= 0) & (cells[1] < w)
            held.append(cells[:, inside])
            if sum(x.shape[1] for x in held) >= HELD:
                whole = np.concatenate(held, axis=1)
                held.clear()
                yield from send(whole[0].astype(np.int64), whole[1].astype(np.int64), whole[2:])
        if held:
            whole = np.concatenate(held, axis=1)
            yield from send(whole[0].astype(np.int64), whole[1].astype(np.int64), whole[2:])

    return run


def apply(grid: DataFrame, h: int, w: int, values: Sequence[str], reach: int, border: str, kernel: Kernel, out: Sequence[str], size: int = BLOCK, up: int = 1, names: tuple[str, str] = ("v", "u"), edges: bool = False) -> DataFrame:
    """names[0], names[1] and the columns `out` (double) of every cell of a grid of h x w.

    grid(v, u, *values) has a row a cell; cells without a row, and null values, are 0;
    of repeated cells the largest value of each column counts; cells outside go. The
    kernel gets an array a value, of a block with `reach` more cells on each side, the
    border rule applied beyond the grid, and returns an array an output, of the block
    (`up` times as many cells on each side). With `edges` it is also told whether the
    block lies at the grid's top, bottom, left and right. Memory is bounded by the block.
    """
    if not 0 <= reach <= size:
        raise ValueError("the halo must not be wider than a block")
    tall, wide, side = -(-h // size), -(-w // size), size + 2 * reach
    spark = grid.sparkSession
    sent = grid.select(F.col("v").cast("double"), F.col("u").cast("double"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in values]).where("v is not null and u is not null")
    pieces = sent.mapInArrow(_pieces(h, w, size, reach), "bv int, bu int, at binary, vals binary")
    # Blocks without a cell have a result too.
    every = spark.range(tall * wide).select(F.floor(F.col("id") / wide).cast("int").alias("bv"), (F.col("id") % wide).cast("int").alias("bu"), F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("vals"))
    blocks = pieces.unionAll(every).groupBy("bv", "bu").agg(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "vals"))).alias("pieces"))
    n = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bv, bu, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.full((n, side * side), -np.inf)
                for p in parts:
                    at = np.frombuffer(p["at"], np.int32)
                    mine = np.frombuffer(p["vals"], np.float64).reshape(n, -1)
                    for k in range(n):
                        np.maximum.at(x[k], at, mine[k])
                x = np.where(np.isneginf(x), 0.0, x).reshape(n, side, side)
                v0, u0 = bv * size, bu * size
                dv, du = min(size, h - v0), min(size, w - u0)
                # What the window has of the grid; the rest is the border rule's.
                lo, hi = (min(reach, v0), min(reach, u0)), (min(reach, h - v0 - dv), min(reach, w - u0 - du))
                x = x[:, reach - lo[0] : reach + dv + hi[0], reach - lo[1] : reach + du + hi[1]]
                x = np.pad(x, ((0, 0), (reach - lo[0], reach - hi[0]), (reach - lo[1], reach - hi[1])), mode=border)
                got = kernel(list(x), (v0 == 0, v0 + dv == h, u0 == 0, u0 + du == w)) if edges else kernel(list(x))
                v, u = np.divmod(np.arange(dv * up * du * up), du * up)
                yield pa.RecordBatch.from_arrays([pa.array(v + v0 * up), pa.array(u + u0 * up), *[pa.array(np.ascontiguousarray(g, np.float64).reshape(-1)) for g in got]], names=[*names, *out])

    return blocks.mapInArrow(run, ", ".join([f"{names[0]} long, {names[1]} long", *[f"{c} double" for c in out]]))


def correlate(x: np.ndarray, weights: Sequence[float], axis: int) -> np.ndarray:
    """Sum of shifted arrays along an axis, which gets shorter by the weights less one."""
    n = x.shape[axis] - len(weights) + 1
    return sum(float(k) * np.take(x, range(i, i + n), axis) for i, k in enumerate(weights))
