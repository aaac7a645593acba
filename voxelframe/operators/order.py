"""Exact order statistics that no task computes alone: selection by rank, ranks, running medians."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources import files

#: Grid of a round's sketch, and rows that the last round may have to sort for one wanted rank.
BINS, SORTED = 256, 100_000
#: Wanted ranks (or keys) of which a table is broadcast.
MOST_WANTED = 100_000
#: Places of a path that one block holds at least.
LEAST_BLOCK = 1_024


def kept(df: DataFrame) -> DataFrame:
    """df written below spark.checkpoint.dir and read back: computed once, and safe from a lost executor."""
    path = files.folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_WANTED else df


def select(rows: DataFrame, keys: Sequence[str], col: str, wanted: DataFrame, bins: int = BINS, most: int = SORTED) -> DataFrame:
    """wanted(keys..., _want, _k) -> keys..., _want, _value: the _k-th smallest (from 0) of the key's values, for each name _want.

    Null and NaN values do not count; a rank that does not exist has no row. While a
    wanted rank's range holds more than `most` rows, a round asks a mergeable sketch for
    a bracket of the rank, counts what lies below, in and above it, and keeps the part
    that holds the rank: three bins of `bins` as a rule, and a wrong bracket costs a
    round, not a result. What is left is counted by value before the shuffle.
    """
    keys = list(keys)
    by = [*keys, "_want"]
    data = kept(rows.select(*keys, F.col(col).cast("double").alias("_v")).where("_v is not null and not isnan(_v)"))
    ranges = data.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    left = wanted.select(*keys, "_want", F.col("_k").cast("long").alias("_k"))
    left = left.join(ranges, keys) if keys else left.crossJoin(F.broadcast(ranges))
    left = kept(left.where((F.col("_k") >= 0) & (F.col("_k") < F.col("_n"))))
    many = left.count()

    def met(of: DataFrame) -> DataFrame:
        inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
        side = _small(of, many)
        return (data.join(side, keys) if keys else data.crossJoin(F.broadcast(of))).where(inside)

    def grid_cut(i):
        return F.element_at("_cuts", F.least(F.greatest(i, F.lit(1)), F.size("_cuts")).cast("int"))

    while (left.agg(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_n")))).first()[0] or 0) > most:
        big = left.where((F.col("_n") > most) & (F.col("_lo") < F.col("_hi")))
        share = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
        cuts = met(big).groupBy(*by).agg(F.approx_percentile("_v", share, F.lit(10 * bins)).alias("_cuts"))
        at = F.floor(F.col("_k") * bins / F.col("_n"))
        near = big.join(cuts, by).select(*by, "_k", "_lo", "_hi", grid_cut(at).alias("_a"), grid_cut(at + 3).alias("_b"))
        # Where the sketch cannot cut anything off, the least value is cut off.
        stuck = (F.col("_a") == F.col("_lo")) & (F.col("_b") == F.col("_hi"))
        near = kept(near.withColumns({"_a": F.when(stuck, F.col("_lo")).otherwise(F.col("_a")), "_b": F.when(stuck, F.col("_lo")).otherwise(F.col("_b"))}))
        v, under, over = F.col("_v"), F.col("_v") < F.col("_a"), F.col("_v") > F.col("_b")
        counts = met(near).groupBy(*by).agg(F.count_if(under).alias("_u"), F.count_if(~under & ~over).alias("_i"), F.count_if(over).alias("_o"), F.max(F.when(under, v)).alias("_ub"), F.min(F.when(~under & ~over, v)).alias("_ia"), F.max(F.when(~under & ~over, v)).alias("_ib"), F.min(F.when(over, v)).alias("_oa"))
        low, high = F.col("_k") < F.col("_u"), F.col("_k") >= F.col("_u") + F.col("_i")
        pick = lambda a, b, c: F.when(low, a).when(high, c).otherwise(b)
        k, zero = F.col("_k"), F.lit(0)
        narrowed = near.join(counts, by).select(*by, (k - pick(zero, F.col("_u"), F.col("_u") + F.col("_i"))).alias("_k"), pick(F.col("_lo"), F.col("_ia"), F.col("_oa")).alias("_lo"), pick(F.col("_ub"), F.col("_ib"), F.col("_hi")).alias("_hi"), pick(F.col("_u"), F.col("_i"), F.col("_o")).alias("_n"))
        left = kept(left.join(big.select(*by), by, "left_anti").select(*by, "_k", "_lo", "_hi", "_n").unionByName(narrowed))
    counts = met(left).groupBy(*by, "_k", "_v").agg(F.count(F.lit(1)).alias("_c"))
    up_to = F.sum("_c").over(Window.partitionBy(*by).orderBy("_v"))
    out = counts.withColumn("_to", up_to).where((F.col("_k") < F.col("_to")) & (F.col("_k") >= F.col("_to") - F.col("_c")))
    return out.select(*keys, "_want", F.col("_v").alias("_value"))


def percentiles(rows: DataFrame, keys: Sequence[str], col: str, shares: dict[str, float], bins: int = BINS, most: int = SORTED) -> DataFrame:
    """keys and one column a share: the exact percentile with linear interpolation between ranks, as an aggregate would give it, but for any size. Keys without a value have no row; without keys there is one row (null without a value)."""
    keys = list(keys)
    data = kept(rows.select(*keys, F.col(col).cast("double").alias("_v")).where("_v is not null and not isnan(_v)"))
    sizes = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    at = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in shares.items()}
    want = F.array(*[F.struct(F.lit(f"{name}{side}").alias("_want"), f(x).cast("long").alias("_k")) for name, x in at.items() for side, f in ((0, F.floor), (1, F.ceil))])
    wanted = sizes.select(*keys, F.explode(want).alias("_w")).select(*keys, "_w.*")
    got = select(data, keys, "_v", wanted, bins, most)
    ends = got.groupBy(*keys).agg(*[F.max(F.when(F.col("_want") == f"{name}{side}", F.col("_value"))).alias(f"_{name}{side}") for name in shares for side in (0, 1)])
    both = sizes.join(ends, keys) if keys else sizes.crossJoin(ends)
    lo, hi, part = (lambda name: F.col(f"_{name}0")), (lambda name: F.col(f"_{name}1")), (lambda name: at[name] - F.floor(at[name]))
    return both.select(*keys, *[(lo(n) + (hi(n) - lo(n)) * part(n)).alias(n) for n in shares])


def ranked(rows: DataFrame, key: str, by: Sequence[str], name: str = "rank") -> DataFrame:
    """rows with the exact rank (from 0) of each among its key's in the order of `by`.

    Rows are range-sorted by key and `by`, so a hot key spreads over many tasks; a
    row's place is its partition's offset, a sum of one count a partition, and its
    place within. The sorted table is written once, as its partitions must not move.
    """
    at = F.col("_id").bitwiseAND((1 << 33) - 1)
    part = F.shiftright("_id", 33)
    sorted_ = kept(rows.repartitionByRange(key, *by).sortWithinPartitions(key, *by).withColumn("_id", F.monotonically_increasing_id()))
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_from"))
    numbered = sorted_.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("_at", F.col("_from") + at)
    first = numbered.groupBy(F.col(key).alias("_key")).agg(F.min("_at").alias("_first"))
    return numbered.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn(name, F.col("_at") - F.col("_first")).drop("_id", "_part", "_from", "_at", "_key", "_first")


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: the running medians at its places, from its own values and those near the median that came before."""
    for b in batches:
        key, n, out = [], [], []
        for k, start, below, old, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held = sorted(old or [])
            for i, p in enumerate(sorted(own, key=lambda p: p["n"])):
                insort(held, p["v"])
                count = start + i + 1
                key.append(k)
                n.append(p["n"])
                out.append((held[(count - 1) // 2 - below] + held[count // 2 - below]) / 2)
        yield pa.RecordBatch.from_arrays([pa.array(key, b.schema.field(0).type), pa.array(n, pa.int64()), pa.array(out, pa.float64())], names=["key", "n", "median"])


def running_medians(ranks: DataFrame) -> DataFrame:
    """ranks(key, n, v, rank) -> key, n, median: the exact median of the key's v at the places 1 .. n.

    n is 1, 2, ... and rank 0, 1, ... within a key (see `ranked`). A path of N points
    is cut into blocks of S = sqrt(N) places and of S ranks. In S places the median
    moves past at most S of the earlier values, so a block needs only those, which the
    counts of earlier places by rank block tell; they come from an equi-join by rank
    block. A task holds a few S values, all joins together about N log N rows.
    """
    kind = dict(ranks.dtypes)["key"]
    medians = f"key {kind}, n long, median double"
    longest = ranks.groupBy("key").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    if longest <= LEAST_BLOCK:  # every path is one block, and nothing came before it
        alone = ranks.groupBy("key").agg(F.collect_list(F.struct("n", "v")).alias("own"))
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("array<double>")
        return alone.select("key", zero.alias("start"), zero.alias("below"), none.alias("old"), "own").mapInArrow(_medians, medians)
    size = ranks.groupBy("key").agg(F.greatest(F.ceil(F.sqrt(F.count(F.lit(1)))), F.lit(LEAST_BLOCK)).cast("long").alias("s"), F.count(F.lit(1)).alias("size"))
    d = ranks.join(size, "key").select("key", "n", "v", "s", F.floor((F.col("n") - 1) / F.col("s")).alias("pb"), F.floor(F.col("rank") / F.col("s")).alias("rb"))
    cells = d.groupBy("key", "pb", "rb").agg(F.count(F.lit(1)).alias("c"))
    # Blocks of places after the first, each with every rank block: (N / S)^2 <= N rows a path.
    last = F.floor((F.col("size") - 1) / F.col("s"))
    pairs = size.where(last > 0).select("key", "s", F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("pb"), last.alias("last")).select("key", "s", "pb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("rb"))
    so_far = F.coalesce(F.sum("c").over(Window.partitionBy("key", "rb").orderBy("pb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = size.select("key", "s", F.lit(0).cast("long").alias("pb"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("rb"))
    before = firsts.unionByName(pairs).join(cells, ["key", "pb", "rb"], "left").withColumn("old", so_far).where("pb > 0")
    to = F.sum("old").over(Window.partitionBy("key", "pb").orderBy("rb"))
    middle = F.floor(F.col("pb") * F.col("s") / 2)
    near = before.withColumn("to", to).where((F.col("to") >= middle - F.col("s") - 1) & (F.col("to") - F.col("old") <= middle + F.col("s") + 1) & (F.col("old") > 0))
    near = near.select("key", "pb", "rb", F.col("s").alias("_s"), (F.col("to") - F.col("old")).alias("under"))
    olds = d.select("key", "rb", "n", "v").join(near, ["key", "rb"]).where(F.col("n") <= F.col("pb") * F.col("_s"))
    olds = olds.groupBy("key", "pb").agg(F.collect_list("v").alias("old"))
    under = near.groupBy("key", "pb").agg(F.min("under").alias("below"))
    own = d.groupBy("key", "pb").agg(F.first("s").alias("s"), F.collect_list(F.struct("n", "v")).alias("own"))
    blocks = own.join(under, ["key", "pb"], "left").join(olds, ["key", "pb"], "left")
    return blocks.select("key", (F.col("pb") * F.col("s")).cast("long").alias("start"), F.coalesce("below", F.lit(0)).cast("long").alias("below"), "old", "own").mapInArrow(_medians, medians)
