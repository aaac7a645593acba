"""Sharding by a Feistel permutation over global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Rows that one numbering bucket holds on average.
ROWS_A_BUCKET = 20_000


def number_rows(df: DataFrame, by: Column, buckets: int) -> DataFrame:
    """df with `row_number` 0..N-1, the same at every run.

    Rows are dealt by the hash `by` into buckets; a bucket's offset is the sum of
    the earlier buckets' counts (a table of `buckets` rows), the rest is a
    row_number inside the bucket, by that hash and the columns whose names start
    with `order`. Rows that agree in all of them are interchangeable.
    """
    w = Window.partitionBy("_bucket").orderBy("_h", *[c for c in df.columns if c.startswith("order")])
    keyed = df.withColumn("_h", by).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_offset"))
    numbered = keyed.withColumn("_r", F.row_number().over(w) - 1)
    return numbered.join(offsets, "_bucket").withColumn("row_number", F.col("_offset") + F.col("_r")).drop("_h", "_bucket", "_offset", "_r")


def feistel(x: Column, n: int, seed: int, rounds: int = 6) -> tuple[Column, Column]:
    """A permutation of 0..n-1: the first step, to be held in column `_once`, and the result from it.

    A generalised Feistel network on the grid a x b (a*b >= n, both near sqrt(n)):
    each round adds a hash of one half to the other, modulo its size. Values
    outside 0..n-1 walk the cycle until they fall inside; fewer than 2*sqrt(n)+2
    points lie outside, which bounds the walk.
    """
    a = max(1, int(n**0.5))
    a += a * a < n
    b = max(1, -(-n // a))

    def once(v: Column) -> Column:
        left, right = F.floor(v / F.lit(b)).cast("long"), F.pmod(v, F.lit(b))
        for k in range(rounds):
            if k % 2 == 0:
                left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), right), F.lit(a)), F.lit(a))
            else:
                right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), left), F.lit(b)), F.lit(b))
        return left * F.lit(b) + right

    first = F.col("_once")
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n + 1)), first, lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return once(x).alias("_once"), F.when(first < n, first).otherwise(walk)


def shard(docs: DataFrame, shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: the permuted row number p gives shard p mod shards and slot
    p div shards, so shard counts differ by at most one and slots have no gap.
    Both follow from the row number alone: reading slot s of shard k is
    computable. size = UTF-8 bytes of the text (null: 0) + 16; text_crc32 of a
    null text is 0. Null ids, repeated rows and empty tables are fine: identical
    rows are interchangeable, an empty table gives no row. Columns of docs named
    like a result are replaced, all others stay. The hashed order spreads copies of one text.
    A heavy repeat of one identical (id, text) row shares a bucket and is
    numbered by a spilling sort.
    """
    out = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = docs.count()
    buckets = max(16, -(-rows // ROWS_A_BUCKET))
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = F.struct(*[c for c in docs.columns if c not in out or c in (id_col, text_col)]).alias("doc")
    d = docs.select(kept, F.col(id_col).alias("order1"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("order2"))
    d = number_rows(d.withColumn("order3", F.col("size")), F.xxhash64(F.lit(seed), F.col("order1").cast("string"), F.col("order2"), F.col("size")), buckets)
    once, perm = feistel(F.col("row_number"), max(1, rows), seed)
    d = d.withColumn("_once", once).withColumn("p", perm)
    return d.select(
        "doc.*",
        "size",
        F.col("order2").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.pmod("p", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("p") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order, files of bounded size."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("maxRecordsPerFile", 500_000).parquet(path)
