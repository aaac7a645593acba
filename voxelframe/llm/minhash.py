"""MinHash near-duplicates: fast similarity sketches, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, nodes, smallest_ids
from .shared import BYTES_LOWER, WordHash, broadcast_if, mix64, shingles, stored

#: Coordinates of a sketch (a power of two), bands and rows of a band (of the first coordinates): at similarity 0.8 a pair shares no band with probability 5e-8.
T, BANDS, ROWS = 256, 32, 4
#: Coordinates of the wide sketch that residual pairs are compared on, one bit of each.
WIDE = 4096
#: A residual pair is dropped unread if fewer bits agree. At similarity 0.8 nine bits in ten agree: 3,570 is six standard deviations off, so such a pair is lost once in 10^9.
LEAST_AGREE = 3570
#: Pairs of one node that meet its full set in one task; a node of more has its set dealt to several.
PARTNERS = 1_000
#: Nodes of so many pairs that may be broadcast (two longs each).
MOST_HOT = 500_000
_EMPTY = np.uint64(2**64 - 1)
_SEEDS = mix64(np.arange(1, 2 * WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BAND = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def sketch(a: np.ndarray, t: int = T) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit fingerprints: t coordinates (a power of two).

    Round r < t puts each element by hash into one bin; rounds t..2t-1 put all of
    them into bin r - t, so every coordinate is filled. A coordinate keeps the
    least (round, value). Rounds stop when all are filled; later ones change
    nothing, so several may be run at once.
    """
    bits = t.bit_length() - 1
    low, shift = np.uint64(64 - bits), np.uint64(64 - 2 * bits - 1)
    value, rest = (np.uint64(1) << shift) - np.uint64(1), (np.uint64(1) << low) - np.uint64(1)
    out = np.full(t, _EMPTY)
    step, r = max(1, min(2 * t, ceil(1.3 * t * log(t) / len(a)))), 0
    while r < 2 * t and (out == _EMPTY).any():
        rounds = np.arange(r, min(2 * t, r + step), dtype=np.uint64)[:, None]
        h = mix64(a[None, :] ^ _SEEDS[r : min(2 * t, r + step), None])
        bins = np.where(rounds < t, h >> low, rounds - np.uint64(t) * (rounds >= t))
        packed = ((bins << low) | (rounds << shift) | (h & value)).ravel()
        packed.sort()
        b = (packed >> low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        out[b[first]] = np.minimum(out[b[first]], packed[first] & rest)
        r += step
    return out


def bands(s: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    out = _BAND.copy()
    for col in s[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + col)
    return out


def text_shingles(text: bytes | None, k: int, memo: WordHash) -> np.ndarray:
    return shingles(memo.all((text or b"").translate(BYTES_LOWER).split()), k)


def _sketches(k: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in batches:
            n, fp, keys = [], [], []
            for text in batch.column(1).to_pylist():
                s = text_shingles(text, k, memo)
                n.append(len(s))
                if len(s):
                    fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append(bands(sketch(s)).view(np.int64))
                else:
                    fp.append(None), keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "fp", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in batches:
            sets = [text_shingles(t, k, memo) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["least", "fp", "set"]
            )

    return run


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wide sketches of stored sets, one bit a coordinate, packed into longs."""
    for batch in batches:
        x = [np.packbits((mix64(sketch(np.frombuffer(s, np.uint64), WIDE)) & np.uint64(1)).astype(np.uint8)).view(np.int64) for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.int64()))], names=["node", "wide"])


def _verify(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch["sa"], batch["sb"], strict=True)):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([a, b]))
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(a) + len(b) - common)
            yield batch.loc[keep, ["a", "b"]]

    return run


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a written table whose full sets have 100 * intersection >= percent * union.

    The larger side is joined first; the set of a node a with very many pairs, the
    centre of a star, is dealt to as many tasks as it has PARTNERS.
    """
    hot = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts")).where("parts > 1"))
    hot = broadcast_if(hot, hot.count(), MOST_HOT)
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    centre = sets.selectExpr("node a", "set sa").join(hot, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    both = dealt.join(sets.selectExpr("node b", "set sb"), "b").join(centre.select("a", "part", "sa"), ["a", "part"])
    return stored(both.select("a", "b", "sa", "sb").mapInPandas(_verify(percent), "a long, b long"))


def classes(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Documents of equal sets are one class from the start, named by its smallest
    doc_id, so copies are never paired. Class names meet per band: all are paired
    with the band's smallest and largest member and verified on full sets. What a
    band's largest component leaves over is then paired with the band's members of
    other components, if enough bits of wide sketches agree, and verified too; no
    band is expanded into all pairs. A link is lost only if its texts share no band
    (5e-8 at similarity 0.8) or too few bits (1e-9), and no chain of other links
    joins them. Components are named by their smallest doc_id. Null or blank texts
    are empty sets and linked with nothing. A null doc_id is linked with nothing and
    kept. If a doc_id has several texts, each has its own links. Repeated rows are
    one document; texts and words may be of any length. Columns beside doc_id and
    text are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    text = F.col("text").cast("binary")
    rows = stored(docs.select("doc_id", text.alias("t")).mapInArrow(_sketches(k, None), f"doc_id {kind}, n_shingles long, fp binary, bands array<long>"))
    named = rows.where("fp is not null and doc_id is not null")
    rep = stored(nodes(named.select(F.col("fp").alias("key"), F.col("doc_id").alias("id"))))
    # One row a set: that of its smallest doc_id.
    first = named.join(rep.select(F.col("key").alias("fp"), "least", "node"), "fp").where("cast(doc_id as long) = least").dropDuplicates(["fp"])
    members = stored(first.selectExpr("node", "n_shingles n", "bands"))
    keyed = members.select("node", "n", F.posexplode("bands").alias("which", "band"))
    ends = keyed.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi")).where("lo < hi")
    ends = stored(ends.select("band", "lo", "hi"))
    shared = stored(keyed.join(ends, "band"))
    sizes = members.selectExpr("node o", "n n_o")
    star = shared.select("node", "n", F.explode(F.array("lo", "hi")).alias("o")).where("node <> o").distinct().join(sizes, "o")
    star = star.where(f"100 * least(n, n_o) >= {percent} * greatest(n, n_o)")
    star = stored(star.selectExpr("least(node, o) a", "greatest(node, o) b").distinct())
    wanted = rep.join(shared.select("node").distinct(), "node", "left_semi").select(F.col("key").alias("fp"), "least", "node")
    source = docs.select(F.col("doc_id").cast("long").alias("least"), text.alias("t"))
    # One plan at every size: the wanted ids grow with the texts, so these are always dealt by id.
    sets = source.join(wanted.select("least").hint("merge"), "least", "left_semi").mapInArrow(_sets(k), "least long, fp binary, set binary")
    sets = stored(sets.join(wanted, ["least", "fp"]).select("node", "set").dropDuplicates(["node"]))
    edges = linked(star, sets, percent)
    label = components(edges)
    # Bands whose members are not all of one component yet.
    at = shared.select("band", "which", "node", "n").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    most = at.groupBy("band", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("band")
    most = most.agg(F.max_by("component", F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("band", "top")
    open_ = stored(at.join(most, "band").distinct())
    wide = sets.join(open_.select("node"), "node", "left_semi").select("node", "set").mapInArrow(_wide, "node long, wide array<long>")
    open_ = open_.join(stored(wide), "node").join(members.select("node", "bands"), "node")
    open_ = stored(open_)
    left = open_.where("component <> top").selectExpr("band", "node x", "n nx", "component cx", "wide wx", "bands bx", "top", "which")
    right = open_.selectExpr("band", "node y", "n ny", "component cy", "wide wy", "bands by_")
    # A pair meets in the first band that it shares, and only there.
    first = F.expr("array_position(zip_with(bx, by_, (p, q) -> p = q), true) = which + 1")
    agree = F.expr(f"aggregate(zip_with(wx, wy, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v) <= {WIDE - LEAST_AGREE}")
    on = (F.expr(f"cx <> cy and (cy = top or x < y) and 100 * least(nx, ny) >= {percent} * greatest(nx, ny)")) & first & agree
    rest = left.join(right, "band").where(on).selectExpr("least(x, y) a", "greatest(x, y) b").distinct()
    rest = stored(rest.join(star, ["a", "b"], "left_anti"))
    more = linked(rest, sets, percent)
    label = components(edges.union(more))
    of = smallest_ids(rep, label).select(F.col("key").alias("fp"), F.col("component").alias("c"))
    out = rows.select("doc_id", "n_shingles", "fp").join(of, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("c"), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicates_removed(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each class: the rows whose id names their class. Rows of one doc_id and text are one document.

    If a doc_id has several texts, each further one is judged under an id of its own,
    a hash of both above the ids in use, so that a text never goes with another.
    """
    # The input is one struct, so that no name of its columns meets one of ours.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    doc_id, sha = F.col("doc.doc_id"), F.sha2(F.coalesce(F.col("doc.text").cast("binary"), F.lit("").cast("binary")), 256)
    texts = packed.where(doc_id.isNotNull()).select(doc_id.alias("doc_id"), sha.alias("sha")).distinct()
    least = texts.groupBy("doc_id").agg(F.min("sha").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    own = F.xxhash64("doc_id", "sha").bitwiseAND(F.lit(2**63 - 1)).bitwiseOR(F.lit(2**62))
    more = stored(texts.join(least, "doc_id").where("sha <> least").select(F.col("doc_id").alias("id"), "sha", own.alias("own")))
    named = packed.join(more, (doc_id == F.col("id")) & (sha == F.col("sha")), "left").select("doc", F.coalesce("own", doc_id.cast("long")).alias("key"))
    gone = classes(named.select(F.col("key").alias("doc_id"), F.col("doc.text").alias("text")), k, percent).where("not kept").select(F.col("doc_id").alias("key")).distinct()
    return named.join(gone, "key", "left_anti").select("doc.*")
