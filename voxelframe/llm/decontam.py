"""Benchmark decontamination: a broadcast hash set of test windows meets the documents' token windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower_az

#: ASCII letters and digits and everything beyond ASCII make words.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Benchmark windows that may be broadcast; beyond it the join shuffles both sides.
MOST_WINDOWS = 2_000_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(lower_az(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(len, words, items): the distinct windows of n item words; the whole item where it is shorter but not empty. Items without an id, or without words, are no items and have no windows."""
    w = benchmark.where("item_id is not null").select("item_id", tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    w = w.withColumn("len", F.least(F.lit(n), F.size("t")))
    w = w.select("item_id", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - F.col("len") + 1), lambda i: F.slice(F.col("t"), i, F.col("len")))).alias("words"))
    return w.groupBy("len", "words").agg(F.collect_set("item_id").alias("items"))


def starts(k: int) -> Column:
    """Hashes of the windows of k words, from the word hashes _h; one entry at least."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("_n") - k)), lambda i: F.xxhash64(F.slice(F.col("_h"), i + 1, k)))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Per distinct (doc_id, text): copies, n_words, positions hit (sorted), items.

    Every window of every document is hashed inside one scan and looked up in the
    broadcast set (a shuffled join where the set passes MOST_WINDOWS); a hit is
    verified on its words. Only hits and one row per document reach the shuffle.
    Null texts have no word; repeated rows are one text with its copies.
    """
    grams = windows(benchmark, n).cache()
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect()) or [n]
    count = grams.count()
    side = grams.select(F.xxhash64(F.transform("words", lambda w: F.xxhash64(w))).alias("_hash"), F.col("words").alias("_words"), F.col("items").alias("_items"))
    d = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_text"), tokens(F.col("text")).alias("_t"))
    d = d.withColumns({"_n": F.size("_t"), "_h": F.transform("_t", lambda w: F.xxhash64(w))})
    # Position 0 is always present, so that documents too short for a window stay.
    at = [starts(k) for k in lengths]
    out = None
    for k, hashes in zip(lengths, at, strict=True):
        e = d.select("doc_id", "_text", "_n", "_t", F.posexplode(hashes).alias("_p", "_hash"))
        s = side.where(F.size("_words") == k)
        j = e.join(F.broadcast(s) if count <= MOST_WINDOWS else s, "_hash", "left")
        j = j.withColumn("_hit", F.col("_words").isNotNull() & (F.slice(F.col("_t"), F.col("_p") + 1, k) == F.col("_words")))
        first = (F.col("_p") == 0) if k == lengths[0] else F.lit(False)
        j = j.where(F.col("_hit") | first)
        j = j.select("doc_id", "_text", "_n", "_p", F.when(F.col("_hit"), F.lit(k)).alias("_k"), F.when(F.col("_hit"), F.col("_items")).alias("_items"), first.alias("_first"))
        out = j if out is None else out.unionByName(j)
    spans = F.transform(F.filter(F.collect_set(F.struct("_p", "_k")), lambda x: x["_k"].isNotNull()), lambda x: F.sequence(x["_p"], x["_p"] + x["_k"] - 1))
    return out.groupBy("doc_id", "_text", F.col("_n").alias("n_words")).agg(
        F.count_if("_first").alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(spans))).alias("positions"),
        F.array_distinct(F.flatten(F.collect_set("_items"))).alias("items"),
    )


def judged(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, share: int = 20) -> DataFrame:
    """hits() with n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and share * n_hit >= n_words), one row per distinct (doc_id, text)."""
    h = hits(docs, benchmark, n)
    n_hit = F.size("positions").cast("long")
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return h.withColumns({
        "n_words": F.col("n_words").cast("long"),
        "n_hit": n_hit,
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(ids, 256),
        "contaminated": (n_hit > 0) & (share * n_hit >= F.col("n_words")),
    })


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, share: int = 20) -> DataFrame:
    """docs without contaminated documents.

    The contaminated ones are few next to docs, and found first; documents with a
    null id are judged by their text. An empty benchmark removes nothing.
    """
    bad = judged(docs, benchmark, n, share).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("_text").alias("_sha")).distinct()
    text = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (text == bad["_sha"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs with `clean_words`: the normalised words outside hit windows. A column of that name is replaced; null texts have no words."""
    h = hits(docs, benchmark, n).select(F.col("doc_id").alias("id"), F.col("_text").alias("sha"), "positions")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "clean_words"]).alias("doc"))
    text = F.sha2(F.coalesce(F.col("doc.text"), F.lit("")), 256)
    d = packed.join(h, F.col("doc.doc_id").eqNullSafe(F.col("id")) & (text == F.col("sha")), "left")
    kept = F.filter(tokens(F.col("doc.text")), lambda _, i: ~F.array_contains(F.col("positions"), i))
    return d.select("doc", F.struct(kept.alias("clean_words")).alias("clean")).select("doc.*", "clean.*")
