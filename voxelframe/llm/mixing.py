"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import WORD, broadcast_if, stored

#: The mix repeats a document at most so many times.
PASSES = 3
#: Rows that one bucket of the shuffled order holds on average.
ROWS_A_BUCKET = 50_000
#: Ranges of finish time (two longs each) that may be broadcast; more are joined by shuffle.
MOST_RANGES = 500_000


def sized(docs: DataFrame) -> DataFrame:
    """docs with `size`, the number of words of the text (null: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(totals: DataFrame, passes: int = PASSES) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources in code point order, null last, weigh 1, 2, 3, repeating. Targets
    share the total by weight; one above passes x its source's size is held
    there, and what it leaves is shared again by weight, until none is above.
    The closed form needs no loop: sources reach their bound in the order of
    bound / weight, so the number of bounded sources is the first prefix of that
    order whose level stays within the next source's ratio. One row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    t = totals.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    t = t.withColumns({"_cap": F.col("source_size") * F.lit(float(passes))}).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("_ratio", F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"_total": F.sum("source_size").over(everything).cast("double"), "_weights": F.sum("weight").over(everything)})
    t = t.withColumns({"_used": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    t = t.withColumn("_level", F.greatest(F.lit(0.0), F.col("_total") - F.col("_used")) / (F.col("_weights") - F.col("_gone")))
    t = t.withColumn("_final", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything))
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_final") * F.col("weight")))
    return t.select("source", "source_size", "weight", target.alias("target"))


def placed(d: DataFrame, rows: int, seed: int, passes: int) -> DataFrame:
    """d (doc_id, source, size, tie, ...) with source_size, target and start, the words of its source ahead of it in the first pass.

    Each document waits in its source at a place set by a hash of its id. Cumulative
    sums are two-level (bucket sums, then the rows of a bucket), so no task holds a
    whole source.
    """
    buckets = max(16, -(-rows // ROWS_A_BUCKET))
    place = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    d = d.withColumn("_place", place).withColumn("_bucket", F.pmod(F.conv(F.substring("_place", 1, 8), 16, 10).cast("long"), F.lit(buckets)))
    sums = d.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    totals = sums.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    ahead = Window.partitionBy("source").orderBy("_bucket")
    offsets = sums.select("source", "_bucket", (F.sum("_sum").over(ahead) - F.col("_sum")).alias("_ahead"))
    plan = offsets.alias("o").join(targets(totals, passes).alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
    plan = plan.select(F.col("o.source").alias("_source"), F.col("_bucket").alias("_b"), "_ahead", "source_size", "target")
    here = Window.partitionBy("source", "_bucket").orderBy("_place", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_here", F.sum("size").over(here))
    d = d.join(plan, d.source.eqNullSafe(plan._source) & (d._bucket == plan._b))
    return d.withColumn("start", F.col("_ahead") + F.col("_here") - F.col("size")).drop("_place", "_bucket", "_here", "_source", "_b", "_ahead")


def queued(d: DataFrame, passes: int) -> DataFrame:
    """placed() rows of positive size, once a pass, with pass, virtual_finish and offered.

    Virtual time is the source's words up to the document's end, over all passes,
    divided by the source's target. The document that is being served when its
    source reaches the target, at time 1, finishes there and offers what it has
    been served by then, in whole words.
    """
    d = d.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    begin = F.col("start") + F.col("pass") * F.col("source_size")
    finish, over = (begin + F.col("size")) / F.col("target"), begin + F.col("size") > F.col("target")
    open_ = begin < F.col("target")
    return d.withColumns({
        "virtual_finish": F.when(over & open_, F.lit(1.0)).otherwise(finish),
        "offered": F.when(over & open_, F.floor(F.col("target") - begin)).otherwise(F.col("size")).cast("long"),
    })


def truncated(q: DataFrame, budget: DataFrame, rows: int) -> DataFrame:
    """queued() with served: the global queue, in order of virtual finish time, cut at the budget (one row, column budget).

    The queue is ranged into buckets of finish time; a bucket's offset is the sum of
    the buckets before it (a table of one row a bucket), and only buckets that begin
    below the budget are sorted. All behind them are served nothing.
    """
    buckets = max(16, -(-rows // ROWS_A_BUCKET))
    q = q.withColumn("_range", F.floor(F.least(F.col("virtual_finish"), F.lit(2.0)) * buckets).cast("long"))
    sums = q.groupBy("_range").agg(F.sum("offered").alias("_sum"))
    before = (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before")
    reached = stored(sums.select(F.col("_range").alias("_r"), before).crossJoin(F.broadcast(budget)).where("_before < budget"))
    q = q.join(broadcast_if(reached, reached.count(), MOST_RANGES), F.col("_range") == F.col("_r"), "left")
    w = Window.partitionBy("_range").orderBy("virtual_finish", "source", "start", "pass")
    near = q.where("_before is not null").withColumn("_ahead", F.col("_before") + F.sum("offered").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("offered"))
    near = near.withColumn("served", F.greatest(F.lit(0).cast("long"), F.least(F.col("offered"), F.col("budget") - F.col("_ahead")))).drop("_ahead")
    far = q.where("_before is null").withColumn("served", F.lit(0).cast("long"))
    return near.unionByName(far).drop("_range", "_r", "_before", "budget")


def _queue(d: DataFrame, rows: int, seed: int, passes: int) -> tuple[DataFrame, DataFrame]:
    """The placed documents, and the truncated queue of their passes."""
    p = placed(d, rows, seed, passes)
    each = p.groupBy("source").agg(F.first("target").alias("target"))
    budget = each.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0)).cast("long").alias("budget"))
    return p, truncated(queued(p, passes), budget, rows * passes)


def queue(docs: DataFrame, seed: int = 11, passes: int = PASSES) -> DataFrame:
    """One row per document and pass that the mix serves: docs' columns, size, source_size, target, pass, virtual_finish, served.

    Each shuffled document gets its virtual finish time, pass after pass; the queue
    of all sources is ordered by it and truncated at the budget, the sum of the
    targets in whole words. Null text has size 0 and is never served; null sources
    are one source; repeated rows are separate documents; ties in the hash fall to
    the id, the size and a hash of the text. Columns of docs named like a result are
    replaced.
    """
    out = ["size", "source_size", "target", "pass", "virtual_finish", "served"]
    kept = F.struct(*[c for c in docs.columns if c not in out]).alias("doc")
    d = sized(docs.select(kept, "doc_id", "source", "text", F.xxhash64("text").alias("tie"))).drop("text")
    _, q = _queue(d, docs.select("doc_id").count(), seed, passes)
    return q.where("served > 0").select("doc.*", *out)


def mixed(docs: DataFrame, seed: int = 11, passes: int = PASSES) -> DataFrame:
    """The mix itself: documents range-sorted by virtual finish time, repeated as served; a cut document keeps its first words, joined by single spaces, and n_chars, where docs have it, says their length. All columns of docs stay, whatever their names."""
    tie = F.xxhash64("text").alias("tie")
    # The queue is made of keys and sizes; texts meet what is served of them once, and go to their place.
    _, q = _queue(sized(docs.select("doc_id", "source", "text", tie)).drop("text"), docs.select("doc_id").count(), seed, passes)
    served = q.where("served > 0").groupBy("doc_id", "source", "tie", "start", "size").agg(F.collect_list(F.struct("pass", "virtual_finish", "served")).alias("serves"))
    # Rows of one id, source and text are told apart by their order.
    same = Window.partitionBy("doc_id", "source", "tie")
    served = served.withColumn("nth", F.row_number().over(same.orderBy("start"))).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("tie").alias("_tie"), F.col("nth").alias("_nth"), "size", "serves")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", tie).withColumn("nth", F.row_number().over(same.orderBy(F.xxhash64("doc"))))
    met = rows.join(served, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("tie") == F.col("_tie")) & (F.col("nth") == F.col("_nth")))
    q = met.select("doc", "doc_id", "size", F.explode("serves").alias("serve")).select("doc", "doc_id", "size", "serve.*")
    whole = F.col("served") >= F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("doc.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("served").cast("int")), " ")
    q = q.withColumn("_text", F.when(whole, F.col("doc.text")).otherwise(cut))
    kinds = dict(docs.dtypes)
    new = {"text": F.col("_text"), "n_chars": F.when(whole, F.col("doc.n_chars")).otherwise(F.length("_text").cast(kinds["n_chars"]))} if "n_chars" in kinds else {"text": F.col("_text")}
    q = q.repartitionByRange("virtual_finish", "doc_id").sortWithinPartitions("virtual_finish", "doc_id", "pass")
    return q.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def taken(docs: DataFrame, seed: int = 11, passes: int = PASSES) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (the sum of what the truncated queue serves of its passes; 0 if left out)."""
    d = stored(sized(docs.select("doc_id", "source", "text", F.xxhash64("text").alias("tie"))).drop("text"))
    p, q = _queue(d, docs.select("doc_id").count(), seed, passes)
    # In its source a document with words is known by where it starts.
    q = q.groupBy("source", "start", "doc_id", "size", "source_size", "target").agg(F.sum("served").alias("taken"))
    cols = ("doc_id", "size", "source_size", "target", "taken")
    return q.select(*cols).unionByName(p.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*cols))
