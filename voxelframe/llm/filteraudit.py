"""How text filters interact: count-weighted decision diagrams of failure masks, read in every order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, stored

#: The filters by letter; bit i of a mask is set where filter i fails.
LETTERS = "ABCDE"
#: Fixed values of the filters: least words, least share of distinct words and most share of capitals in hundredths, forbidden characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, FORBIDDEN = 200, 50, 3, r"[#$%&*|]"
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: Parts whose rows one Arrow batch of results holds.
PARTS_A_BATCH = 50


def text_mask(text: Column) -> Column:
    """The bits of A to D of a text that is not null."""
    # One pass takes the words apart; both counts read the same array.
    counts = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("k")))[0]

    def bits(c: Column) -> Column:
        capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
        fails = (c["n"] < LEAST_WORDS, 100 * c["k"] < LEAST_DISTINCT * c["n"], 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(FORBIDDEN))
        return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))

    return F.transform(F.array(counts), bits)[0]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, mask, good, toxic of each row of docs(doc_id, text, lang).

    Null texts are empty, and equal to empty texts; a null lang is the part ''. E
    compares whole texts by SHA-256 over the whole table: it fails where a row of a
    smaller doc_id has the text; rows of one id do not fail each other, and a null id
    is smaller than none and has none below it. good and toxic are 1 if any label of
    the doc_id says so; labels without a document, or with nulls, say nothing. Texts
    are read once and not shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), text_mask(text).alias("mask")))
    known = rows.where("doc_id is not null")
    first = known.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(one("quality"), one("toxic"))
    repeated = F.col("first").isNull().cast("int") * 16
    told = known.join(first, ["sha", "doc_id"], "left").join(marks, "doc_id", "left")
    zero = F.lit(0)
    told = told.select("doc_id", "part", (F.col("mask") + repeated).alias("mask"), F.coalesce("quality", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    return told.unionAll(rows.where("doc_id is null").select("doc_id", "part", "mask", zero.alias("good"), zero.alias("toxic")))


class Node:
    """A variable with its two branches and the counts of all documents below it."""

    __slots__ = ("hi", "lo", "var", "weight")

    def __init__(self, var, lo, hi, weight):
        self.var, self.lo, self.hi, self.weight = var, lo, hi, weight


class Diagram:
    """A shared decision diagram over n failure bits: below a node, `lo` are the documents that pass its filter and `hi` those that fail it. No level is skipped."""

    def __init__(self, counts: dict[int, tuple[int, ...]], n: int, width: int):
        self.order, self.made = list(range(n)), {}
        self.zero = (0,) * width
        self.root = self._build(counts, 0, 0)

    def _leaf(self, weight) -> Node:
        return self.made.setdefault(weight, Node(None, None, None, weight))

    def _node(self, var, lo: Node, hi: Node) -> Node:
        key = (var, id(lo), id(hi))
        if key not in self.made:
            self.made[key] = Node(var, lo, hi, tuple(a + b for a, b in zip(lo.weight, hi.weight, strict=True)))
        return self.made[key]

    def _build(self, counts, level: int, mask: int) -> Node:
        if level == len(self.order):
            return self._leaf(counts.get(mask, self.zero))
        return self._node(level, self._build(counts, level + 1, mask), self._build(counts, level + 1, mask | 1 << level))

    def swap(self, level: int) -> None:
        """Exchange the variables of a level and the next: only nodes of these two levels get new branches, the levels below are shared."""

        def at(node: Node, depth: int) -> Node:
            if depth:
                return self._node(node.var, at(node.lo, depth - 1), at(node.hi, depth - 1))
            below = [self._node(node.var, *(getattr(child, side) for child in (node.lo, node.hi))) for side in ("lo", "hi")]
            return self._node(node.lo.var, *below)

        self.root = at(self.root, level)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """Along the path on which every filter passes: filter, counts kept, counts removed."""
        out, node = [], self.root
        while node.var is not None:
            out.append((node.var, node.lo.weight, node.hi.weight))
            node = node.lo
        return out


def plain_changes(n: int) -> Iterator[int]:
    """Levels whose swaps, one after another, lead through all n! orders: the last variable sweeps to and fro through the orders of the others."""
    if n < 2:
        return
    down, shift = True, plain_changes(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        inner = next(shift, None)
        if inner is None:
            return
        yield inner + down
        down = not down


def interactions(counts: dict[int, tuple[int, int, int]], letters: str = LETTERS) -> list[tuple]:
    """counts: mask -> (documents, good, toxic). Per order and step: order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    diagram = Diagram(counts, len(letters), 3)
    read = [("".join(letters[v] for v in diagram.order), diagram.steps())]
    for level in plain_changes(len(letters)):
        diagram.swap(level)
        read.append(("".join(letters[v] for v in diagram.order), diagram.steps()))
    fails, alone, shares = {}, {}, dict.fromkeys(range(len(letters)), 0)
    for _, steps in read:
        fails[steps[0][0]] = steps[0][2][0]
        alone[steps[-1][0]] = steps[-1][2][0]
        for v, _, gone in steps:
            shares[v] += gone[0]
    return [(order, k, kept[0], gone[0], fails[v] - gone[0], alone[v], gone[1], gone[2], shares[v]) for order, steps in read for k, (v, kept, gone) in enumerate(steps, 1)]


def audit(rows: DataFrame) -> DataFrame:
    """rows(part, mask, good, toxic): per part one row an order and step, as RESULT says.

    Rows are counted by part and mask before and after the shuffle, so a part is at
    most 32 counts however many documents it has, and each is a diagram of its own.
    An empty table has no parts.
    """
    sums = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PARTS_A_BATCH):
                some = b.slice(at, PARTS_A_BATCH)
                out = [(part, *row) for part, counts in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True) for row in interactions({c["mask"]: (c["n"], c["good"], c["toxic"]) for c in counts})]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return parts.mapInArrow(run, RESULT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The filters' interactions per part of docs; see masks and audit."""
    return audit(masks(docs, labels))
