"""Vector codes and filter audits against plain Python, toxicity on held-out labels, and the edge cases of the three."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelframe.llm import filteraudit, langid, queries, toxicity, veccode

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# Vector codes.


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, [math.floor(256 * x) for x in v] + [0] * (width - len(v)), label) for i, v, label in kept]
    d = width // parts
    first = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        first.setdefault(i, v)
    start = [first[i] for i in sorted(first)[:entries]]
    books = [[v[p * d : (p + 1) * d] for v in start] for p in range(parts)]

    def nearest(v, p):
        far = [sum((a - b) ** 2 for a, b in zip(v[p * d : (p + 1) * d], e, strict=True)) for e in books[p]]
        k = far.index(min(far))
        return k, far[k]

    for _ in range(rounds):
        at = [[nearest(v, p)[0] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p * d : (p + 1) * d] for (_, v, _), a in zip(kept, at, strict=True) if a[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, [nearest(v, p) for p in range(parts)], label) for i, v, label in kept]
    total = {}
    for _, got, label in found:
        total[label] = total.get(label, 0) + sum(x for _, x in got)
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((i, "".join(f"{k:02x}" for k, _ in got), fits(sum(x for _, x in got)), fits(total[label]), sha) for i, got, label in found), key=repr)


def codes(spark, rows, kind="double"):
    d = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, code string, error int, _label int").repartition(3)
    return sorted((tuple(r) for r in veccode.compress(d).collect()), key=repr)


def wide(rows):
    return [(*r, "mine", 7, 8) for r in rows]


def test_codes_equal_plain_python(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op12_vector_codes(spark, DATA).collect()), key=repr) == brute_codes(rows)


def test_codes_of_odd_rows(spark):
    """Nulls, non-finite parts, repeated rows and ids, null ids and labels, ties, unequal lengths, and clashing columns."""
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 3, 32) / 7], int(i % 3)) for i in rng.permutation(90)]
    rows += [rows[0], rows[1], (5, [0.25] * 32, None), (5, [0.5] * 32, None), (None, [0.1] * 32, 1), (200, None, 1), (201, [float("nan")] * 32, 1), (202, [float("inf")] + [0.0] * 31, 2), (203, [None] + [1.0] * 31, 2), (204, [], 1), (-4, [-0.001] * 20, 0), (205, [-0.0] * 32, None)]
    assert codes(spark, wide(rows)) == brute_codes(rows)
    few = [(3, [1.0, 2.0], None), (1, [0.5], 4)]
    assert codes(spark, wide(few)) == brute_codes(few)
    assert codes(spark, []) == [] and codes(spark, wide([(1, None, 1), (2, [None], 1)])) == []
    assert codes(spark, wide([(1, [], 1)])) == brute_codes([(1, [], 1)])
    none = veccode.compress(spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>")).collect()
    assert len({r.label_error for r in none}) == 1


def test_codes_stay_exact_beyond_float64(spark):
    """Products near 2^60 need limbs; components near 1e30 need Python's integers, and errors beyond 64 bits are null."""
    rng = np.random.default_rng(2)
    large = [(i, [float(x) for x in rng.integers(-(10**5), 10**5, 16) * 3.7], i % 2) for i in range(70)]
    assert codes(spark, wide(large)) == brute_codes(large)
    huge = [(i, [float((i * 7919 * j) % 1000 - 500) * 10.0 ** (i % 31) for j in range(16)], 0) for i in range(70)]
    got = codes(spark, wide(huge))
    assert got == brute_codes(huge) and any(r[2] is None for r in got) and any(r[2] is not None for r in got)


def test_limbs_and_dots_are_exact():
    rng = np.random.default_rng(3)
    for d in (1, 4, 100, 1000):
        a, b = (rng.integers(-(2**26), 2**26, (5, d)) for _ in range(2))
        assert np.array_equal(veccode.dots(a, b), a @ b.T)
        for bits in (3, 20):
            parts = veccode.limbs(a, bits)
            assert np.array_equal(sum(x.astype(np.int64) << (bits * i) for i, x in enumerate(parts)), a)
            assert max(np.abs(x).max() for x in parts) <= 1 << bits


def test_codes_are_read_back(spark):
    d = spark.read.parquet(f"{DATA}/embeddings.parquet")
    books = veccode.learn(d)
    back = {r.vec_id: (r.error, r.vector) for r in veccode.decode(veccode.encode(d, books), books).collect()}
    for r in d.collect():
        error, v = back[r.vec_id]
        assert sum((math.floor(256 * x) - round(256 * y)) ** 2 for x, y in zip(r.embedding, v, strict=True)) == error


# Filters.


def fails(text, seen):
    w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if x]
    return "".join(k for k, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text), seen), strict=True) if bad)


def brute_audit(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    parts = {}
    for i, t, lang in docs:
        bad = fails(t or "", i is not None and least[t or ""] < i)
        parts.setdefault(lang or "", []).append((bad, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        mine = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                every = sum(f in r[0] for r in rows)
                mine.append([part, order, step, len(left), len(gone), every - len(gone), sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)])
        for row in mine:
            out.append((*row, sum(r[4] for r in mine if r[1][r[2] - 1] == row[1][row[2] - 1])))
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def test_audit_equals_plain_loops(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert audited(queries.op13_filter_audit(spark, DATA)) == brute_audit(docs, labels)


def test_audit_of_odd_rows(spark):
    """Null and empty texts (which are equal), null ids and langs, repeated rows and ids, a very long text, borders of every filter, labels without documents or with nulls, columns named like helpers."""
    words = [f"w{i}" for i in range(200)]
    text = " ".join(words)
    docs = [
        (1, None, None), (2, "", "en"), (None, "", "en"), (0, " \t", ""), (3, text, "en"), (4, text, "de"), (4, text, "de"), (None, text, "en"), (5, " ".join(words[:100] * 2), "en"), (6, " ".join([*words[:99], *words[:99], "x", "x"]), "en"),
        (7, text + " A" * 10, "en"), (8, "é" * 97 + "AAA", "fr"), (9, "é" * 96 + "AAAA", "fr"), (10, "100%", "fr"), (11, "a|b", None), (12, "x y" * 200_000 + " Z*", "long"), (3, "another of three", "en"), (13, "漢字 one\x0btwo", "zh"),
    ]
    labels = [(3, 1, 1), (3, 0, None), (4, 1, 0), (99, 1, 1), (None, 1, 1), (7, None, 1), (2, None, None), (10, 1, 1)]
    d = spark.createDataFrame([(*x, "mine", 1, 2) for x in docs], "doc_id long, text string, lang string, part string, mask int, sha int").repartition(4)
    m = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, first int")
    assert audited(filteraudit.filter_audit(d, m)) == brute_audit(docs, labels)
    assert audited(filteraudit.filter_audit(d, m.where("false"))) == brute_audit(docs, [])
    assert audited(filteraudit.filter_audit(d.where("false"), m)) == []


def test_swaps_lead_through_all_orders():
    for n in range(6):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in filteraudit.plain_changes(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)
    counts = {m: (m * 7 % 11, m % 3, 1) for m in range(32)}
    d = filteraudit.Diagram(counts, 5, 3)
    size = len(d.made)
    for k in (2, 2):
        d.swap(k)
    assert d.order == [0, 1, 2, 3, 4] and d.steps() == filteraudit.Diagram(counts, 5, 3).steps()
    even = filteraudit.Diagram({}, 5, 3)
    assert size > 32 and len(even.made) == 6  # equal branches are one node


# Toxicity.


def test_toxicity_on_held_out_labels(spark):
    path = DATA.replace("0.001", "0.01")
    rows = queries.op11_toxicity(spark, path)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    got = rows.join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id", "left").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    test = [r for r in got if r.held_out and r.toxic is not None]
    assert len(test) > 50 and sum(r.predicted == r.toxic for r in test) >= 0.95 * len(test)
    assert sum(r.predicted == 1 and r.toxic == 0 for r in test) <= 1


@pytest.fixture(scope="module")
def planted(spark):
    """600 texts of common words; every fifth has one of three rare stems, alone in a long text, as `toxic` marks it."""
    rng = np.random.default_rng(4)
    common, rows, labels = [f"w{i}" for i in range(300)], [], []
    for i in range(600):
        w = [common[k] for k in rng.integers(0, 300, 80)]
        if i % 5 == 0:
            w[int(rng.integers(0, 80))] = ("grumbox", "snarfle", "blivet")[i % 3] + ("", "s", "ing", "ed")[i % 4]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.learn(d, spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id < 500"))


def test_planted_insults_and_their_disguises(spark, planted):
    clean = " ".join(f"w{i * 7 % 300}" for i in range(60))
    texts = {"plain": clean + " grumbox", "stem": clean + " snarfled", "capitals": "GRUMBOX! " + clean, "signs": clean + " gr.u.m.b.o.x", "letters": clean + " g r u m b o x", "digits": clean + " bl1v3ts", "long": clean + " snaaaarfle", "clean": clean, "short": "w1", "none": None, "empty": "", "space": " \n\t", "odd": "漢字 \x00 é" * 9}
    d = spark.createDataFrame([(k, t, 3.5, "mine") for k, t in texts.items()], "doc_id string, text string, score double, features string")
    got = {r.doc_id: r for r in toxicity.score(d, planted).collect()}
    assert toxicity.score(d, planted).columns == ["doc_id", "text", "features", "score", "predicted"] and {r.features for r in got.values()} == {"mine"}
    assert {k for k, r in got.items() if r.predicted} >= {"plain", "stem", "capitals"}
    assert not {k for k, r in got.items() if r.predicted} & {"clean", "short", "none", "empty", "space", "odd"}
    x = planted.lexicon
    for k in ("signs", "digits", "long"):
        assert x[texts[k].split()[-1]] & toxicity.DISGUISED_HIT
    assert toxicity.vector(texts["letters"], x)[toxicity.FEATURES.index("spelled")] == 1
    hits = {r.doc_id: [h.word for h in r.hits] for r in toxicity.spans(d, planted).collect()}
    assert "grumbox" in hits["plain"] and "GRUMBOX!" in hits["capitals"] and hits["none"] == hits["empty"] == []


def test_toxicity_of_odd_tables(spark, planted):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (9, 1, 0), (3, None, 0)], "doc_id long, toxic int, part int")
    d = spark.createDataFrame([(1, "bad idiot"), (2, None), (2, "good"), (3, ""), (None, "x"), (1, "bad idiot")], "doc_id long, text string")
    for labels, only in ((some, None), (some.where("toxic = 1"), 1.0), (some.where("toxic = 0"), 0.0), (some.where("false"), 0.5)):
        rows = toxicity.score(d, toxicity.learn(d, labels)).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        assert only is None or {r.score for r in rows} == {only}
    assert toxicity.score(empty, planted).count() == 0 and toxicity.score(empty, toxicity.learn(empty, some)).count() == 0
    long_ = "w1 " * 1_500_000 + "grumbox"
    rows = toxicity.score(spark.createDataFrame([(1, long_), (2, "z" * 700_000)], "doc_id long, text string"), planted).collect()
    assert len(rows) == 2
    v = toxicity.vector(long_, planted.lexicon)
    assert v[toxicity.FEATURES.index("log_hits")] == pytest.approx(math.log(2)) and v[0] == pytest.approx(math.log(1_500_002))


def test_scores_do_not_use_labels_of_held_out_rows(spark):
    """Turning the held-out labels around changes no score."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = langid.held_out(F.col("doc_id"))
    model = lambda marks: toxicity.learn(docs, marks.where(~out).select("doc_id", "toxic"), trees=3)
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, model(m)).collect()} for m in (labels, turned))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)


def test_terms_are_counted_by_part_and_class():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab abc", "ab ab", None]), pa.array([0, 1, 2], pa.int32()), pa.array([1, 0, 1], pa.int32())], names=["text", "part", "y"])
    got = {t: n for b in toxicity._count([batch]) for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert got == {"wab": [0, 1, 1, 0, 0, 0, 0, 0], "wabc": [0, 1, 0, 0, 0, 0, 0, 0]}
