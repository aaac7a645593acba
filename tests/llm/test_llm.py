"""The operators against brute force on small tables, and their edge cases."""

from __future__ import annotations

import shutil
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxelframe.llm import classlm, cotrain, decontam, langid, minhash, mixing, multiindex, queries, sharding, substring, urlfilter
from voxelframe.llm.components import components

from . import brute

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
W = [f"word{i}" for i in range(400)]
LONG = " ".join(W[i * 7 % 400] + str(i % 13) for i in range(30_000))
EDGES = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", None, None, 3), (4, "one", "en", "a", 3), (5, "one", "en", "a", 3), (None, "no id here at all", "en", None, 17),
    (6, " ".join(W[:60]), "en", "b", 1), (7, " ".join(W[:60]), "en", "b", 1), (7, " ".join(W[:60]), "en", "b", 1), (8, " ".join([*W[:55], "x", "y"]), "de", "b", 1),
    (9, LONG, "en", "b", len(LONG)), (10, "a " * 40, None, "c", 80), (11, "a " * 40 + "b", None, "c", 81), (12, "été ÀÉ 漢字 \x00 ok", "fr", "c", 12),
]


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select(cols[0], *cols[1:]).collect()}


def known(rows):
    return [(i, t) for i, t, *_ in rows if i is not None]


def test_language_held_out_accuracy(spark):
    p = queries.op1_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert p.where("held_out and lang_pred <> lang").count() <= 0.02 * p.where("held_out").count()
    assert p.where("score < 0 or score > 1").count() == 0


def test_language_edges(edges, empty):
    langs, model = langid.learn(edges.select("lang", "text"))
    got = by_id(langid.predict(edges, langs, model), "doc_id", "lang_pred")
    assert got[1] == got[2] == got[3] == ("und",) and got[9] == ("en",) and len(got) == 13
    assert langid.predict(edges, *langid.learn(empty)).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(empty, langs, model).count() == 0


def test_mixed_text_has_both_languages():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(500, 0.1), 3).T
    n = np.round(3000 * (0.7 * p[:, 0] + 0.3 * p[:, 2])).astype(float)
    k, share, _ = langid.infer(np.log(p + 1e-9), np.arange(500)[n > 0], n[n > 0])
    assert k == 0 and abs(share - 0.7) < 0.05


def test_near_duplicates_equal_brute_force(spark, docs):
    assert by_id(queries.op2_minhash(spark, DATA), "doc_id", "n_shingles", "component_id", "kept") == brute.op2(docs)


def test_near_duplicates_in_chains_and_hot_groups(spark):
    """A base with hundreds of edited copies, and a chain whose ends are unlike."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(250):
        w = list(W[:110])
        for j in rng.choice(110, rng.integers(1, 7), replace=False):
            w[j] = f"e{i}_{j}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + k, " ".join(W[200 + 4 * k : 280 + 4 * k])) for k in range(12)]
    got = by_id(minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.op2(rows)


def test_near_duplicate_edges(edges, empty):
    got = minhash.classes(edges)
    assert got.count() == len(EDGES) and minhash.classes(empty).count() == 0
    want = brute.op2(known(EDGES))
    assert by_id(got.where("doc_id is not null"), "doc_id", "n_shingles", "component_id", "kept") == want
    assert got.where("doc_id is null and kept").count() == 1


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.r_[a[:800], rng.integers(0, 2**63, 100).astype(np.uint64)]
    same = (minhash.sketch(np.unique(a)) == minhash.sketch(np.unique(b))).mean()
    assert abs(same - 0.8) < 0.12 and (minhash.sketch(a[:1]) != 2**64 - 1).all()


def test_components(spark):
    rng = np.random.default_rng(2)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    got = by_id(components(spark.createDataFrame(e, "a long, b long")), "node", "component")
    want = brute.components({x for p in e for x in p}, e)
    assert all(got.get(n, (n,)) == (c,) for n, c in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_dedup_equals_brute_force(spark, docs, edges, empty):
    assert by_id(queries.op4_substring_dedup(spark, DATA), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.op4(docs)
    got = substring.dedup(edges)
    assert got.count() == len(EDGES) and substring.dedup(empty).count() == 0
    assert by_id(got.where("doc_id is not null"), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.op4(known(EDGES))


def test_every_window_has_a_symbol_start():
    rng = np.random.default_rng(5)
    for high in (2, 5, 10**6):
        assert (substring.anchors(rng.integers(0, high, 3000).astype(np.uint64)) != 2**64 - 1).all()


def test_mixing(spark, edges, empty):
    rows = queries.op5_mixing(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    sizes, took = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        took[r.source] = took.get(r.source, 0) + r.taken
        assert r.taken <= 3 * r.size
    want = brute.targets(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in rows)
    assert all(abs(took[s] - t) <= 3 for s, t in want.items())
    got = mixing.taken(edges)
    assert got.count() == len(EDGES) and mixing.taken(empty).count() == 0
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.taken(edges.repartition(5)).collect()))
    mix = mixing.mixed(edges)
    assert mix.columns == edges.columns
    assert sum(len(brute.words(r.text)) for r in mix.collect()) == sum(r.taken for r in got.collect())


def test_sharding(spark, edges, empty):
    for frame, n in ((spark.read.parquet(f"{DATA}/documents.parquet"), 200), (edges, len(EDGES))):
        rows = sharding.shard(frame, shards=7).collect()
        slots = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
            text = (r.text or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "rows", None)
        assert len(rows) == n and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        assert sorted(map(str, rows)) == sorted(map(str, sharding.shard(frame.repartition(5), shards=7).collect()))
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 1000])
def test_feistel_is_a_permutation(spark, n):
    once, perm = sharding.feistel(F.col("id"), n, 5)
    assert sorted(r[0] for r in spark.range(n).withColumn("_once", once).select(perm).collect()) == list(range(n))


def test_decontamination(spark, docs, edges, empty):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(queries.op7_decontamination(spark, DATA), *cols) == {r[0]: r[1:] for r in brute.op7(docs, items)}
    bench = [(1, " ".join(W[20:40])), (2, "ONE"), (3, None), (4, "..."), (5, "été"), (10, " ".join(W[25:38]))]
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert by_id(decontam.judged(edges, b).where("doc_id is not null"), *cols) == {r[0]: r[1:] for r in brute.op7(known(EDGES), bench)}
    kept = decontam.decontaminate(edges, b)
    assert {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 9, 10, 11}
    assert decontam.decontaminate(edges, b.where("false")).count() == len(EDGES)
    assert decontam.judged(empty, b).count() == 0
    clean = by_id(decontam.remove_spans(edges, b), "doc_id", "clean_words")
    assert clean[6][0] == [*W[:20], *W[40:60]]


def test_class_model(spark, docs):
    want = brute.op8_base(docs)
    rows = queries.op8_class_lm(spark, DATA).collect()
    for r in rows:
        held, n, k, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, k, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    test = [r for r in rows if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_class_model_by_a_small_head_and_edges(spark, edges, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60")
    train = docs.where("doc_id % 3 > 0").select("text")
    big = by_id(classlm.score(docs, classlm.learn(train, clustered=8, classes=3)), "doc_id", "n_known", "base_score", "score")
    small = by_id(classlm.score(docs, classlm.learn(train, clustered=8, classes=3, head=60)), "doc_id", "n_known", "base_score", "score")
    assert all(a == pytest.approx(small[i], rel=1e-9) for i, a in big.items())
    assert classlm.score(empty, classlm.learn(edges)).count() == 0
    assert classlm.score(edges, classlm.learn(empty)).count() == len(EDGES)


def test_class_model_takes_texts_in_small_pieces(monkeypatch):
    """A worker's words and their numbers take many times their texts' bytes, so of a large batch a few whole texts are taken at once; nothing is lost or counted twice."""
    texts = [None, b"", *(b" ".join(b"w%d" % (i * j % 97) for j in range(i % 50 * 9)) for i in range(400)), b"long " * 3_000, b"x"]
    head = pa.array([b"", *(b"w%d" % i for i in range(40))], pa.binary())
    cls, one = np.arange(len(head) + 1, dtype=np.int32) % 3, np.ones((4, 4))
    shared = lambda *x: type("Shared", (), {"value": x[0] if len(x) == 1 else x})
    ids = pa.array(range(len(texts)))
    plain, rows = pa.record_batch([pa.array(texts, pa.binary())], ["t"]), pa.record_batch([ids, ids, pa.array(texts, pa.binary())], ["row", "doc_id", "t"])
    seen, given = [], classlm.tokens
    monkeypatch.setattr(classlm, "tokens", lambda x: (seen.append([len(i or b"") for i in x.to_pylist()]), given(x))[1])

    def found(run, batch):
        return pa.Table.from_batches(run(iter([batch, batch.slice(0, 0)]))).to_pylist()

    def results():
        counts, pairs, tail = {}, {}, {}
        for r in found(classlm._count, plain):
            counts[r["word"]] = counts.get(r["word"], 0) + r["n"]
        for r in found(classlm._pairs(shared(head)), plain):
            for c, n in zip(np.frombuffer(r["c"], np.int32), np.frombuffer(r["n"], np.int32), strict=True):
                pairs[r["w"], r["side"], c] = pairs.get((r["w"], r["side"], c), 0) + n
        for r in found(classlm._tail(shared(head, cls), 3), plain):
            for c, n in zip(np.frombuffer(r["code"], np.int32), np.frombuffer(r["n"], np.int32), strict=True):
                tail[r["word"], c] = tail.get((r["word"], c), 0) + n
            tail[r["word"]] = sorted(tail.get(r["word"], []) + r["prev"])
        return counts, pairs, tail, found(classlm._score(shared(head, np.ones(len(head)), cls[:-1].astype(int), one, np.ones(4), 5.0, 9.0)), rows)

    words = [w for x in texts for w in (x or b"").split()]
    small = 8_000
    monkeypatch.setattr(classlm, "PIECE", small)
    monkeypatch.setattr(classlm, "REST", 500)
    monkeypatch.setattr(classlm, "TOKENS", 5_000)
    got = results()
    assert len(seen) > 100 and all(sum(x) <= small or len(x) == 1 for x in seen)
    assert got[0] == {w: words.count(w) for w in {*words}} | {b"": len(texts)}
    monkeypatch.setattr(classlm, "PIECE", 1 << 40)
    assert got == results()


def test_class_model_sums_to_one(spark):
    d = spark.createDataFrame([(1, "a b c a b"), (2, "b c")], "doc_id long, text string")
    m = classlm.learn(d, clustered=3, classes=2)
    probe = spark.createDataFrame([(i, w) for i, w in enumerate(["a", "b", "c", "zzz", ""])], "doc_id long, text string")
    got = {r.doc_id: r.score for r in classlm.score(probe, m).collect()}
    assert all(s < 0 for s in got.values()) and got[3] < got[1]
    # Over the known words and the one unknown place, the first token's probabilities sum to one.
    ids = {w: (n, c) for w, n, c in m.head}
    share = (m.in_class + 1) / (m.in_class + 1).sum()
    step = (m.n + share[None, :]) / (m.n.sum(1, keepdims=True) + 1)
    row, tail = step[ids[b""][1]], len(m.in_class) - 1
    rare = m.in_class[-1] + m.distinct - sum(c < tail for _, c in ids.values()) + 1
    total = sum(row[c] * (n / m.in_class[c] if c < tail else (n + 1) / rare) for n, c in ids.values()) + row[tail] / rare
    assert total == pytest.approx(1, abs=1e-9)


def test_class_model_clusters_every_word(spark):
    """Beyond 4,000 words too: two kinds of words take turns, so the classes of a good fit tell them apart."""
    rng = np.random.default_rng(1)
    a, b = [f"a{i}" for i in range(3_000)], [f"b{i}" for i in range(3_000)]
    texts = [(" ".join(w for x, y in zip(rng.choice(a, 100), rng.choice(b, 100), strict=True) for w in (x, y)),) for _ in range(600)]
    m = classlm.learn(spark.createDataFrame(texts, "text string"), classes=4)
    of = {bytes(r.word): r.c for r in m.counts.collect()}
    assert len(of) == m.distinct == m.clustered > 4_001 and set(of.values()) <= set(range(4)) and m.in_class[-1] == 0
    kinds = [{c: sum(of[w.encode()] == c for w in ws) for c in range(4)} for ws in (a, b)]
    assert sum(min(kinds[0][c], kinds[1][c]) for c in range(4)) < 1_500  # by chance about 2,900
    assert len(classlm.learn(spark.createDataFrame([(" ".join(f"w{i}" for i in range(150_000)),)], "text string"), exchanges=0).in_class) > 50


def test_class_gains_are_the_likelihood_s():
    rng = np.random.default_rng(2)
    w, k = 12, 4
    n, of = rng.integers(0, 30, (w, w)) * (rng.random((w, w)) < 0.5), rng.integers(0, k, w)
    joint = lambda of: np.array([[n[np.ix_(of == a, of == b)].sum() for b in range(k + 1)] for a in range(k + 1)], float)
    now = joint(of)
    table = np.stack([[classlm._rise(g, float(v)) for v in range(1, classlm.LEVELS + 1)] for g in (now, now.T)])
    for i in range(w):
        entries = [(0, of[j], n[j, i]) for j in range(w) if j != i and n[j, i]] + [(1, of[j], n[i, j]) for j in range(w) if j != i and n[i, j]] + [(2, -1, n[i, i])] * int(n[i, i] > 0)
        merged: dict = {}
        for s, c, v in entries:
            merged[s, c] = merged.get((s, c), 0) + v
        side, c, v = (np.array(x) for x in zip(*[(s, c, v) for (s, c), v in merged.items()], strict=True))
        got = classlm.gains(now, table, of[[i]], np.zeros(len(v), int), side, c, v.astype(float))[0]
        for to in range(k):
            moved = of.copy()
            moved[i] = to
            assert got[to] - got[of[i]] == pytest.approx(classlm.likelihood(joint(moved)) - classlm.likelihood(now), abs=1e-6)


@pytest.mark.parametrize("head", [60, 100_000])
def test_class_scores_equal_a_plain_model(spark, docs, head):
    """Every class count and score follows from the words' classes; every exchange raised the likelihood; words beyond the head have classes too."""
    train, test = docs[:60], [*docs[60:75], (-1, None), (-2, ""), (-3, "zzz yyy zzz"), (-4, docs[0][1]), (-4, docs[0][1])]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    m = classlm.learn(frame(train).select("text"), classes=5, head=head)
    of = {bytes(r.word).decode(): (r.n, r.c) for r in m.counts.collect()}
    assert {w: n for w, (n, _) in of.items()} == brute.word_counts(train) and {c for _, c in of.values()} <= set(range(5))
    assert all(a < b for a, b in zip(m.rising, m.rising[1:])) and len(m.rising) > 1
    joint, want = brute.class_model(train, test, of, 5)
    assert np.array_equal(m.n, joint)
    got = sorted((r.doc_id, r.score) for r in classlm.score(frame(test), m).collect())
    for (i, a), (j, b) in zip(got, sorted(want), strict=True):
        assert i == j and a == pytest.approx(b, rel=1e-9)


def test_fingerprints_are_spark_s(spark):
    words = [b"", b"a", b"word", "größe".encode(), b"x" * 100]
    got = spark.createDataFrame([(i, bytearray(w)) for i, w in enumerate(words)], "i int, w binary").selectExpr("i", "xxhash64(w) h").collect()
    assert all(r.h % 2**64 == classlm.fingerprint(words[r.i]) for r in got)


def test_url_filter(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    urls = [(r.page_id, r.url) for r in pages.collect()] + [(-1, None), (-2, "no scheme"), (-3, "http://"), (-4, "HTTP://WWW.A.Com/en/7?x#y"), (-5, "http://com/en/"), (-6, "http://xcom/en/"), (-7, "http://b.example.com/en/7://z")]
    listed = [(u.split("://")[1].split("?")[0].split("#")[0].rstrip("/"),) for i, u in urls if u and "://" in u and i % 3 == 0] + [(None,)]
    got = urlfilter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(listed, "canon string")).collect()
    names, on_list = dict(urls), {x for (x,) in listed}
    for r in got:
        host, path, rule, verdict = brute.op9(names[r.page_id])
        canon = (host[4:] if host.startswith("www.") else host) + path.rstrip("/")
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if canon in on_list else "allow"))
    assert len(got) == len(urls)
    assert urlfilter.filter_urls(pages.where("false"), urlfilter.thin_pages(pages)).count() == 0
    assert urlfilter.filter_urls(pages, pages.where("false").select(F.col("url").alias("canon"))).count() == 50


def test_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    rng = np.random.default_rng(4)
    more = [(10_000 + 20 * i + j, [float(x + 0.03 * y) for x, y in zip(rows[i][1], rng.normal(size=64), strict=True)]) for i in range(30) for j in range(4)]
    odd = [(20_000, None), (20_001, []), (20_002, [0.0] * 64), (20_003, [float("nan")] * 64), (20_004, [None] + [1.0] * 63), (20_005, rows[5][1]), (20_006, rows[5][1])]
    every = rows + more + odd
    got = by_id(multiindex.near_duplicates(spark.createDataFrame(every, "vec_id long, embedding array<float>")), "vec_id", "n_links", "component_id", "kept")
    want = brute.op10([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in every])
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert set(got) == set(want) and there > 300 and 0.99 * there <= found <= there
    assert multiindex.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_quality(spark, edges, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = queries.op3_quality(spark, DATA).join(labels, "doc_id")
    assert got.where("quality_pred = quality").count() >= 0.9 * got.count()
    some = spark.createDataFrame([(6, 1, 0), (8, 0, 0), (9, 0, 0), (4, 1, 0), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert cotrain.cotrain(edges, some).count() == len(EDGES)
    assert cotrain.cotrain(edges, some.where("false")).where("score <> 0.5").count() == 0
    assert cotrain.cotrain(empty, some).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    d = docs
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, d, DATA)
        rows, before = out.collect(), [(r.doc_id, r.text) for r in d.collect()]
        if name == "near_dedup":
            assert {r.doc_id for r in rows} == {i for i, v in brute.op2(before, 5).items() if v[2]}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert {r.doc_id for r in rows} == {x[0] for x in brute.op7(before, items) if not x[5]}
        if name != "sharding":
            assert out.columns == docs.columns
        d = spark.createDataFrame(rows, out.schema)
    assert corpus_pipeline.run(spark, DATA).count() == len(rows)


def test_clean_texts_stay_where_another_of_their_id_goes(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = corpus_pipeline.language_id(spark, docs, DATA).where("length(text) > 300").orderBy("doc_id").first()
    odd = [good.asDict() | {"doc_id": i, "text": t} for i, t in ((None, good.text), (None, None), (good.doc_id, "1234"))]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    got = [(r.doc_id, r.text) for r in corpus_pipeline.language_id(spark, both, DATA).collect()]
    assert (None, good.text) in got and (good.doc_id, good.text) in got
    assert (None, None) not in got and (good.doc_id, "1234") not in got
    a, b, c = (" ".join(W[i : i + 30]) for i in (0, 30, 60))
    near = spark.createDataFrame([(3, b), (7, a), (7, b), (8, c), (8, a + " x"), (None, b)], "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, near, DATA).collect()}
    assert {(3, b), (8, c), (None, b)} <= kept and (7, b) not in kept
    assert len({(7, a), (8, a + " x")} & kept) == 1 and len(kept) == 4


def test_stages_on_edges(spark, edges, empty):
    for frame in (edges, empty):
        for _, f in corpus_pipeline.STAGES:
            f(spark, frame, DATA).collect()


def test_shards_are_written_in_slot_order(spark, edges, tmp_path):
    sharding.write_shards(sharding.shard(edges, shards=3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(EDGES)
    shutil.rmtree(tmp_path / "out")


def test_substring_hot_symbols_and_chance_names(spark, monkeypatch):
    """A passage and near copies in most documents, split over many batches; and names so short that unlike contents share them: both as brute force has it."""
    rng = np.random.default_rng(7)
    passage, rows = W[:60], []
    for i in range(400):
        w = list(passage)
        for j in rng.choice(60, rng.integers(0, 3), replace=False):
            w[j] = f"e{i}_{j}"
        rows.append((int(rng.permutation(10_000)[0]) * 400 + i, " ".join([f"h{i}{j}" for j in range(rng.integers(0, 9))] + w + W[100 : 100 + rng.integers(0, 20)])))
    rows += [(10**7 + i, "x " * (13 * i) + "y") for i in range(1, 6)]
    want = brute.op4(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    cols = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert by_id(substring.dedup(d.repartition(7), texts=False), *cols) == want
    ids, texts = zip(*rows[:60], strict=True)
    monkeypatch.setattr(substring, "mix64", lambda x: x & np.uint64(0x3F))
    docs = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([t.encode() for t in texts], pa.binary()), pa.array([False] * 60), pa.array([0] * 60, pa.int32())], names=["doc", "t", "copy", "nth"])
    b = substring.Batch(*docs.columns[:3])
    keys = [np.unique(b.key[b.row == i]).view(np.int64).tolist() for i in range(60)]
    parts = pa.Table.from_batches(substring._stretches([docs.append_column("keys", pa.array(keys, pa.list_(pa.int64())))])).to_pandas()
    parts["known"] = parts["words"].isna()
    assert len(parts)
    gone = {(r.doc, r.at + k) for r in parts[parts.known].itertuples() for k in range(r.n)}
    for _, g in parts[~parts.known].sort_values(["key", "doc"]).groupby("key"):
        gone |= {(doc, at + k) for doc, at, n in substring._group(list(g[["doc", "at", "n", "words"]].itertuples(index=False, name=None))) for k in range(n)}
    first: dict = {}
    for i, t in sorted(rows[:60]):
        for k in range(len(t.split()) - 12):
            first.setdefault(tuple(t.split()[k : k + 13]), i)
    assert gone == {(i, k) for i, t in rows[:60] for k in range(len(t.split()) - 12) if first[tuple(t.split()[k : k + 13])] < i}


def test_url_filter_shuffles_only_what_the_filter_passes(spark):
    """Most pages are on no list and meet in no task; a third have one listed URL."""
    urls = [(i, "http://hot.example.edu/x/" if i % 3 == 0 else f"http://h{i}.edu/p{i}") for i in range(3_000)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    listed = spark.createDataFrame([("hot.example.edu/x",), (None,), ("",)], "canon string")
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(pages, listed).collect()}
    assert got == {i: "block" if i % 3 == 0 else "allow" for i, _ in urls}
    long_ = spark.createDataFrame([(1, "http://a.edu/" + "y" * 300_000), (1, "http://a.edu/" + "y" * 300_000), (2, None)], "page_id long, url string")
    assert [r.verdict for r in urlfilter.filter_urls(long_, listed).orderBy("page_id").collect()] == ["allow", "allow", "block"]


def test_clashing_columns_stay(spark):
    """Columns named like the operators' own results or helpers."""
    rows = [(i, " ".join(W[: 5 + i % 40]), "en", f"s{i % 3}", 9, 999, 7.5, "p", i, "b") for i in range(60)]
    d = spark.createDataFrame(rows, SCHEMA + ", size long, target double, pass string, row_number long, block string")
    mix = mixing.mixed(d)
    assert mix.columns == d.columns and {(r.size, r.target, r["pass"]) for r in mix.collect()} == {(999, 7.5, "p")}
    assert all(r.n_chars == len(r.text) for r in mix.collect() if r.text not in {x[1] for x in rows})
    got = sharding.shard(d)
    assert {r.row_number for r in got.collect()} == set(range(60)) and {r.target for r in got.collect()} == {7.5}
    assert substring.dedup(d).count() == minhash.classes(d).count() == 60
    p = d.selectExpr("doc_id page_id", "'http://a.edu/' url", "block", "'mine' verdict")
    assert {(r.block, r.verdict) for r in urlfilter.filter_urls(p, p.selectExpr("'' canon")).collect()} == {("b", "allow")}


def test_texts_of_one_id_keep_their_links(spark):
    a, b = (" ".join(W[i : i + 60]) for i in (0, 60))
    d = spark.createDataFrame([(1, a), (1, b), (6, b), (6, a), (7, a + " x"), (8, b + " y")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.classes(d).collect()} == {1: 1, 6: 1, 7: 1, 8: 1}
    u, v = [1.0, 0.0, 0.1, 0.0], [0.0, 1.0, 0.0, 0.1]
    e = spark.createDataFrame([(3, u), (3, v), (5, [1.0, 0.01, 0.1, 0.0]), (9, [0.0, 1.0, 0.02, 0.1])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in multiindex.near_duplicates(e).collect())
    assert got == [(3, 1, 3), (3, 1, 3), (5, 1, 3), (9, 1, 3)]


def test_star_centres_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PARTNERS", 5)
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(x if rng.random() > 0.02 or i == 0 else f"e{i}" for x in W[:150])) for i in range(80)]
    got = by_id(minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.op2(rows)


def test_multi_sequence_visits_the_nearest_cells():
    rng = np.random.default_rng(9)
    x, one, two = rng.normal(size=(40, 6)), rng.normal(size=(9, 3)), rng.normal(size=(7, 3))
    for visits in (1, 5, 20, 63):
        got = multiindex.multi_sequence(x, one, two, visits)
        d = (multiindex.distances(x[:, :3], one) ** 2)[:, :, None] + (multiindex.distances(x[:, 3:], two) ** 2)[:, None, :]
        assert np.array_equal(got, np.argsort(d.reshape(40, -1), 1, kind="stable")[:, :visits])


def test_embedding_recall_on_a_large_table(spark):
    """20,000 vectors, a group of 3,000 near copies among them, whose links are counted and not expanded."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(20_000, 24))
    x[5_000:8_000] = x[0] + 0.15 * rng.normal(size=(3_000, 24))
    x[9_000:12_000] = x[12_000:15_000] + 0.35 * rng.normal(size=(3_000, 24))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = by_id(multiindex.near_duplicates(d), "vec_id", "n_links", "component_id")
    y = x / np.sqrt((x * x).sum(1, keepdims=True))
    there = sum(int((y[at : at + 1_000] @ y.T >= 0.9).sum()) - 1_000 for at in range(0, 20_000, 1_000))
    found = sum(n for n, _ in got.values())
    assert there > 4_000_000 and 0.97 * there <= found <= there
    assert sum(c == 0 for _, c in got.values()) > 2_900


def test_quality_on_held_out_labels_and_odd_texts(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    got = cotrain.cotrain(docs, labels.where(~out)).join(labels.where(out), "doc_id")
    assert got.where("quality_pred = quality").count() >= 0.9 * got.count() > 0
    odd = spark.createDataFrame([(1, "z" * 700_000, "en", "a", 1), (2, "a b c. d e f", "en", "a", 1), (2, "a b c. d e f", "en", "a", 1), (3, None, None, None, None)], SCHEMA)
    some = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    rows = cotrain.cotrain(odd, some).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
