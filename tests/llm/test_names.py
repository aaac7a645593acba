"""Columns named like any helper, and benchmark items without an id."""

from __future__ import annotations

import pytest

import corpus_pipeline
from voxelframe.llm import cotrain, decontam, filteraudit, langid, minhash, multiindex, toxicity, veccode

DATA = "/root/testdata/sf0.001"
W = [f"word{i}" for i in range(300)]
NAMES = "_id _sha _key _own _text _t _n _h _p _hash _words _items positions items copies key own id sha doc least n y part weight features x p m first mask good label text_score score_ lang_pred".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(W[10 * i : 10 * i + 40]), "en", "s", 9, *[f"{c}{i}" for c in NAMES]) for i in range(20)]
    rows += [(30, rows[3][1] + " x", *rows[3][2:]), (3, "another text of three", *rows[3][2:]), (None, None, None, None, None, *rows[0][5:])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES))


def untouched(rows):
    return all(r[c] == f"{c}{r[c][len(c):]}" for r in rows for c in NAMES)


def test_near_duplicates_and_spans(spark, docs):
    got = minhash.near_duplicates_removed(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == 22 and untouched(rows)
    assert sum((r.text or "").startswith(" ".join(W[30:70])) for r in rows) == 1 and {r.doc_id for r in rows} - {30} == {*range(20), None}
    items = spark.createDataFrame([(1, " ".join(W[5:25]), "b", "c"), (None, " ".join(W[200:230]), "b", "c")], "item_id long, text string, positions string, _words string")
    clean = decontam.remove_spans(docs, items)
    assert clean.columns == [*docs.columns, "clean_words"]
    rows = {(r.doc_id, r.text): r for r in clean.collect()}
    assert len(rows) == 23 and untouched(rows.values())
    assert rows[0, " ".join(W[:40])].clean_words == [*W[:5], *W[25:40]] and rows[None, None].clean_words == []
    kept = decontam.decontaminate(docs, items)
    assert kept.columns == docs.columns and untouched(kept.collect())


def test_items_without_an_id_are_no_items(spark, docs):
    items = spark.createDataFrame([(None, " ".join(W[:40])), (None, None)], "item_id long, text string")
    rows = decontam.judged(docs, items).collect()
    assert len(rows) == 23 and all((r.n_hit, r.n_items, r.contaminated) == (0, 0, False) for r in rows)


def test_the_other_operators(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0), "z", 5) for i in range(20)], "doc_id long, quality int, toxic int, y string, part int")
    got = corpus_pipeline.language_id(spark, docs, DATA)
    assert got.columns == docs.columns and untouched(got.collect())
    assert langid.predict(docs, *langid.learn(docs.select("lang", "text"))).count() == 23
    assert cotrain.cotrain(docs, labels).count() == 23
    assert filteraudit.filter_audit(docs, labels).count() == 2 * 600
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    assert scored.columns == [*docs.columns, "score", "predicted"] and untouched(scored.collect())
    v = spark.createDataFrame([(i, [1.0, float(i)], i, "a", "b") for i in range(9)], "vec_id long, embedding array<double>, label int, code string, vector string")
    assert veccode.compress(v).count() == multiindex.near_duplicates(v).count() == 9
