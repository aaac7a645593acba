"""Quality classifier by co-training: a text view and a metadata view teach each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Labelled rows that the classifiers are fitted on at most (least hash first), and pseudo-labels that one view gives the other a round and class.
LABELLED, GIVEN, ROUNDS = 20_000, 500, 3
TEXT, META = 272, 40
STYLE = 16
#: A pseudo-label needs at least this confidence.
SURE = 0.9


def text_features(text: bytes | None) -> np.ndarray:
    """Hashed word shares (signed) and style: line and word lengths, repeats, symbols, digits, capitals."""
    v = np.zeros(TEXT, np.float32)
    words = (text or b"").split()
    if not words:
        return v
    low = (text or b"").lower().split()
    first: dict[bytes, int] = {}
    for w in low:
        first[w] = first.get(w, 0) + 1
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in first), np.uint64, len(first))
    n = np.sqrt(np.fromiter(first.values(), np.float64, len(first)))
    sign = np.where(h & np.uint64(1), 1.0, -1.0)
    hashed = np.bincount(((h >> np.uint64(1)) % np.uint64(TEXT - STYLE)).astype(np.int64), n * sign, TEXT - STYLE)
    v[STYLE:] = hashed / max(1.0, np.sqrt((n * n).sum()))
    b = np.frombuffer(text, np.uint8)
    size, lines = len(b), (text or b"").split(b"\n")
    kinds = np.bincount(b, minlength=256) / size
    v[0] = np.log1p(len(words)) / 10
    v[1] = len(first) / len(words)
    v[2] = max(first.values()) / len(words)
    v[3] = np.log1p(size / len(words)) / 2
    v[4] = np.log1p(len(lines)) / 5
    v[5] = len(set(lines)) / len(lines)
    v[6] = kinds[48:58].sum() * 5
    v[7] = kinds[65:91].sum() * 5
    v[8] = (kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()) * 5
    v[9] = (kinds[46] + kinds[33] + kinds[63]) * 20
    v[10] = kinds[128:].sum() * 5
    v[11] = (kinds[124] + kinds[35] + kinds[36] + kinds[37] + kinds[38] + kinds[42] + kinds[64]) * 20
    v[12] = kinds[44] * 20
    v[13] = min(1.0, size / 200)
    return v


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """One-hot hashes of language and source, and the page's size."""
    v = np.zeros(META, np.float32)
    v[xxhash.xxh3_64_intdigest(f"l{lang}") % 8] = 1
    v[8 + xxhash.xxh3_64_intdigest(f"s{source}") % 24] = 1
    x = np.log1p(max(0, n_chars or 0)) / 10
    v[32:36] = x, x * x, n_chars is None, x < 0.5
    return v


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        t = [text_features(x).astype(np.float16).tobytes() for x in cols[1]]
        m = [meta_features(*x).astype(np.float16).tobytes() for x in zip(*cols[2:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t, pa.binary()), pa.array(m, pa.binary())], names=["doc_id", "t", "m"])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, t, m): both views of every whole text, 624 bytes a document."""
    cols = ["doc_id", F.col("text").cast("binary").alias("text"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars")]
    return docs.select(*cols).mapInArrow(_features, f"doc_id {dict(docs.dtypes)['doc_id']}, t binary, m binary")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps, classes weighted equally; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    w = np.zeros(x.shape[1])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + ridge * w
        h = (x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling of a view's margin."""
    w = logistic(score[:, None], y, 1e-3)
    return float(w[0]), float(w[1])


def unpack(rows: list) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), -1).astype(np.float64)


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, mix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            z = [a * margin(unpack(batch.column(i + 1).to_pylist()), w) + b for i, (w, (a, b)) in enumerate(views)]
            p = [1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (*z, mix[0] * z[0] + mix[1] * z[1] + mix[2])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p)], names=["doc_id", "text_score", "meta_score", "score"])

    return run


def cotrain(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, most: int = LABELLED, given: int = GIVEN) -> DataFrame:
    """Per row of docs: doc_id, text_score, meta_score, score, quality_pred.

    labels(doc_id, quality): at most `most` labelled documents, those of least
    hash, fit the first classifiers; a fifth of them is kept for calibration.
    Each round both views score all documents, and each gives the other its most
    confident pseudo-labels (at most `given` a class and round, above SURE) among
    the unlabelled. Calibrated margins are then combined by a third regression and
    score every document. Texts are read once, for the features, which are bounded
    however long a text or word is; the rounds scan 624 bytes a document. Ties in
    confidence fall to a hash of the id, then the id; repeated rows are scored each. Null texts and metadata have features of their own; a
    label without a document or with null quality is ignored, repeated labels of a
    document count by their mean, rounded; with labels of one class only, or none,
    every score is that class's (none: 0.5).
    """
    spark = docs.sparkSession
    f = stored(features(docs))
    kind = dict(docs.dtypes)["doc_id"]
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("y"))
    known = stored(known)
    # The sample is drawn from the labels and broadcast (at most `most` ids), so features are not shuffled.
    some = F.broadcast(known.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(most))
    rows = f.join(some, "doc_id").orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(most).select("t", "m", "y").collect()
    y = np.array([r.y for r in rows], float)
    if len(set(y)) < 2:
        p = F.lit(float(y[0]) if len(y) else 0.5)
        return f.select("doc_id", p.alias("text_score"), p.alias("meta_score"), p.alias("score"), (p >= 0.5).cast("int").alias("quality_pred"))
    x = [unpack([r.t for r in rows]), unpack([r.m for r in rows])]
    check = np.arange(len(y)) % 5 == 4
    if len(set(y[check])) < 2 or len(set(y[~check])) < 2:
        check = np.zeros(len(y), bool)
    fit, test = ~check, check if check.any() else ~check
    pool = [[a[fit] for a in x], [y[fit], y[fit]]]
    for turn in range(rounds + 1):
        views = []
        for i in range(2):
            w = logistic(pool[0][i], pool[1][i])
            views.append((w, calibrate(margin(x[i][test], w), y[test])))
        if turn == rounds:
            break
        state = spark.sparkContext.broadcast((views, (0.5, 0.5, 0.0)))
        scored = f.mapInArrow(_score(state), f"doc_id {kind}, text_score double, meta_score double, score double").drop("score")
        # Only ids and scores meet the labels' ids, once a round.
        scored = scored.where(" or ".join(f"{v}_score >= {SURE} or 1 - {v}_score >= {SURE}" for v in ("text", "meta"))).join(known.select("doc_id"), "doc_id", "left_anti").persist()
        sure = None
        for i, name in enumerate(("text_score", "meta_score")):
            for label in (0, 1):
                p = F.col(name) if label else 1 - F.col(name)
                best = scored.where(p >= SURE).orderBy(p.desc(), F.xxhash64("doc_id"), "doc_id").limit(given).select("doc_id", F.lit(1 - i).alias("to"), F.lit(label).alias("y"))
                sure = best if sure is None else sure.union(best)
        taught = f.join(F.broadcast(sure), "doc_id").select("t", "m", "to", "y").collect()
        scored.unpersist()
        for i in range(2):
            mine = [r for r in taught if r.to == i]
            if mine:
                # Pseudo-labels of the round replace those of the round before.
                pool[0][i] = np.r_[x[i][fit], unpack([r[i] for r in mine])]
                pool[1][i] = np.r_[y[fit], [r.y for r in mine]]
    z = np.c_[tuple(a * margin(x[i][test], w) + b for i, (w, (a, b)) in enumerate(views))]
    mix = logistic(z, y[test], 1e-2)
    state = spark.sparkContext.broadcast((views, tuple(map(float, mix))))
    out = f.mapInArrow(_score(state), f"doc_id {kind}, text_score double, meta_score double, score double")
    return out.withColumn("quality_pred", (F.col("score") >= 0.5).cast("int"))
