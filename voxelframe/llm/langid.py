"""Language identification by multilingual mixture inference (EM over n-gram likelihoods)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Byte trigrams are hashed into so many bins.
BINS = 1 << 15
#: More learned languages than this raise an error: the model (BINS x languages) is broadcast.
MOST_LANGUAGES = 512
#: EM ends when no proportion moves by more than SETTLED; a text that takes so many rounds is used as it stands.
EM_ROUNDS, SETTLED = 500, 1e-4
#: A language joins the set if it raises the log-likelihood by more than this times ln(n-grams).
PENALTY = 3.0

_MAP = np.full(256, 32, np.uint8)
for _b in range(256):
    if chr(_b).isalpha() and _b < 128 or _b >= 128:
        _MAP[_b] = ord(chr(_b).lower()) if _b < 128 else _b
TABLE = _MAP.tobytes()


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bins and counts of the text's byte trigrams; ASCII beyond letters is space, trigrams around two spaces are left out."""
    b = np.frombuffer(b" " + text.translate(TABLE) + b" ", np.uint8)
    if len(b) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    space = b == 32
    ok = ~((space[:-2] & space[1:-1]) | (space[1:-1] & space[2:]))
    x = b.astype(np.uint32)
    code = (((x[:-2] << 16) | (x[1:-1] << 8) | x[2:])[ok] * np.uint32(2654435761)) >> np.uint32(32 - 15)
    n = np.bincount(code, minlength=BINS)
    bins = np.flatnonzero(n)
    return bins, n[bins]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in total:
                total[lang] = np.zeros(BINS, np.int64)
            bins, n = grams(text)
            total[lang][bins] += n
    for lang, n in total.items():
        bins = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins)), pa.array(bins.astype(np.int32)), pa.array(n[bins])], names=["lang", "bin", "n"])


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (BINS x languages) from (lang, text).

    Counts cover every row, repeated ones each time, and are summed before and after
    the shuffle; at most BINS x languages sums reach the driver, whatever the input.
    Rows with a null language or text are left out; without any, no language is learned.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", F.col("text").cast("binary").alias("text"))
    counts = rows.mapInArrow(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).cache()
    langs = [r[0] for r in counts.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.full((BINS, len(langs)), 0.5)
    where = {x: k for k, x in enumerate(langs)}
    for r in counts.collect():
        table[r.bin, where[r.lang]] += r.n
    counts.unpersist()
    return langs, np.log(table / table.sum(0)) if langs else table


def mixture(p: np.ndarray, n: np.ndarray, chosen: list[int]) -> tuple[float, np.ndarray]:
    """Log-likelihood and proportions of the chosen languages, by EM."""
    q = p[:, chosen]
    w = np.full(len(chosen), 1 / len(chosen))
    total = n.sum()
    for _ in range(EM_ROUNDS if len(chosen) > 1 else 0):
        was, w = w, w * ((n / (q @ w)) @ q) / total
        if np.abs(w - was).max() < SETTLED:
            break
    return float(n @ np.log(q @ w)), w


def infer(logp: np.ndarray, bins: np.ndarray, n: np.ndarray) -> tuple[int, float, float]:
    """(language, its proportion, mean log-likelihood): languages join greedily while the penalised likelihood rises."""
    lp = logp[bins]
    single = n @ lp
    best = int(single.argmax())
    chosen, ll, w, total = [best], float(single[best]), np.ones(1), n.sum()
    p = np.exp(lp)
    cost = PENALTY * np.log(total + 1)
    while len(chosen) < logp.shape[1]:
        # By concavity, adding j can gain at most total * ln(mean ratio).
        gain = (n / (p[:, chosen] @ w)) @ p / total
        gain[chosen] = 0
        j = int(gain.argmax())
        if total * np.log(max(gain[j], 1.0)) <= cost:
            break
        more, v = mixture(p, n, [*chosen, j])
        if more - ll <= cost:
            break
        chosen, ll, w = [*chosen, j], more, v
    top = w.max()
    k = min(j for j, x in zip(chosen, w, strict=True) if x == top)
    return k, float(top), ll / total


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs' doc_id with lang_pred, score and n_grams.

    A null text, one without a letter, or any text when nothing was learned is
    `und` with score 0. Whole texts count, however long; ties go to the first
    language in code point order. score is the language's share of the mixture.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, logp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = shared.value
        for batch in batches:
            lang, score, size = [], [], []
            for text in batch.column(1).to_pylist():
                bins, n = grams(text) if text is not None and names else ((), ())
                if not len(bins):
                    lang.append("und"), score.append(0.0), size.append(0)
                    continue
                k, share, _ = infer(model, bins, n.astype(np.float64))
                lang.append(names[k]), score.append(min(1.0, share)), size.append(int(n.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(size, pa.int64())], names=["doc_id", "lang_pred", "score", "n_grams"])

    text = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col).cast("binary"))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text.alias("t")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_grams long")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
