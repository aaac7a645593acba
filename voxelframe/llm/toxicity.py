"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if, stored

#: Labelled rows that are fitted on, about: half of it a class, those of least hash, weighted back to their share.
LABELLED = 20_000
#: Of five parts by hash, four fit the trees (and one another's lexicons), the last calibrates.
PARTS = 5
#: A lexicon's terms: at most so many, in so many toxic rows at least, with log-odds so many deviations above 0 (and strong from STRONG on).
TERMS, LEAST_ROWS, LEAST_Z, STRONG = 20_000, 3, 2.5, 3.5
#: Starts of words count as terms with so many letters.
STARTS = range(3, 8)
#: A start is dropped where a longer term has this share of its toxic rows.
SAME = 0.9
#: A hit is near a second person within so many words; the densest stretch has so many words.
NEAR, STRETCH = 5, 50
#: Share of the uncalibrated score in the result, so that rows of one calibrated step keep their order.
ORDER = 0.01
#: Distinct terms that a task holds before it hands them on, words that a worker remembers, and a text's characters above which its words are not listed at once.
HELD, REMEMBERED, LONG = 300_000, 400_000, 4_000_000

#: Insults, words of the second person, and what stands for a letter.
INSULTS = frozenset("arsehole asshole bastard bitch clown cretin disgusting dumb fool freak idiot imbecile jerk loser moron pathetic retard scum stupid trash ugly vermin worthless arschloch blödmann depp dummkopf idioten schwein trottel wichser connard crétin débile imbécile ordure salaud salope cabrón estúpido gilipollas idiota imbécil mierda pendejo tonto".split())
SECOND = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LETTER = str.maketrans("013457@$!+", "oieastasit")

FEATURES = ["words", "hits", "strong", "insults", "weight", "top", "log_hits", "log_strong", "log_insults", "second", "near", "distance", "caps_words", "capitals", "exclaim", "question", "symbols", "digits", "disguised", "disguised_hits", "spelled", "long_run", "word_length", "densest", "beyond_ascii"]
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_RUN = re.compile(r"(.)\1{2,}")
HIT, STRONG_HIT, INSULT, SECOND_BIT, DISGUISED, DISGUISED_HIT, CAPS, SINGLE = (1 << i for i in range(8))


def plain(token: str) -> tuple[str, str]:
    """A token's lower-case core, and the same without disguise: signs that stand for letters, signs between letters and letters written three times or more. Equal where nothing is disguised."""
    low = _EDGE.sub("", token).lower()
    if low.isalpha() and not _RUN.search(low):
        return low, low
    if not any(c.isalpha() for c in low):
        return low, low
    return low, _RUN.sub(r"\1", _INNER.sub("", _EDGE.sub("", token.lower().strip(".,;:?\"'()[]<>*%#&|")).translate(LETTER)))


class Lexicon(dict):
    """Weights (0 to 1) of words and of starts of words. As a dict it remembers the code of each token: flags in the lowest byte, the weight above."""

    def __init__(self, words: dict[str, float], starts: dict[str, float], strong: frozenset):
        super().__init__()
        self.words, self.starts, self.strong = words, starts, strong

    def __reduce__(self):
        return Lexicon, (self.words, self.starts, self.strong)

    def weight(self, word: str) -> tuple[float, bool]:
        found = [(self.words[word], "w" + word)] if word in self.words else []
        found += [(self.starts[word[:k]], "s" + word[:k]) for k in STARTS if k < len(word) and word[:k] in self.starts]
        best = max(found, default=(0.0, ""))
        return best[0], any(t in self.strong for _, t in found)

    def code(self, token: str) -> int:
        low, bare = plain(token)
        w, strong = self.weight(low)
        flags = (DISGUISED if bare != low else 0) | (INSULT if low in INSULTS or bare in INSULTS else 0) | (SECOND_BIT if low in SECOND else 0)
        if bare != low:
            v, s = self.weight(bare)
            if v > w or bare in INSULTS:
                flags |= DISGUISED_HIT
            w, strong = max(w, v), strong or s
        flags |= (HIT if w else 0) | (STRONG_HIT if strong else 0)
        flags |= (CAPS if len(low) > 1 and token.isupper() else 0) | (SINGLE if len(low) == 1 and low.isalpha() else 0)
        return flags | round(w * 255) << 8

    def __missing__(self, token: str) -> int:
        c = self.code(token)
        if len(self) < REMEMBERED and len(token) < 64:
            self[token] = c
        return c

    def codes(self, text: str) -> np.ndarray:
        words = text.split() if len(text) < LONG else (m.group() for m in re.finditer(r"\S+", text))
        return np.fromiter(map(self.__getitem__, words), np.int32)


def spelled(text: str, single: np.ndarray, lexicon: Lexicon) -> int:
    """Hits among words that are spelled letter by letter: stretches of three single letters or more, read together."""
    edge = np.flatnonzero(np.diff(np.r_[0, single, 0]))
    spans = [(a, b) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= 3]
    if not spans:
        return 0
    words = text.split()
    return sum(bool(lexicon["".join(words[a:b])] & (HIT | INSULT)) for a, b in spans)


def vector(text: str | None, lexicon: Lexicon) -> list[float]:
    """The features of a whole text, in the order of FEATURES; zeros for a null text or one without words."""
    out = [0.0] * len(FEATURES)
    code = lexicon.codes(text) if text else np.zeros(0, np.int32)
    n = len(code)
    if not n:
        return out
    on = lambda bit: (code & bit) > 0
    bad = on(HIT | INSULT)
    hits, strong, insults, you = int(on(HIT).sum()), int(on(STRONG_HIT).sum()), int(on(INSULT).sum()), np.flatnonzero(on(SECOND_BIT))
    weight = code >> 8
    raw = text.encode("utf-8", "replace")
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    at, distance = np.flatnonzero(bad), None
    if len(at) and len(you):
        k = np.searchsorted(you, at)
        distance = np.minimum(np.abs(at - you[np.maximum(k - 1, 0)]), np.abs(you[np.minimum(k, len(you) - 1)] - at))
    total = np.r_[0, np.cumsum(bad)]
    single = on(SINGLE)
    runs = np.diff(np.flatnonzero(np.r_[True, np.diff(np.frombuffer(raw, np.uint8)) != 0, True]))
    letters = kinds[48:58].sum() + kinds[65:91].sum() + kinds[97:123].sum() + kinds[128:].sum() + kinds[32] + kinds[9:14].sum()
    values = [
        np.log1p(n), hits / n, strong / n, insults / n, weight.sum() / 255 / n, weight.max() / 255, np.log1p(hits), np.log1p(strong), np.log1p(insults), len(you) / n,
        0.0 if distance is None else (distance <= NEAR).mean(), 1.0 if distance is None else min(STRETCH, int(distance.min())) / STRETCH, on(CAPS).mean(), kinds[65:91].sum(), kinds[33], kinds[63], 1 - letters, kinds[48:58].sum(),
        on(DISGUISED).mean(), on(DISGUISED_HIT).sum() / n, spelled(text, single, lexicon) if single.sum() >= 3 else 0, np.log1p(runs.max()), len(raw) / n, (total[min(n, STRETCH) :] - total[: len(total) - min(n, STRETCH)]).max(), kinds[128:].sum(),
    ]
    return [float(v) for v in values]


def featured(lexicons: list[Lexicon]):
    """A column function (text, number of the lexicon) -> features. What stands beside the text does not go through Python."""

    @F.arrow_udf("array<double>")
    def features(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        mine = [Lexicon(x.words, x.starts, x.strong) for x in lexicons]
        for text, which in texts:
            yield pa.array([vector(t, mine[w]) for t, w in zip(text.to_pylist(), which.to_pylist(), strict=True)], pa.list_(pa.float64()))

    return features


def terms_of(text: str) -> set[str]:
    """Words ('w...') and starts of words ('s...'), of at most 32 letters, with and without disguise."""
    out = set()
    for token in set(text.split()):
        for word in set(plain(token)):
            if 2 <= len(word) <= 32:
                out.add("w" + word)
                out.update("s" + word[:k] for k in STARTS if k < len(word))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): in how many rows of each part and class a term stands, summed over what a task reads."""
    held: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["term", "n"])

    for b in batches:
        for text, part, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for t in terms_of(text or ""):
                held.setdefault(t, [0] * (2 * (PARTS - 1)))[2 * part + y] += 1
            if len(held) > HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def odds(pos: float, neg: float, positives: float, negatives: float) -> tuple[float, float]:
    """Smoothed log-odds of a term, and the same in deviations."""
    x = np.log((pos + 0.5) / (positives + 1)) - np.log((neg + 0.5) / (negatives + 1))
    return float(x), float(x / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)))


def lexicon(terms: list[tuple[str, int, int]], positives: int, negatives: int) -> Lexicon:
    """The terms that stand out in toxic rows; starts that one longer term accounts for give way to it."""
    kept = {}
    for term, pos, neg in terms:
        x, z = odds(pos, neg, positives, negatives)
        if pos >= LEAST_ROWS and z >= LEAST_Z:
            kept[term] = (min(1.0, x / 8), z, pos)
    for term, (_, _, pos) in list(kept.items()):
        for k in STARTS:
            start = "s" + term[1 : k + 1]
            if k < len(term) - 1 and start in kept and start != term and pos >= SAME * kept[start][2]:
                del kept[start]
    pick = lambda kind: {t[1:]: w for t, (w, _, _) in kept.items() if t[0] == kind}
    return Lexicon(pick("w"), pick("s"), frozenset(t for t, (_, z, _) in kept.items() if z >= STRONG))


@dataclass(frozen=True)
class Model:
    """share: the toxic share of the labelled rows, the score where they are of one class and there are no trees."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    steps: IsotonicRegressionModel | None
    share: float


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, y, part, weight of at most about `most` labelled rows, half of them a class. Of several texts of a doc_id the least counts, labels of a doc_id count by their mean, rounded."""
    known = stored(labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y")))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = {y: min(1.0, most / 2 / n.get(y, 1)) for y in (0, 1)}
    mine = F.when(F.col("y") == 1, rate[1]).otherwise(rate[0])
    place = lambda seed, size: F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(size))
    some = stored(known.where(place(3, 1 << 30) < mine * (1 << 30)).withColumns({"part": place(5, PARTS).cast("int"), "weight": 1 / mine}))
    # The sample is bounded, so it goes to the texts; the texts stay where they are.
    d = docs.select(F.col("doc_id").alias("_id"), "text").where("_id is not null").join(broadcast_if(some, some.count(), 2 * most + 1_000), F.col("_id") == F.col("doc_id"))
    return d.groupBy("doc_id", "y", "part", "weight").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED, trees: int = 20, depth: int = 4, rate: float = 0.3) -> Model:
    """A model of docs(doc_id, text) and labels(doc_id, toxic).

    Fitted on at most about `most` labelled rows: a lexicon of words and starts of
    words by their log-odds, trees over the features, and an isotonic regression of
    the trees' score on rows that neither the lexicon nor the trees saw. Rows that
    fit the trees are described by a lexicon learned without their own part. Labels
    without a document or with nulls are left out; where the calibrating part lacks a
    class, the fitted rows calibrate; with rows of one class only, every score is
    that class (none: 0.5). Texts may be null, empty, repeated or of any length.
    """
    rows = stored(sample(docs, labels, most))
    fit = rows.where(F.col("part") < PARTS - 1)
    sizes = {(r.part, r.y): r.n for r in rows.groupBy("part", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda y, parts=range(PARTS): sum(sizes.get((p, y), 0) for p in parts)
    if not of(0) or not of(1):
        return Model(Lexicon({}, {}, frozenset()), None, None, float(of(1) > 0) if sizes else 0.5)
    folds = range(PARTS - 1)
    counted = fit.select("text", "part", "y").mapInArrow(_count, "term string, n array<long>").groupBy("term").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(2 * (PARTS - 1))])
    pos, neg = (sum((F.col(f"n{2 * p + y}") for p in folds), F.lit(0)) for y in (1, 0))
    out = F.log((pos + 0.5) / (of(1, folds) + 1)) - F.log((neg + 0.5) / (of(0, folds) + 1))
    z = out / F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    terms = [tuple(r) for r in counted.where((pos >= LEAST_ROWS) & (z >= LEAST_Z - 1)).orderBy(z.desc(), "term").drop("z").limit(TERMS).collect()]

    def without(gone: int | None) -> Lexicon:
        parts = [p for p in folds if p != gone]
        return lexicon([(t[0], sum(t[2 + 2 * p] for p in parts), sum(t[1 + 2 * p] for p in parts)) for t in terms], of(1, parts), of(0, parts))

    lexicons = [*map(without, folds), without(None)]
    table = stored(rows.select("doc_id", F.col("y").cast("double").alias("label"), "part", "weight", featured(lexicons)("text", "part").alias("x")))
    table = table.orderBy("doc_id").coalesce(8).withColumn("features", array_to_vector("x"))
    trained = table.where(F.col("part") < PARTS - 1) if of(0, folds) and of(1, folds) else table
    model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, maxBins=128, minInstancesPerNode=3, seed=11).fit(trained).setPredictionCol("_p").setProbabilityCol("_probability").setRawPredictionCol("_raw")
    check = table.where(F.col("part") == PARTS - 1) if sizes.get((PARTS - 1, 0)) and sizes.get((PARTS - 1, 1)) else trained
    scored = model.transform(check).select("label", "weight", vector_to_array("_probability")[1].alias("p"))
    steps = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(scored)
    return Model(lexicons[-1], model, steps, of(1) / (of(0) + of(1)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` (1 from 0.5 on), each row by its whole text, in one pass without a shuffle. Columns of docs of these two names are replaced, all others stay."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(F.struct(*names).alias("_doc"), F.col("text").alias("_text"))
    if model.trees is None:
        out = rows.withColumn("_score", F.lit(model.share))
    else:
        x = rows.withColumn("_x", featured([model.lexicon])("_text", F.lit(0))).withColumn("features", array_to_vector("_x"))
        p = model.trees.transform(x).select("_doc", vector_to_array("_probability")[1].alias("p"))
        fit = F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0))
        out = model.steps.transform(p).withColumn("_score", (1 - ORDER) * fit + ORDER * F.col("p"))
    return out.select("_doc.*", F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and `hits`, an array of (at, word, weight): the words, counted from 0, that the lexicon or the list of insults knows, with their weight. Null texts have none."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("word", pa.string()), ("weight", pa.float64())]))

    @F.arrow_udf("array<struct<at:int,word:string,weight:double>>")
    def hits(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mine = Lexicon(model.lexicon.words, model.lexicon.starts, model.lexicon.strong)
        for text in texts:
            yield pa.array([[{"at": i, "word": w, "weight": (c >> 8) / 255} for i, w in enumerate((t or "").split()) if (c := mine[w]) & (HIT | INSULT)] for t in text.to_pylist()], kind)

    model = Model(model.lexicon, None, None, model.share)
    return docs.select("doc_id", hits("text").alias("hits"))
