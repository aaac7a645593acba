"""Substring dedup by recompression: equal passages get equal interior symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import GOLDEN, mix64

#: A window of so many words.
WINDOW = 13
#: Rounds of pair naming: symbols grow by a third a round, and a window hardly holds more than four rounds with what they depend on.
ROUNDS = 4
#: Words that are parsed at once, and bytes that are split into words at once.
WORDS, BYTES = 1 << 14, 1 << 17
#: A symbol that so many documents of one batch have, or that comes to its reducer in so many rows, is hot: its windows meet each by its own name.
HOT_BATCH, HOT_ROWS = 32, 5_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_FAR = np.int64(1 << 40)
_LOW = ~np.uint64(1)


class Powers:
    """Powers of a multiplier modulo 2^64, as many as were asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.table = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            self.table = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n - 1, self.base)], dtype=np.uint64)
        return self.table[:n]


_UP, _DOWN = Powers(_STEP), Powers(_BACK)


def spans_named(value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name of each span value[start:end], from one running sum; equal spans have equal names wherever they lie."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value * _UP(len(value)), out=total[1:])
    return mix64((total[end] - total[start]) * _DOWN(len(value) + 1)[start])


def named_words(text: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, starts and ends of the words of the bytes `text`; a word also ends at each place of `cut`."""
    edge = np.zeros(len(text) + 1, bool)
    edge[cut] = True
    names, starts, ends, at = [], [], [], 0
    while at < len(text):
        end = min(len(text), at + BYTES)
        if end < len(text):
            # Up to the last white space, or on to the next one where a word is longer than all this.
            space = np.flatnonzero(_SPACE[text[at:end]])
            while not len(space) and end < len(text):
                more = min(len(text), end + BYTES)
                space = np.flatnonzero(_SPACE[text[end:more]]) + (end - at)
                end = more
            if len(space) and end < len(text):
                end = at + int(space[-1]) + 1
        b = text[at:end]
        word = ~_SPACE[b]
        fresh = edge[at:end]
        s = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | fresh))
        e = np.flatnonzero(word & (np.r_[~word[1:], True] | np.r_[fresh[1:], True])) + 1
        names.append(spans_named(_LETTER[b], s, e)), starts.append(s + at), ends.append(e + at)
        at = end
    if not names:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(names), np.concatenate(starts), np.concatenate(ends)


def symbols(h: np.ndarray, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level (name, width, lo, hi) of the symbols over the named words h: the symbol has `width` words and is the same wherever the words lo..hi-1 are.

    Round by round, a hash bit makes each symbol an opener or a closer; an opener
    and the closer after it become a pair, named by its two parts, so equal content
    has one name in all documents and on all executors. Equal neighbours never
    pair; their run is named by the symbol and its length, beside its members, as a
    window may begin inside it. Whether a symbol stays alone depends on the one
    neighbour that it could pair with.
    """
    name, width = h, np.ones(len(h), np.int64)
    lo = np.arange(len(h))
    hi = lo + 1
    yield name, width, lo, hi
    for r in range(rounds + 1):
        same = np.flatnonzero(name[1:] == name[:-1])
        if len(same):
            # Maximal runs, from a to b; both neighbours beyond them must be seen.
            a = same[np.append(True, np.diff(same) > 1)]
            b = same[np.append(np.diff(same) > 1, True)] + 1
            total = np.r_[0, np.cumsum(width)]
            before, after = np.r_[-_FAR, lo], np.r_[hi, _FAR]
            yield mix64(name[a] ^ ((b - a + 1).astype(np.uint64) * GOLDEN)), total[b + 1] - total[a], before[a], after[b + 1]
            if r == 0:
                # Windows inside a run of one word.
                long_ = b - a + 1 >= WINDOW
                n = (b - a + 2 - WINDOW)[long_]
                at = np.repeat(a[long_], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield mix64(name[at] + GOLDEN), np.full(len(at), WINDOW), at, at + WINDOW
        if r == rounds or len(name) < 2:
            return
        closer = ((mix64(name ^ np.uint64(r + 1)) >> np.uint64(40)) & np.uint64(1)).astype(bool)
        p = np.flatnonzero(closer[1:] > closer[:-1])  # openers before a closer
        head = np.ones(len(name), bool)
        head[p + 1] = False
        head = np.flatnonzero(head)
        hi = np.where(closer, hi, np.append(hi[1:], _FAR))[head]
        lo = np.where(closer, np.append(-_FAR, lo[:-1]), lo)[head]
        name, width = name.copy(), width.copy()
        name[p] = mix64(name[p] * GOLDEN + mix64(name[p + 1]))
        width[p] += width[p + 1]
        name, width = name[head], width[head]
        grown = np.flatnonzero(width > 1)
        yield name[grown], width[grown], lo[grown], hi[grown]


def anchors(h: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The key of each window: the width and name of its widest symbol (then of greatest name) that depends on no word outside it.

    The key follows from the window's words alone, so equal windows have equal
    keys; neighbours mostly share theirs. The lowest bit is 0.
    """
    n = len(h)
    if n < WINDOW:
        return np.empty(0, np.uint64)
    out = np.empty(n - WINDOW + 1, np.uint64)
    for at in range(0, len(out), WORDS):
        part = h[at : at + WORDS + WINDOW - 1]
        best = np.zeros((WINDOW + 1, len(part)), np.uint64)
        for name, width, lo, hi in symbols(part, rounds):
            size = hi - lo
            ok = size <= WINDOW
            key = (width[ok].astype(np.uint64) << np.uint64(60)) | ((name[ok] >> np.uint64(4)) & _LOW)
            np.maximum.at(best.reshape(-1), size[ok] * len(part) + lo[ok], key)
        least = best[1]
        for j in range(2, WINDOW + 1):
            least = np.maximum(np.maximum(least[:-1], least[1:]), best[j, : len(least) - 1])
        out[at : at + WORDS] = least
    return out


class Batch:
    """The documents of one Arrow batch (doc, text, copy): their words and windows side by side."""

    def __init__(self, doc: pa.Array, text: pa.Array, copy: pa.Array):
        fine = pc.and_(pc.and_(doc.is_valid(), text.is_valid()), pc.invert(pc.fill_null(copy, False))).to_numpy(zero_copy_only=False)
        self.doc = doc.fill_null(0).to_numpy(zero_copy_only=False)
        offset = np.frombuffer(text.buffers()[1], np.int32 if pa.types.is_binary(text.type) else np.int64)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = text.buffers()[2]
        self.text = np.frombuffer(data, np.uint8)[offset[0] : offset[-1]] if data is not None and offset[-1] > offset[0] else np.empty(0, np.uint8)
        offset = offset - offset[0]
        self.h, self.start, self.end = named_words(self.text, offset)
        self.first = np.searchsorted(self.start, offset)  # of each document, the place of its first word
        if len(self.h) < WINDOW:
            self.at = self.row = np.empty(0, np.int64)
            self.key = np.empty(0, np.uint64)
            return
        of = np.repeat(np.arange(len(text)), np.diff(self.first))
        m = len(of) - WINDOW + 1
        keep = (of[:m] == of[WINDOW - 1 :]) & fine[of[:m]]
        self.at = np.flatnonzero(keep)
        self.row, self.key = of[self.at], anchors(self.h)[self.at]

    def names(self, at: np.ndarray) -> np.ndarray:
        """Names of the windows that begin at these words."""
        out = np.empty(len(at), np.uint64)
        for lo in range(0, len(self.h), WORDS):
            i, j = np.searchsorted(at, (lo, lo + WORDS))
            s = at[i:j] - lo
            out[i:j] = spans_named(self.h[lo : lo + WORDS + WINDOW], s, s + WINDOW)
        return out

    def words(self, at: int, n: int) -> bytes:
        """The n words from `at`, as they stand."""
        return self.text[self.start[at] : self.end[at + n - 1]].tobytes()


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, known): each document's keys. Those of a symbol that HOT_BATCH documents of the batch have are marked hot (lowest bit) and known to be shared; two rows of it stay open, to tell the other batches."""
    for batch in batches:
        b = Batch(*(batch.column(i) for i in (1, 2, 3)))
        if not len(b.at):
            continue
        run = _starts(b.row, b.key)
        doc, key = b.doc[b.row[run]], b.key[run].view(np.int64)
        order = np.lexsort((doc, key))
        doc, key = doc[order], key[order]
        new = _starts(key, doc)
        doc, key = doc[new], key[new]
        first = np.flatnonzero(_starts(key))
        n = np.diff(np.r_[first, len(key)])
        hot = np.repeat(n >= HOT_BATCH, n)
        known = hot & (np.arange(len(key)) - np.repeat(first, n) >= 2)
        yield pa.RecordBatch.from_arrays([pa.array(key | hot), pa.array(doc), pa.array(known)], names=["key", "doc", "known"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (known, symbol, hot first) → (doc, key) of known rows and of symbols that two documents have. A symbol of more than HOT_ROWS rows is hot as well."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    state = {"key": None, "hot": False, "lo": 0, "hi": 0, "rows": 0}

    def out(doc: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key)], names=["doc", "key"])

    def close() -> Iterator[pa.RecordBatch]:
        """The run held over, if two documents have it."""
        if held and state["lo"] < state["hi"]:
            doc = np.concatenate([d for d, _ in held])
            yield out(doc, np.full(len(doc), state["key"] | int(state["hot"])))
        held.clear()

    for batch in batches:
        key, doc, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if known.any():
            yield out(doc[known], key[known])
            key, doc = key[~known], doc[~known]
        if not len(key):
            continue
        hot, key = (key & 1).astype(bool), key & ~np.int64(1)
        first = np.flatnonzero(_starts(key))
        end = np.r_[first[1:], len(key)]
        lo, hi = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        any_hot = np.logical_or.reduceat(hot, first) | (end - first > HOT_ROWS)
        begin = 0
        if state["key"] is not None and key[0] == state["key"]:
            state.update(lo=min(state["lo"], lo[0]), hi=max(state["hi"], hi[0]), rows=state["rows"] + int(end[0]))
            state["hot"] = bool(state["hot"] or any_hot[0] or state["rows"] > HOT_ROWS)
            held.append((doc[: end[0]], key[: end[0]]))
            begin = 1
            if state["hot"] and state["lo"] < state["hi"]:
                # Its mark is known: nothing needs to wait.
                yield from close()
        if begin < len(first):
            yield from close()
            inner = np.zeros(len(first), bool)
            inner[begin:-1] = (lo < hi)[begin:-1]
            rows = np.repeat(inner, end - first)
            if rows.any():
                yield out(doc[rows], (key | np.repeat(any_hot, end - first))[rows])
            held.append((doc[first[-1] :], key[first[-1] :]))
            state.update(key=int(key[-1]), hot=bool(any_hot[-1]), lo=lo[-1], hi=hi[-1], rows=len(doc) - int(first[-1]))
    yield from close()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, at, n, words): n windows from word `at` on that share a key, with their words.

    What a smaller document of the batch has, word for word, is known to go: a row
    without words, dealt by document. Windows of hot symbols are rows of their own.
    """
    for batch in batches:
        b = Batch(*(batch.column(i) for i in range(3)))
        order_of, lists = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(4)
        off = lists.offsets.to_numpy().astype(np.int64)
        want = lists.values.to_numpy()[off[0] : off[-1]].view(np.uint64)
        of = np.repeat(np.arange(len(lists)), np.diff(off)).astype(np.uint64) * GOLDEN
        run = np.flatnonzero(_starts(b.row, b.key))
        have = mix64(b.key[run] + b.row[run].astype(np.uint64) * GOLDEN)
        plain, hot = (np.isin(have, mix64((want[x] & _LOW) + of[x])) for x in ((want & np.uint64(1)) == 0, (want & np.uint64(1)) == 1))
        length = np.diff(np.r_[run, len(b.at)])
        sel = np.repeat(plain | hot, length)
        if not sel.any():
            continue
        at, row, key, hot = b.at[sel], b.row[sel], b.key[sel], np.repeat(hot, length)[sel]
        doc, name = b.doc[row], b.names(at)
        order = np.lexsort((at, doc, name))
        new = _starts(name[order])
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        source = np.empty(len(at), np.int64)
        source[order] = first
        known = doc > doc[source]
        # Runs of known windows whose sources run along are compared as they stand.
        k = np.flatnonzero(known)
        spans = []
        if len(k):
            s, t = at[k], at[source[k]]
            cut = np.flatnonzero(_starts(row[k], row[source[k]], s - np.arange(len(k)), t - np.arange(len(k))))
            for i, n in zip(cut.tolist(), np.diff(np.r_[cut, len(k)]).tolist(), strict=True):
                x, y = b.words(s[i], n + WINDOW - 1), b.words(t[i], n + WINDOW - 1)
                if x == y or x.split() == y.split():
                    spans.append((k[i], n))
                else:
                    known[k[i : i + n]] = False
        o = np.flatnonzero(~known)
        cut = np.flatnonzero(_starts(row[o], key[o], at[o] - np.arange(len(o))) | hot[o]) if len(o) else o
        n_open = np.diff(np.r_[cut, len(o)])
        i_known, n_known = (np.array(x, np.int64) for x in (zip(*spans, strict=True) if spans else ((), ())))
        i = np.r_[o[cut], i_known]
        place = (order_of[row[i]] << 32) | (at[i] - b.first[row[i]])
        route = np.where(hot[i], name[i], key[i])
        route[len(cut) :] = mix64(doc[i_known].view(np.uint64) + place[len(cut) :].view(np.uint64) * GOLDEN)
        words = [b" ".join(b.words(p, n + WINDOW - 1).split()) for p, n in zip(at[o[cut]].tolist(), n_open.tolist(), strict=True)] + [None] * len(spans)
        yield pa.RecordBatch.from_arrays(
            [pa.array(route.view(np.int64)), pa.array(doc[i]), pa.array(place), pa.array(np.r_[n_open, n_known].astype(np.int32)), pa.array(words, pa.binary())], names=["key", "doc", "at", "n", "words"]
        )


def _group(rows: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """Of one key's rows (doc, at, n, words) in order of doc: spans (doc, at, n) of the windows that a smaller document has, compared word for word."""
    first: dict[bytes, int] = {}
    whole: dict[bytes, int] = {}
    for doc, at, n, words in rows:
        if whole.setdefault(words, doc) < doc:
            yield doc, at, n
            continue
        space = [-1, *np.flatnonzero(np.frombuffer(words, np.uint8) == 32).tolist(), len(words)]
        begin = -1
        for i in range(n):
            gone = first.setdefault(words[space[i] + 1 : space[i + WINDOW]], doc) < doc
            if gone and begin < 0:
                begin = i
            elif not gone and begin >= 0:
                yield doc, at + begin, i - begin
                begin = -1
        if begin >= 0:
            yield doc, at + begin, n - begin


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, doc) → (doc, at, n) of windows that go. A key's rows are read together; there are few of them, as hot symbols' windows have keys of their own."""
    held: list[tuple[int, int, int, bytes]] = []
    last = None

    def out(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["doc", "at", "n"])

    for batch in batches:
        known = batch.filter(pc.is_null(batch.column(4)))
        if known.num_rows:
            yield known.select(["doc", "at", "n"])
        batch = batch.filter(pc.is_valid(batch.column(4)))
        if not batch.num_rows:
            continue
        key, doc, at, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        words, gone = batch.column(4), []
        first = np.flatnonzero(_starts(key))
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
            if key[i] != last:
                gone.extend(_group(held))
                held, last = [], key[i]
            if j < len(key) and not held and doc[i] == doc[j - 1]:
                continue  # one document's alone
            held.extend(zip(doc[i:j].tolist(), at[i:j].tolist(), n[i:j].tolist(), words[i:j].to_pylist(), strict=True))
        if gone:
            yield out(gone)
    if gone := list(_group(held)):
        yield out(gone)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, sha, kept = [], [], [], []
        for doc, text, copy, order, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = (text or b"").split()
            if copy and len(words) >= WINDOW:
                rest = []
            elif spans and doc is not None:
                mine = [(s["at"] & 0xFFFFFFFF, s["n"]) for s in spans if s["at"] >> 32 == order]
                out = np.zeros(len(words) + 1, np.int64)
                for at, m in mine:
                    out[at] += 1
                    out[at + m + WINDOW - 1] -= 1
                rest = list(compress(words, (np.cumsum(out[:-1]) == 0).tolist()))
            else:
                rest = words
            joined = b" ".join(rest)
            n.append(len(words)), gone.append(len(words) - len(rest)), sha.append(hashlib.sha256(joined).hexdigest()), kept.append(joined)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
        )


def _without_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _kept(batches):
        yield batch.select(["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256 and, with texts, kept_text.

    A word goes if a window of 13 words covers it whose words also start in a
    document of smaller doc_id. One shuffle of the texts by doc_id is reused by
    all steps. A document whose text a smaller doc_id has exactly is a copy: it
    takes no part and loses all its windows. Of the others, rounds of recompression
    name runs and pairs of words alike in all documents, and each window's widest
    symbol is its key. A first exchange by symbol finds those that two documents
    have; a second one brings the stretches of windows around shared symbols
    together, where they are compared word for word. Symbols with very many
    documents are marked hot: rows already known to be shared inside their batch are
    dealt by document, and their windows meet under their own names, one row a batch
    and distinct window; so a passage, or a group of near copies, of a third of all
    documents fills no task. A name that two contents share by chance costs a
    comparison, no result. Null texts have no words; rows with a null doc_id neither
    remove nor lose words; texts of one doc_id do not remove each other's words;
    repeated rows are judged alike; texts below 13 words stay whole. Columns beside
    doc_id and text are ignored.
    """
    doc = F.col("doc_id").cast("long")
    sha = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    # k is never null, so no filter on it keeps Spark from reusing the one exchange.
    base = docs.select(F.coalesce(doc, F.xxhash64("text")).alias("k"), doc.alias("doc"), F.col("text").cast("binary").alias("t"), sha.alias("sha")).repartition("k")
    each = docs.where("doc_id is not null and text is not null").select(doc.alias("doc"), sha.alias("sha"))
    copies = each.join(each.groupBy("sha").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1"), "sha").where("doc > rep").select("doc", "sha", F.lit(True).alias("copy"))
    # The further texts of one doc_id are told apart by their order.
    several = each.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("doc").orderBy("sha")) - 1).where("nth > 0").select("doc", "sha", "nth")
    odd = copies.select("doc", "sha", "copy", F.lit(0).alias("nth")).unionAll(several.select("doc", "sha", F.lit(False).alias("copy"), "nth"))
    odd = odd.groupBy(F.col("doc").alias("k")).agg(F.collect_set(F.struct("sha", "copy", "nth")).alias("odd"))
    mine = F.filter("odd", lambda x: x["sha"] == F.col("sha"))
    own = base.join(odd, "k", "left").select(
        "k", "doc", "t", F.coalesce(F.exists(mine, lambda x: x["copy"]), F.lit(False)).alias("copy"), F.coalesce(F.array_max(F.transform(mine, lambda x: x["nth"])), F.lit(0)).alias("nth")
    )
    keys = own.mapInArrow(_keys, "key long, doc long, known boolean")
    symbol = F.col("key").bitwiseAND(F.lit(-2))
    dealt = keys.repartition(F.when(F.col("known"), F.xxhash64("doc", "key")).otherwise(symbol)).sortWithinPartitions("known", symbol, F.col("key").desc())
    shared = dealt.mapInArrow(_shared, "doc long, key long").groupBy(F.col("doc").alias("k")).agg(F.collect_set("key").alias("keys"))
    cand = own.join(shared, "k").select("doc", "t", "copy", "nth", "keys")
    parts = cand.mapInArrow(_stretches, "key long, doc long, at long, n int, words binary").repartition("key").sortWithinPartitions("key", "doc")
    gone = parts.mapInArrow(_repeats, "doc long, at long, n int").groupBy(F.col("doc").alias("k")).agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    full = own.join(gone, "k", "left").select(F.col("doc").alias("doc_id"), "t", "copy", "nth", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return full.mapInArrow(_kept, schema + ", kept_text binary") if texts else full.mapInArrow(_without_text, schema)
