"""Brown class-based bigrams: distributed exchange clustering, smoothed scoring of every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, mix64, stored

#: Classes of a small vocabulary; a larger one gets the cube root of its words, so that the class table stays below the vocabulary.
CLASSES = 48
#: Exchanges end by SETTLED, the least rise of the classes' mutual information; this bound is for callers.
EXCHANGES, SETTLED = 100, 0.01
#: Of the words that gain, one in so many moves at once; the next share is tried where the last lowered the likelihood, then the best word alone.
SHARES = (2, 8, 32)
#: Words that each Python worker holds; the others meet their counts and classes in shuffles.
HEAD = 100_000
#: The end of a text counts as a token; an empty string is no word.
END = b""
#: Word pairs are summed in the worker over so many tokens, and what stands beside words outside the head over so many of these.
TOKENS, REST = 4_000_000, 1_000_000
#: Bytes of texts whose words are taken at once: words and their numbers take many times that, and Spark's batches hold 10,000 texts.
PIECE = 2 << 20
#: Counts up to this size have their gains tabulated.
LEVELS = 16


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts (binary, null: empty) in one array, and where each text's words start in it."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, pa.scalar(b"", texts.type)).view(pa.string())))
    at, words = lists.offsets.to_numpy(), lists.flatten().view(pa.binary())
    full = pc.binary_length(words).to_numpy() > 0  # space at an end of a text gives an empty string
    if not full.all():
        at, words = np.append(0, np.cumsum(full))[at], words.filter(pa.array(full))
    return at, words


def pieces(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of PIECE bytes of text, or of one longer text."""
    for batch in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64), 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            yield batch.slice(at, end - at)
            at = end


def encoded(texts: pa.Array, head: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Every token's place in the head (which has END), or len(head), the places where texts start, and the words, without ends."""
    at, words = tokens(texts)
    x = pc.fill_null(pc.index_in(words, value_set=head), len(head)).to_numpy()
    return np.insert(x, at[1:], pc.index(head, pa.scalar(END, head.type)).as_py()), at + np.arange(len(at)), words


def outside(x: np.ndarray, at: np.ndarray, words: pa.Array, other: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of the tokens outside the head the places, the texts and the words."""
    t = np.flatnonzero(x == other)
    text = np.searchsorted(at, t, "right") - 1
    return t, text, words.take(pa.array(t - text))


def tallied(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often each comes. Empties the list and sorts in place, so that the codes are held once."""
    code = np.concatenate(parts)
    parts.clear()
    code.sort()
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[first], np.diff(np.append(first, len(code)))


def packed(at: np.ndarray, values: np.ndarray, kind: type = np.int32) -> pa.Array:
    """Integers as bytes, a row's from one place of `at` to the next: Spark moves them as they are, not one by one."""
    v = np.ascontiguousarray(values, kind)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((np.asarray(at) * v.itemsize).astype(np.int32)), pa.py_buffer(v)])


def unpacked(col: pa.Array, kind: type = np.int32) -> tuple[np.ndarray, np.ndarray]:
    """What `packed` was given."""
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int32)
    values = np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind) if at[-1] > at[0] else np.zeros(0, kind)
    return (at - at[0]) // np.dtype(kind).itemsize, values


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how often each comes, summed over many texts."""
    kept: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(kept)
        kept.clear()
        yield from found.group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches(100_000)

    for batch in pieces(batches):
        found = tokens(batch.column(0))[1].value_counts()
        kept.append(pa.RecordBatch.from_arrays([pa.concat_arrays([found.field(0), pa.array([END], pa.binary())]), pa.concat_arrays([found.field(1), pa.array([len(batch)], pa.int64())])], names=["word", "n"]))
        if sum(map(len, kept)) > REST:
            yield from flush()
    if kept:
        yield from flush()


def fingerprint(word: bytes) -> int:
    """Spark's xxhash64 of the same bytes."""
    return xxhash.xxh64_intdigest(word, seed=42)


def _pairs(shared):
    """(w, side, c, n): of each word of the head, or of -1 for all others, the head's words beside it and how often; side 0 before, 1 after. Summed over many texts before they leave the worker; a word of no place in the head counts as the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        other = len(head)
        kept: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            code, n = tallied(kept)
            n = n.astype(np.int32)
            for side in (1, 0):
                if not side:  # the words of a pair change places
                    code = (code & (2**32 - 1)) << 32 | code >> 32
                    order = np.argsort(code)
                    code, n = code[order], n[order]
                    del order
                w = (code >> 32).astype(np.int32)
                first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                own = w[first] < other
                lists = [packed(np.append(first, len(w)), x) for x in ((code & (2**32 - 1)).astype(np.int32), n)]
                out = pa.RecordBatch.from_arrays([pa.array(w[first]), pa.array(np.full(len(first), side, np.int8)), *lists], names=["w", "side", "c", "n"])
                yield out if own.all() else out.filter(pa.array(own))

        size = 0
        for batch in pieces(batches):
            x, _, _ = encoded(batch.column(0), head)
            code = x.astype(np.int64)
            code[1:] |= code[:-1] << 32
            code[0] |= int(x[-1]) << 32
            kept.append(code)  # a text's last token is END, and so is what stands before the next one's first
            size += len(x)
            if size > TOKENS:
                yield from flush()
                size = 0
        if kept:
            yield from flush()

    return run


def _merged(other: int):
    """Rows sorted by w → one row a word: (w, cb, nb, ca, na, beyond), the words before and after it, summed, and how often a word outside the head is after it; the last word is carried over."""

    def out(w, side, c, n):
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        which = np.cumsum(np.append(False, w[1:] != w[:-1]))
        lists = []
        for s in (0, 1):
            on = side == s
            at = np.append(0, np.cumsum(np.bincount(which[on], minlength=len(first))))
            lists += [packed(at, c[on]), packed(at, n[on], np.int64)]
        on &= c == other
        beyond = np.bincount(which[on], n[on], len(first)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(w[first].astype(np.int32)), *lists, pa.array(beyond)], names=["w", "cb", "nb", "ca", "na", "beyond"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            at, c = unpacked(batch.column(2))
            row = np.repeat(np.arange(len(batch)), np.diff(at))
            x = (batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row], c, unpacked(batch.column(3))[1])
            if held is not None:
                x = tuple(np.concatenate(p) for p in zip(held, x, strict=True))
            order = np.lexsort((x[2], x[1], x[0]))
            w, side, c, n = (v[order] for v in x)
            first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (side[1:] != side[:-1]) | (c[1:] != c[:-1])))
            x = (w[first], side[first], c[first], np.add.reduceat(n.astype(np.int64), first))
            tail = x[0] == x[0][-1]
            held = tuple(v[tail] for v in x)
            if not tail.all():
                yield out(*(v[~tail] for v in x))
        if held is not None:
            yield out(*held)

    return run


def _sides(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows (w, cb, nb, ca, na): side, and of each of its entries the row, the neighbour and the count."""
    for side, c, n in ((0, "cb", "nb"), (1, "ca", "na")):
        at, beside = unpacked(batch.column(c))
        yield side, np.repeat(np.arange(len(batch)), np.diff(at)), beside, unpacked(batch.column(n), np.int64)[1]


def _matrix(out: np.ndarray) -> pa.RecordBatch:
    l, r = np.nonzero(out)
    return pa.RecordBatch.from_arrays([pa.array(l.astype(np.int32)), pa.array(r.astype(np.int32)), pa.array(out[l, r])], names=["l", "r", "n"])


def _joint(shared, k: int):
    """Counts of neighbouring classes under an assignment of the head, over all pairs but those of two words outside it. With `once`, a word seen once also counts as one of class k: what new words come after and before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, once = shared.value
        other, k1 = len(cls) - 1, k + 1
        out = np.zeros((k1, k1))

        def add(l, r, n):
            out.reshape(-1)[:] += np.bincount(l.astype(np.int64) * k1 + r, n, k1 * k1)

        for batch in batches:
            w, beyond = batch.column("w").to_numpy(), batch.column("beyond").to_numpy()
            at, c = unpacked(batch.column("cb"))
            add(cls[c], np.repeat(cls[w], np.diff(at)), unpacked(batch.column("nb"), np.int64)[1])  # all pairs that end in the head
            add(cls[w], np.full(len(w), cls[other]), beyond)  # pairs that begin in the head and end outside
            for side, row, c, n in _sides(batch) if once is not None else ():
                new = once[w[row]]
                none, beside = np.full(int(new.sum()), k), cls[c]
                add(*((beside[new], none) if side == 0 else (none, beside[new])), n[new])
                if side == 0:
                    both = new & once[c]
                    out[k, k] += n[both].sum()
        yield _matrix(out)

    return run


def _beside(cls: np.ndarray, k: int, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Rows of one word each (w, cb, nb, ca, na) → words, their classes, and entries (row, side, class, count) in order of row; side 2 is the word beside itself."""
    w = batch.column(0).to_numpy()
    parts = []
    for side, row, c, n in _sides(batch):
        own = c == w[row]
        if side:
            parts.append((row[own], np.full(own.sum(), 2), np.full(own.sum(), -1), n[own]))
        sums = np.bincount(row[~own] * (k + 1) + cls[c[~own]], n[~own], len(w) * (k + 1))
        code = np.flatnonzero(sums)
        parts.append((code // (k + 1), np.full(len(code), side), code % (k + 1), sums[code]))
    row, side, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row, kind="stable")
    return w, cls[w], row[order], side[order], c[order], n[order].astype(float)


def xlog(v: np.ndarray) -> np.ndarray:
    return v * np.log(np.maximum(v, 1e-300))


def _rise(n: np.ndarray, v: np.ndarray) -> np.ndarray:
    """xlog(n + v) - xlog(n), without loss where n is large."""
    n = np.maximum(n, 0)
    return v * np.log(np.maximum(n + v, 1e-300)) + n * np.log1p(v / np.maximum(n, 1e-300))


def gains(n: np.ndarray, table: np.ndarray, a: np.ndarray, row: np.ndarray, side: np.ndarray, c: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each word (of class a) and class: the likelihood with the word there, against that without it. table[s, v - 1]: rises of n (s = 0) and of its transpose by v."""
    k1, m, every = len(n), len(a), np.arange(len(a))
    own = np.bincount(row[side == 2], v[side == 2], m)
    beside = [np.bincount(row[side == s] * k1 + c[side == s], v[side == s], m * k1).reshape(m, k1) for s in (0, 1)]
    total = np.zeros((m, k1))
    for s, grid in ((0, n), (1, n.T)):
        mine, other = beside[s], beside[1 - s]
        on = side == s
        i, f, x = row[on], c[on], v[on]
        if not len(i):
            continue
        level, at = np.clip(x.astype(int), 1, LEVELS) - 1, a[i]
        home = f == at  # the word's own class has lost its counts
        plain = ~home & (x <= LEVELS)
        # Tabulated rises are summed in one product: how often a word has (level, class) beside it.
        code = level[plain] * k1 + f[plain]
        used, which = np.unique(code, return_inverse=True)
        often = np.bincount(i[plain] * max(1, len(used)) + which, minlength=m * max(1, len(used))).reshape(m, -1)
        if len(used):
            total += often @ table[s].reshape(-1, k1)[used]
        j, y = i[~plain], f[~plain]
        rest = _rise(grid[y] - home[~plain, None] * other[j], x[~plain, None])
        if len(rest):
            first = np.flatnonzero(np.append(True, j[1:] != j[:-1]))
            total[j[first]] += np.add.reduceat(rest, first, axis=0)
        was = np.where(plain, table[s, level, f, at], 0.0)
        was[~plain] = rest[np.arange(len(rest)), at[~plain]]
        now = _rise(grid[f, at] - mine[i, f] - home * (other[i, at] + own[i]), x)
        total[every, a] += np.bincount(i, now - was, m)
    # Where both of its sides or the word itself meet in one class.
    to, fro = beside
    r, f = np.nonzero(((to > 0) & (fro > 0)) | (own > 0)[:, None])
    t, u, o, at = to[r, f], fro[r, f], own[r], f == a[r]
    d = np.maximum(n[f, f] - at * (t + u + o), 0)
    total[r, f] += xlog(d + t + u + o) - xlog(d + t) - xlog(d + u) + xlog(d)
    for sums, size in ((n.sum(1), fro.sum(1) + own), (n.sum(0), to.sum(1) + own)):
        level, which = np.unique(size, return_inverse=True)
        edge = _rise(sums[None, :], level[:, None])[which]
        edge[every, a] = _rise(sums[a] - size, size)
        total -= edge
    return total


def rises(n: np.ndarray) -> np.ndarray:
    return np.stack([[_rise(g, float(v)) for v in range(1, LEVELS + 1)] for g in (n, n.T)])


def best_classes(n: np.ndarray, table: np.ndarray, a: np.ndarray, row: np.ndarray, side: np.ndarray, c: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word (of class a; entries in order of row) the class that raises the likelihood most, and the gain of moving there. The last class takes none."""
    # Blocks of words, so that entries x classes stay within a few MB.
    ends = np.searchsorted(row, np.arange(len(a) + 1))
    best, gain, start = a.copy(), np.zeros(len(a)), 0
    while start < len(a):
        end = max(start + 1, min(start + 1_000, int(np.searchsorted(ends, ends[start] + 10_000, "right")) - 1))
        x = slice(ends[start], ends[end])
        g = gains(n, table, a[start:end], row[x] - start, side[x], c[x], v[x])
        g[:, -1] = -np.inf if len(n) > 1 else 0
        at, here = g.argmax(1), np.arange(end - start)
        best[start:end] = at
        gain[start:end] = g[here, at] - g[here, a[start:end]]
        start = end
    return best, gain


def _moves(shared):
    """For each clustered word of the head the class to move to, and the gain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, n = shared.value
        k, table = len(n) - 1, rises(n)
        for batch in batches:
            w = batch.column(0).to_numpy()
            batch = batch.filter(pa.array(cls[w] < k))
            for at in range(0, len(batch), 1_000):
                w, a, *entries = _beside(cls, k, batch.slice(at, 1_000))
                best, gain = best_classes(n, table, a, *entries)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(best.astype(np.int32)), pa.array(gain)], names=["w", "best", "gain"])

    return run


def _tail(shared, k: int):
    """(word, code, n, prev): of each word outside the head the classes beside it (side x (k + 1) + class) and how often, and the fingerprints of words before it that are outside the head too; summed over many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, cls = shared.value
        other = len(head)
        kept: list[tuple] = []

        def flush() -> pa.RecordBatch:
            named = pa.concat_arrays([x[0] for x in kept]).dictionary_encode()
            before, after, follows = (np.concatenate(x) for x in list(zip(*kept, strict=True))[1:])
            kept.clear()
            row, words = named.indices.to_numpy().astype(np.int64), named.dictionary
            code, n = tallied([(row << 32) | before, (row << 32) | (k + 1 + after)])
            at = np.append(0, np.cumsum(np.bincount(code >> 32, minlength=len(words))))
            second = np.flatnonzero(follows)  # the word before is the one before in this list too
            second = second[np.argsort(row[second], kind="stable")]
            used, which = np.unique(row[second - 1], return_inverse=True)
            prev = np.array([fingerprint(x) for x in words.take(pa.array(used)).to_pylist()], np.uint64).view(np.int64)[which]
            to = np.append(0, np.cumsum(np.bincount(row[second], minlength=len(words)))).astype(np.int32)
            return pa.RecordBatch.from_arrays([words, packed(at, code & (2**32 - 1)), packed(at, n), pa.ListArray.from_arrays(pa.array(to), pa.array(prev))], names=["word", "code", "n", "prev"])

        size = 0
        for batch in pieces(batches):
            x, at, words = encoded(batch.column(0), head)
            t, _, mine = outside(x, at, words, other)
            if not len(t):
                continue
            kept.append((mine, cls[x[t - 1]].astype(np.int64), cls[x[t + 1]].astype(np.int64), x[t - 1] == other))
            size += len(t)
            if size > REST:
                yield flush()
                size = 0
        if kept:
            yield flush()

    return run


def _assigned(shared):
    """Rows sorted by word of words outside the head, all in the last class so far → one row a word with its best class: (word, count, c, code, n, prev); the last word is carried over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shared.value
        k, table = len(n) - 1, rises(n)
        once = np.full((k + 1) ** 2, -1, np.int32)  # best classes of words seen once, by the classes before and after

        def best(row: np.ndarray, code: np.ndarray, v: np.ndarray, words: int) -> np.ndarray:
            return best_classes(n, table, np.full(words, k), row, code // (k + 1), code % (k + 1), v)[0]

        def classed(batch: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
            m = len(first)
            at, code = unpacked(batch.column(1))
            word = np.repeat(np.arange(m), np.diff(np.append(first, len(batch))))
            key, which = np.unique(np.repeat(word, np.diff(at)) * (2 * k + 2) + code, return_inverse=True)
            v = np.bincount(which, unpacked(batch.column(2))[1], len(key))
            row, code = key // (2 * k + 2), key % (2 * k + 2)
            count = np.bincount(row[code <= k], v[code <= k], m).astype(np.int64)
            at = np.searchsorted(row, np.arange(m + 1))
            c, single = np.zeros(m, np.int32), count == 1
            pair = code[at[:-1][single]] * (k + 1) + code[at[:-1][single] + 1] - (k + 1)
            if len(new := np.unique(pair[once[pair] < 0])):
                once[new] = best(np.repeat(np.arange(len(new)), 2), np.stack([new // (k + 1), new % (k + 1) + k + 1], 1).ravel(), np.ones(2 * len(new)), len(new))
            c[single] = once[pair]
            rest = ~single[row]
            c[~single] = best((np.cumsum(~single) - 1)[row[rest]], code[rest], v[rest], m - len(pair))
            prev = batch.column(3)
            to = prev.offsets.to_numpy()
            prev = pa.ListArray.from_arrays(pa.array((to[np.append(first, len(batch))] - to[0]).astype(np.int32)), prev.values.slice(to[0], to[-1] - to[0]))
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), pa.array(count), pa.array(c), packed(at, code), packed(at, v, np.int64), prev], names=["word", "count", "c", "code", "n", "prev"])

        held = None
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            word = batch.column(0)
            first = np.flatnonzero(np.append(True, pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)))
            held = batch.slice(first[-1])
            if len(first) > 1:
                yield classed(batch.slice(0, first[-1]), first[:-1])
        if held is not None:
            yield classed(held, np.zeros(1, int))

    return run


def _tail_joint(k: int):
    """What pairs of a word outside the head (of class c) and one of the head give; a word seen once also counts as one of class k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k + 1, k + 1))
        for batch in batches:
            count, c = (batch.column(i).to_numpy() for i in (0, 1))
            at, code = unpacked(batch.column(2))
            n = unpacked(batch.column(3), np.int64)[1]
            row = np.repeat(np.arange(len(batch)), np.diff(at))
            side, f = code // (k + 1), code % (k + 1)
            for s in (0, 1):
                for mine, on in ((c[row], (side == s) & (f < k)), (np.full(len(row), k), (side == s) & (f < k) & (count[row] == 1))):
                    l, r = (f, mine) if s == 0 else (mine, f)
                    out += np.bincount(l[on].astype(np.int64) * (k + 1) + r[on], n[on], (k + 1) ** 2).reshape(k + 1, k + 1)
        yield _matrix(out)

    return run


class Model:
    """What scoring needs: totals, the head's words, classes and transitions, and the table of all words' counts and classes. `unseen`: places of new words. `rising`: the likelihood after each exchange."""

    def __init__(self, counts: DataFrame, tokens: int, distinct: int, clustered: int, unseen: int, head: list, n: np.ndarray, in_class: np.ndarray, rising: tuple = ()):
        self.counts, self.tokens, self.distinct, self.clustered, self.unseen, self.head, self.n, self.in_class, self.rising = counts, tokens, distinct, clustered, unseen, head, n, in_class, rising


def learn(texts: DataFrame, clustered: int | None = None, classes: int | None = None, head: int = HEAD, exchanges: int = EXCHANGES) -> Model:
    """Fit on texts(text). Word and pair counts cover every token and are summed on the workers before the shuffle.

    All words are clustered, or the `clustered` most frequent ones; the number of
    classes grows with them. The head, at most `head` words, is what a worker holds
    in memory. Its words are exchanged in turns: all get their best class in
    parallel, given the classes beside them, and a share of those that gain moves;
    where that does not raise the likelihood, a smaller share is tried, at last the
    best word alone, which always raises it. Turns end when they raise the classes'
    mutual information by less than a SETTLED-th. Then every other word of the
    vocabulary, however many there are, gets its best class given the classes beside
    it, and its counts join the class counts. Neighbours are tables of one row a
    word; only class counts (classes squared) and one class a head word reach the
    driver. Repeated texts count each time; null texts count as empty ones; words of
    equal counts fall to code point order; without tokens there is no class.
    """
    spark = texts.sparkSession
    share_out = spark.sparkContext.broadcast
    t = texts.select(F.col("text").cast("binary").alias("t"))
    counts = stored(t.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    if not total.v:
        return Model(counts.withColumn("c", F.lit(0)), 0, 0, 0, 1, [], np.zeros((1, 1)), np.ones(1))
    # The head by count, cut at a level of count, so that no more than `head` rows leave the executors.
    level = F.floor(F.log2("n") * 16).cast("int")
    floor_, held = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        held += r["count"]
        if held > head:
            break
        floor_ = r.level
    # A word seen once has no say in the exchanges; it is classed after them.
    in_head = (F.col("word") == F.lit(bytearray(END))) | (F.lit(False) if floor_ is None else (level >= floor_) & (F.col("n") > 1))
    top = sorted(((bytes(r.word), r.n) for r in counts.where(in_head).collect()), key=lambda x: (-x[1], x[0]))
    words, count = [w for w, _ in top], np.array([c for _, c in top], np.int64)
    every = clustered is None or clustered >= total.v
    m = total.v if every else len({*words[:clustered], END})
    k = max(1, min(classes or max(CLASSES, int(np.ceil(m ** (1 / 3)))), m))
    # The last place is all other words, the last class what is in no other.
    cls = np.array([fingerprint(w) % k if every or i < clustered or w == END else k for i, w in enumerate(words)] + [k], np.int32)
    known = pa.array(words, pa.binary())
    pairs = t.mapInArrow(_pairs(share_out(known)), "w int, side byte, c binary, n binary").repartition("w").sortWithinPartitions("w")
    pairs = stored(pairs.mapInArrow(_merged(len(words)), "w int, cb binary, nb binary, ca binary, na binary, beyond long"))
    spark.sparkContext._jvm.System.gc()  # lets go of the shuffled files

    def summed(parts: DataFrame) -> np.ndarray:
        out = np.zeros((k + 1, k + 1))
        for r in parts.groupBy("l", "r").agg(F.sum("n").alias("n")).collect():
            out[r.l, r.r] = r.n
        return out

    def joint(cls: np.ndarray, once: np.ndarray | None = None) -> np.ndarray:
        read = pairs.select("w", "cb", "nb", "beyond") if once is None else pairs
        out = summed(read.mapInArrow(_joint(share_out((cls, once)), k), "l int, r int, n double"))
        if once is None:
            out[k, k] += total.n - out.sum()  # pairs of two words outside the head
        return out

    n = joint(cls)
    rising = [likelihood(n)]
    for turn in range(exchanges):
        found = pairs.mapInArrow(_moves(share_out((cls, n))), "w int, best int, gain double").where("gain > 1e-6").toArrow()
        w, best, gain = (found.column(i).to_numpy() for i in range(3))
        deal = mix64(w.astype(np.uint64) ^ np.uint64(turn << 32))
        for share in (*(SHARES if len(w) >= 20 else (1,)), 0) if len(w) else ():
            go = deal % np.uint64(share) == 0 if share else np.arange(len(w)) == gain.argmax()
            new = cls.copy()
            new[w[go]] = best[go]
            after = joint(new)
            if likelihood(after) > rising[-1]:
                cls, n = new, after
                rising.append(likelihood(n))
                break
        else:
            break
        if rising[-1] - rising[-2] < SETTLED * (rising[-1] + float(xlog(np.array(n.sum())))):
            break
    in_tail = total.v - len(words)
    if every and in_tail:
        beside = t.mapInArrow(_tail(share_out((known, cls)), k), "word binary, code binary, n binary, prev array<long>").repartition("word").sortWithinPartitions("word")
        rest = stored(beside.mapInArrow(_assigned(share_out(n)), "word binary, count long, c int, code binary, n binary, prev array<long>"))
        n[k], n[:, k] = 0, 0
        n += summed(rest.select("count", "c", "code", "n").mapInArrow(_tail_joint(k), "l int, r int, n double"))
        last = rest.select(F.xxhash64("word").alias("p"), F.col("c").alias("l"), (F.col("count") == 1).alias("lo"))
        both = rest.select(F.explode("prev").alias("p"), F.col("c").alias("r"), (F.col("count") == 1).alias("ro")).groupBy("p", "r", "ro").count()
        for r in both.join(last, "p").groupBy("l", "lo", "r", "ro").agg(F.sum("count").alias("n")).collect():
            n[r.l, r.r] += r.n
            n[k, r.r] += r.n * r.lo
            n[r.l, k] += r.n * r.ro
            n[k, k] += r.n * (r.lo and r.ro)
        tail = rest.select("word", F.col("count").alias("n"), "c")
    elif every:
        n = joint(cls, np.append(count == 1, False))
        tail = None
    else:
        tail = counts.where(~in_head).select("word", "n", F.lit(k).alias("c"))
    dropped(pairs)
    known = spark.createDataFrame(pa.table({"word": known, "n": pa.array(count), "c": pa.array(cls[:-1])}))
    counts = stored(known if tail is None else known.unionByName(tail))
    in_class = np.zeros(k + 1)
    for r in counts.groupBy("c").agg(F.sum("n").alias("n")).collect():
        in_class[r.c] = r.n
    return Model(counts, total.n, total.v, m, max(1, total.once) if every else 1, [(w, int(x), int(c)) for w, x, c in zip(words, count, cls, strict=False)], n, in_class, tuple(rising))


def likelihood(n: np.ndarray) -> float:
    return float(xlog(n).sum() - xlog(n.sum(0)).sum() - xlog(n.sum(1)).sum())


def _score(shared):
    """Of each text what the head's words give, and the other words with their place and the classes of the head's words beside them (-1: not of the head)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, count, cls, step, in_class, rare, below = shared.value
        h, tail = len(head), len(in_class) - 1
        # The last place is all words outside the head, the last class (-1) theirs: they give nothing here.
        own = np.append(np.where(cls < tail, np.log10(np.maximum(count, 1e-300) / np.maximum(in_class[cls], 1)), np.log10((count + 1) / rare)), 0.0)
        base, is_known, of = np.append(np.log10((count + 1) / below), 0.0), np.append(count > 0, False).astype(np.int64), np.append(cls, -1).astype(np.int32)
        log_step = np.pad(np.log10(np.maximum(step, 1e-300)), (0, 1))
        for batch in pieces(batches, 2):
            x, at, words = encoded(batch.column(2), head)
            c = of[x]
            before = np.r_[c[-1], c[:-1]]  # a text's last token is END
            given = own[x]
            given += log_step[before, c]
            sums = [*(np.add.reduceat(v[x], at[:-1]) for v in (is_known, base)), np.add.reduceat(given, at[:-1])]
            t, text, mine = outside(x, at, words, h)
            to = pa.array(np.searchsorted(t, at).astype(np.int32))
            lists = [pa.ListArray.from_arrays(to, v) for v in (mine, *(pa.array(v.astype(np.int32)) for v in (t - at[text], before[t], c[t + 1])))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), *map(pa.array, sums), *lists], names=["row", "doc_id", "n_tokens", "known", "base", "own", "words", "at", "before", "after"])

    return run


def _rest(shared):
    """Words outside the head in order of text and place, (row, at, before, after, c, n) → what they give to each text; the last text is carried over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, in_class, rare, below = shared.value
        tail = len(in_class) - 1
        log_step = np.log10(np.maximum(step, 1e-300))

        def out(row, *sums) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(row), *map(pa.array, sums)], names=["row", "tb", "ts", "tk"])

        held, last = None, tail
        for batch in batches:
            if not len(batch):
                continue
            row, _, before, after, c, n = (batch.column(i).to_numpy() for i in range(6))
            emit = np.where(c < tail, np.log10(np.maximum(n, 1e-300) / np.maximum(in_class[c], 1)), np.log10((n + 1) / rare))
            into = log_step[np.where(before >= 0, before, np.r_[last, c[:-1]]), c]
            onward = np.where(after >= 0, log_step[c, np.maximum(after, 0)], 0)
            last = c[-1]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            part = [row[first], *(np.add.reduceat(v, first) for v in (np.log10((n + 1) / below), emit + into + onward, (n > 0).astype(np.int64)))]
            if held is not None:
                if held[0][0] == row[0]:
                    for v, w in zip(part[1:], held[1:], strict=True):
                        v[0] += w[0]
                else:
                    part = [np.r_[w, v] for w, v in zip(held, part, strict=True)]
            held = [v[-1:] for v in part]
            if len(part[0]) > 1:
                yield out(*(v[:-1] for v in part))
        if held is not None:
            yield out(*held)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text).

    P(w | v) = P(class w | class v) P(w | class w). Transitions are smoothed by the
    classes' own shares. New words are a class of their own, which comes as often
    as words seen once did, with a place for each of those; words left unclustered
    share it by add-one. It sums to one. Base is the add-one unigram. Words
    outside the head meet their counts and classes in a join by word; the texts
    themselves are not shuffled. A null or blank text is its end token alone. Without training
    tokens every probability is 1.
    """
    spark = docs.sparkSession
    head, count, cls = (list(x) for x in zip(*(model.head or [(END, 0, 0)]), strict=True))
    head, count, cls = pa.array(head, pa.binary()), np.array(count, float), np.array(cls, np.int64)
    share = (model.in_class + (1 if model.head else 0)) / (model.in_class + (1 if model.head else 0)).sum()
    rare = float(model.in_class[-1] + model.distinct - model.clustered + model.unseen) if model.head else 1.0
    step = (model.n + share[None, :]) / (model.n.sum(1, keepdims=True) + 1)
    below = float(model.tokens + model.distinct + 1)
    weights = (step, model.in_class, rare, below)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("t"))
    part = stored(rows.mapInArrow(_score(spark.sparkContext.broadcast((head, count, cls, *weights))), f"row long, doc_id {kind}, n_tokens long, known long, base double, own double, words array<binary>, at array<int>, before array<int>, after array<int>"))
    tail = part.select("row", F.explode(F.arrays_zip("words", "at", "before", "after")).alias("x")).select("row", F.col("x.words").alias("word"), "x.at", "x.before", "x.after")
    new = len(model.in_class) - 1
    tail = tail.join(model.counts, "word", "left").select("row", "at", "before", "after", F.coalesce("c", F.lit(new)).alias("c"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    tail = tail.repartition("row").sortWithinPartitions("row", "at").mapInArrow(_rest(spark.sparkContext.broadcast(weights)), "row long, tb double, ts double, tk long")
    zero = F.lit(0.0)
    return part.select("row", "doc_id", "n_tokens", "known", "base", "own").join(tail, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("tk", F.lit(0))).alias("n_known"),
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tb", zero)).alias("base_score"),
        (F.col("own") + F.coalesce("ts", zero)).alias("score"),
    )
