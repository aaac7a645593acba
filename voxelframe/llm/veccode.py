"""Vector codes: 16 codebooks of 64 entries over integer parts, nearest entries by exact matrix products."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if, stored

#: A component x becomes floor(SCALE * x).
SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors that one task codes at a time, so that a block of distances stays below 20 MB.
BLOCK = 2_000
#: Sums of at most so many labels are broadcast (16 bytes each).
MOST_LABELS = 1_000_000
_EXACT = 53


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as float64 limbs, least first: x = sum of limb[i] << (bits * i). All but the last lie in 0 .. 2^bits - 1, the last (signed) within +-2^bits."""
    out = []
    while np.abs(x).max(initial=0) > 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exact while the result fits 64 bits: no product of limbs sums to more than 2^53, and the sums are put together as integers."""
    bits = (_EXACT - max(1, a.shape[1]).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(limbs(b, bits)):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry of each row and its squared distance."""
    if part.dtype == object or book.dtype == object:
        d = ((part.astype(object)[:, None, :] - book.astype(object)[None]) ** 2).sum(2)
        d = d if part.shape[1] else np.zeros((len(part), len(book)), object)
        at = np.array([min(range(len(book)), key=row.__getitem__) for row in d], np.int64)
        return at, d[np.arange(len(at)), at]
    d = (book * book).sum(1)[None, :] - 2 * dots(part, book)
    at = d.argmin(1)
    return at, d[np.arange(len(at)), at] + (part * part).sum(1)


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of each component, rows filled up with zeros to the width. int64 while every distance fits 64 bits, else Python's integers."""
    n = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    fits = width * (2 * float(np.abs(flat).max(initial=0)) + 2) ** 2 < 2.0**62
    out = np.zeros((len(n), width), np.int64 if fits else object)
    out[np.arange(width)[None, :] < n[:, None]] = flat.astype(np.int64) if fits else [int(x) for x in flat]
    return out


@dataclass(frozen=True)
class Codebooks:
    """entries: PARTS x entries x part width, Python integers beyond 64 bits. width: components that a vector is filled up to."""

    entries: np.ndarray
    width: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, vector, label of the rows whose vector is not null and whose components are finite."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), label.alias("label"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vector").isNotNull() & ~bad)


def _parts(books: Codebooks, vectors: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Block by block and part by part: where the block begins, the part, its integers."""
    d = books.width // PARTS
    for at in range(0, len(vectors), BLOCK):
        q = integers(vectors.slice(at, BLOCK), books.width)
        for p in range(PARTS):
            yield at, p, q[:, p * d : (p + 1) * d]


def _sums(shared):
    """Per part, entry and place the sum and the count of the parts that are assigned to it; one row each a task, however many vectors it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total = np.zeros(books.entries.shape, object)
        count = np.zeros(books.entries.shape[:2], np.int64)
        for b in batches:
            for _, p, part in _parts(books, b.column(0)):
                at, _ = nearest(part, books.entries[p])
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                count[p] += np.bincount(at, minlength=count.shape[1])
                if part.shape[1] and len(used):
                    total[p, used] += np.add.reduceat(part[order], first, axis=0)
        p, e = np.nonzero(count)
        if len(p):
            sums = [[str(x) for x in total[i, j]] for i, j in zip(p, e, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(sums, pa.list_(pa.string()))], names=["part", "entry", "n", "sums"])

    return run


def first_books(rows: DataFrame) -> Codebooks:
    """The parts of the ENTRIES smallest ids. Of rows of one id the least vector counts; null ids give no entry, unless no row has an id."""
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-width // PARTS) * PARTS
    ids = rows.where("vec_id is not null").groupBy("vec_id").agg(F.lit(1)).orderBy("vec_id").limit(ENTRIES).select("vec_id").collect()
    # Only the rows of these ids are grouped; the other vectors do not leave their task.
    some = rows.where(F.col("vec_id") <= ids[-1].vec_id).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect() if ids else []
    top = [r.vector for r in some] or [r.vector for r in rows.select("vector").distinct().orderBy("vector").limit(ENTRIES).collect()]
    q = integers(pa.array(top, pa.list_(pa.float64())), width)
    return Codebooks(q.reshape(len(q), PARTS, width // PARTS).transpose(1, 0, 2), width)


def learn(vectors: DataFrame, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of vectors(vec_id, embedding): `rounds` rounds of assignment and componentwise floor(sum / count).

    Every kept row counts, repeated ones each time. What reaches the driver is PARTS x
    ENTRIES sums a round, whatever the input. Rows whose vector is null or holds null
    or non-finite components are left out; shorter vectors count as filled up with
    zeros to the longest, rounded up to a multiple of PARTS. Fewer than ENTRIES ids
    give as many entries; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = whole(vectors)
    books = first_books(rows)
    for _ in range(rounds if books.entries.shape[1] else 0):
        shared = spark.sparkContext.broadcast(books)
        places = rows.select("vector").mapInArrow(_sums(shared), "part int, entry int, n long, sums array<string>")
        # Sums are decimals of 38 places: exact for any table whose sums 64 bits would not hold.
        each = places.select("part", "entry", "n", F.posexplode_outer("sums").alias("at", "s"))
        got = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        entries = books.entries.copy()
        for r in got:
            if r.at is not None:
                value = int(r.s) // r.n
                if entries.dtype != object and abs(value) >= 1 << 62:
                    entries = entries.astype(object)
                entries[r.part, r.entry, r.at] = value
        shared.unpersist()
        books = Codebooks(entries, books.width)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error of each kept row. An error beyond 64 bits is null."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    rows = whole(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            codes, error = np.zeros((b.num_rows, PARTS), np.uint8), np.zeros(b.num_rows, object)
            for start, p, part in _parts(books, b.column(2)):
                at, d = nearest(part, books.entries[p])
                codes[start : start + len(at), p] = at
                error[start : start + len(at)] += d
            text = codes.tobytes().hex()
            code = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
            err = pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code), err], names=["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """codes(code, ...) with `vector`: the entries' components over SCALE, whose distance to the floored vector is the error."""
    entries = books.entries.astype(np.float64) / SCALE

    @F.pandas_udf("array<double>")
    def vector(code):
        return code.map(lambda c: None if c is None else np.concatenate([entries[p, int(c[2 * p : 2 * p + 2], 16)] for p in range(PARTS)]).tolist())

    return codes.withColumn("vector", vector("code"))


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per kept row of vectors(vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256.

    label_error sums the errors of equal labels, null labels together (a sum beyond 64
    bits, or over a null error, is null); it is one sum a label, joined back as a
    broadcast up to MOST_LABELS labels and by shuffle beyond. Without a column `label`
    all rows have one label. Other columns are ignored; ties of distance go to the
    lower entry; an empty table gives no row.
    """
    books = learn(vectors, rounds)
    coded = stored(encode(vectors, books))
    error = F.col("error").cast("decimal(38,0)")
    total = F.when(F.count("error") == F.count(F.lit(1)), F.sum(error))
    sums = stored(coded.groupBy(F.col("label").alias("_label")).agg(F.when(total.between(0, (1 << 63) - 1), total.cast("long")).alias("label_error")))
    out = coded.join(broadcast_if(sums, sums.count(), MOST_LABELS), F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
