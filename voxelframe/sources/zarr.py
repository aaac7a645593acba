"""Chunked arrays (version 2 layout) as chunk tables: one row a stored chunk file.

Files are listed and read by Spark's binary source, so any file system that Spark
reads will do, and one task decodes one file at a time.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import KEY, PLACE, SCHEMA, rechunk, unpack
from . import files


class GridMismatch(ValueError):
    """Two volumes do not lie on one grid."""


@dataclass(frozen=True)
class Meta:
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    order: str
    codec: str | None
    separator: str


def parse_meta(text: str) -> Meta:
    """The array's description. Only 3-D unsigned bytes without filters, with fill value 0 or none, and no, zlib, gzip, zstd or blosc (of lz4, zlib or zstd) compression are read."""
    m = json.loads(text)
    codec = (m.get("compressor") or {}).get("id")
    if m.get("zarr_format") != 2 or len(m["shape"]) != 3 or np.dtype(m["dtype"]) != np.uint8 or m.get("filters") or m.get("fill_value") not in (0, None) or codec not in (None, "zlib", "gzip", "zstd", "blosc"):
        raise ValueError(f"array not supported: {text}")
    return Meta(tuple(m["shape"]), tuple(m["chunks"]), m.get("order", "C"), codec, m.get("dimension_separator", "."))


def meta(spark: SparkSession, path: str, level: str = "0") -> Meta:
    """Reads `<path>/<level>/.zarray`. Spark's sources skip names that begin with a dot, so Hadoop's file system reads it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/{level}/.zarray")
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return parse_meta(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


#: Fixed values of a blosc frame: flags, and the inner codecs by number.
_BITSHUFFLE, _STORED = 0x04, 0x02
_INNER = {1: "lz4_raw", 3: "zlib", 4: "zstd"}


def blosc(content: bytes) -> bytes:
    """A version 1 blosc frame of single bytes, on which the byte shuffle does nothing. Other inner codecs, or wider items, raise ValueError."""
    flags, width, size, block = struct.unpack_from("<2xBBII", content)
    if flags & _STORED:
        return content[16 : 16 + size]
    inner = _INNER.get(flags >> 5)
    if inner is None or width != 1:
        raise ValueError(f"blosc frame not supported: codec {flags >> 5}, {width} bytes an item")
    out = []
    for i, at in enumerate(struct.unpack_from(f"<{-(-size // block)}I", content, 16)):
        n = min(block, size - i * block)
        (held,) = struct.unpack_from("<I", content, at)
        part = content[at + 4 : at + 4 + held]
        if held < n:
            part = zlib.decompress(part) if inner == "zlib" else pa.Codec(inner).decompress(part, n).to_pybytes()
        if flags & _BITSHUFFLE and n % 8 == 0:
            bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(8, -1), axis=1, bitorder="little")
            part = np.packbits(bits, axis=0, bitorder="little").tobytes()
        out.append(part)
    return b"".join(out)


def decode(content: bytes, codec: str | None) -> bytes:
    if codec == "blosc":
        return blosc(content)
    if codec in ("zlib", "gzip"):
        return zlib.decompress(content, 47)
    return zstandard.ZstdDecompressor().decompressobj().decompress(content) if codec == "zstd" else content


def read(spark: SparkSession, path: str, level: str = "0", z0: int = 0, z1: int | None = None, y: tuple[int, int | None] = (0, None), x: tuple[int, int | None] = (0, None)) -> DataFrame:
    """Chunk table of one level; with a window of z, y or x only files of chunks that meet it are listed and read. Chunks not stored have no row and count as zeros; an empty window has none."""
    m = meta(spark, path, level)
    spans = [(max(lo, 0), n if hi is None else min(hi, n)) for (lo, hi), n in zip(((z0, z1), y, x), m.shape, strict=True)]
    if any(hi <= lo for lo, hi in spans):
        return spark.createDataFrame([], SCHEMA)
    root, names = f"{path}/{level}", [range(lo // c, -(-hi // c)) for (lo, hi), c in zip(spans, m.chunks, strict=True)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if spans != [(0, n) for n in m.shape]:
        some = ["*" if s == (0, n) else "{" + ",".join(map(str, r)) + "}" for s, n, r in zip(spans, m.shape, names, strict=True)]
        files = files.load(f"{root}/{'/'.join(some)}") if m.separator == "/" else files.option("pathGlobFilter", ".".join(some)).load(root)
    else:
        files = files.load(root)
    at = [F.regexp_extract("path", r"(\d+)[/.](\d+)[/.](\d+)$", i + 1).cast("int").alias(k) for i, k in enumerate(KEY)]
    rows = files.select(*at, "content")
    for k, r in zip(KEY, names, strict=True):
        rows = rows.where(F.col(k).between(r.start, r.stop - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *key, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                start = [k * c for k, c in zip(key, m.chunks, strict=True)]
                shp = [min(c, n - s) for c, n, s in zip(m.chunks, m.shape, start, strict=True)]
                block = np.frombuffer(decode(content, m.codec), np.uint8, prod(m.chunks)).reshape(m.chunks, order=m.order)
                data = np.ascontiguousarray(block[: shp[0], : shp[1], : shp[2]]).tobytes()
                yield pa.RecordBatch.from_pylist([dict(zip([*KEY, *PLACE, "data"], [*key, *start, shp, data], strict=True))], pa.schema([*[(c, pa.int32()) for c in (*KEY, *PLACE[:3])], ("shape", pa.list_(pa.int32())), ("data", pa.binary())]))

    return rows.mapInArrow(run, SCHEMA)


def read_box(spark: SparkSession, path: str, box: tuple[tuple[int, int], tuple[int, int], tuple[int, int]], level: str = "0") -> DataFrame:
    """z, y, x, value of the voxels of a box ((z0, z1), (y0, y1), (x0, x1)), ends excluded, that are not 0. Only chunks that meet the box are read."""
    v = unpack(read(spark, path, level, *box[0], y=box[1], x=box[2]))
    return v.where(" and ".join(f"{c} >= {lo} and {c} < {hi}" for c, (lo, hi) in zip("zyx", box, strict=True)))


def write(chunks: DataFrame, path: str, shape: tuple[int, int, int], size: tuple[int, int, int], level: str = "0", codec: str | None = "zlib") -> int:
    """Store a chunk table of one grid as `<path>/<level>`, one file a chunk; returns the number of files. Edge blocks are filled up with zeros; null data and chunks of zeros are not stored. codec: None, zlib or zstd."""
    if codec not in (None, "zlib", "zstd"):
        raise ValueError(f"codec not supported: {codec}")
    root = f"{path}/{level}"
    about = {"zarr_format": 2, "shape": shape, "chunks": size, "dtype": "|u1", "order": "C", "fill_value": 0, "filters": None, "compressor": codec and {"id": codec, "level": 1}, "dimension_separator": "."}
    files.put(f"{root}/.zarray", json.dumps(about).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cz, cy, cx, shp, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block = np.zeros(size, np.uint8)
                block[: shp[0], : shp[1], : shp[2]] = np.frombuffer(data, np.uint8).reshape(shp)
                raw = block.tobytes() if block.any() else None
                if raw and codec:
                    raw = zlib.compress(raw, 1) if codec == "zlib" else zstandard.ZstdCompressor(level=1).compress(raw)
                yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{cz}.{cy}.{cx}"]), pa.array([raw], pa.binary())], names=["path", "content"])

    return files.write(chunks.where("data is not null").select(*KEY, "shape", "data").mapInArrow(run, "path string, content binary"))


def open_pair(spark: SparkSession, preds: str, ct: str, preds_level: str = "0", ct_level: str = "2", z0: int = 0, z1: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunk tables of a prediction and a scan on the prediction's grid; GridMismatch where their shapes differ.

    A scan of other chunks is rechunked; the window then widens to whole chunks of the prediction.
    """
    a, b = meta(spark, preds, preds_level), meta(spark, ct, ct_level)
    if a.shape != b.shape:
        raise GridMismatch(f"{a.shape} and {b.shape}")
    p = read(spark, preds, preds_level, z0, z1)
    if a.chunks == b.chunks:
        return p, read(spark, ct, ct_level, z0, z1)
    n, end = a.chunks[0], a.shape[0] if z1 is None else z1
    return p, rechunk(read(spark, ct, ct_level, max(z0, 0) // n * n, -(-end // n) * n), a.chunks, a.shape)
