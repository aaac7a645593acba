"""Stored arrays and stacks of image rows, of which only what is wanted is opened and read.

`chunk_keys` is a table of an array's chunks before anything is read: filters and joins
of that table choose the files, and `chunks_of` reads those. `row_runs` does the same for
rows of image stacks. `register(spark)` makes two data sources known, with one input
partition a few chunks or rows: `voxel_array` (options path, level '0', span: chunks along
x that one task reads, and windows z, y, x as 'from,to') has z, y, x, value of voxels that
are not 0; `image_rows` (options path, width, header, rows_a_task, windows z, y) has z, y,
values. Of files without compression only the wanted planes or rows are read. Windows are
options, not pushed filters: Spark 4.1 keeps a Python source's pushed filters with the
table, so that a second use of one DataFrame would see the filters of the first.
`voxel_array` is a sink for chunk tables too (options path, level, shape, chunks, codec):
the array appears when every task has ended.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.chunks import KEY, PLACE
from ..operators.chunks import SCHEMA as CHUNK_SCHEMA
from ..operators.snap import split_runs
from . import files
from .zarr import Meta, decode, parse_meta

VOXEL_SCHEMA = "z long, y long, x long, value long"
_CHUNK_ARROW = pa.schema([*[(c, pa.int32()) for c in (*KEY, *PLACE[:3])], ("shape", pa.list_(pa.int32())), ("data", pa.binary())])


def _window(options, name: str, n: int) -> tuple[int, int]:
    """An option 'from,to' (either may be empty) as a range within 0 .. n."""
    lo, hi = (options.get(name) or ",").split(",")
    lo, hi = max(0, int(lo) if lo.strip() else 0), min(n, int(hi) if hi.strip() else n)
    return lo, max(lo, hi)


def array_meta(root: str) -> Meta:
    system, place = fs.FileSystem.from_uri(root)
    with system.open_input_file(f"{place}/.zarray") as f:
        return parse_meta(f.read().decode())


def block(system, place: str, m: Meta, key: tuple[int, ...], cut: list[tuple[int, int]] | None = None) -> tuple[list[int], list[int], np.ndarray] | None:
    """First place, shape and values of a stored chunk, cut at the array's end, or of a window within it; None where it is not stored. Of a raw block only the window's planes are read."""
    path = f"{place}/{m.separator.join(map(str, key))}"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    start = [k * c for k, c in zip(key, m.chunks, strict=True)]
    cut = cut or [(0, min(c, n - s)) for c, n, s in zip(m.chunks, m.shape, start, strict=True)]
    (z0, z1), (y0, y1), (x0, x1) = cut
    with system.open_input_file(path) as f:
        if m.codec is None and m.order == "C":
            plane = m.chunks[1] * m.chunks[2]
            f.seek(z0 * plane)
            a = np.frombuffer(f.read((z1 - z0) * plane), np.uint8).reshape(-1, *m.chunks[1:])
        else:
            a = np.frombuffer(decode(f.read(), m.codec), np.uint8, math.prod(m.chunks)).reshape(m.chunks, order=m.order)[z0:z1]
    return [s + c[0] for s, c in zip(start, cut, strict=True)], [b - a for a, b in cut], a[:, y0:y1, x0:x1]


def chunk_keys(spark: SparkSession, path: str, level: str = "0") -> DataFrame:
    """cz, cy, cx, z0, y0, x0, z1, y1, x1 (ends excluded) of every chunk of an array's grid, stored or not. Nothing is read but the description."""
    m = array_meta(f"{path}/{level}")
    tall, deep, wide = (-(-n // c) for n, c in zip(m.shape, m.chunks, strict=True))
    at = [F.floor(F.col("id") / (deep * wide)), F.floor(F.col("id") / wide) % deep, F.col("id") % wide]
    keys = spark.range(tall * deep * wide).select(*[c.cast("int").alias(k) for c, k in zip(at, KEY, strict=True)])
    ends = [F.least(F.col(k) * c + c, F.lit(n)).alias(f"{k[1]}1") for k, c, n in zip(KEY, m.chunks, m.shape, strict=True)]
    return keys.select(*KEY, *[(F.col(k) * c).alias(p) for k, c, p in zip(KEY, m.chunks, PLACE, strict=False)], *ends)


#: Chunks that one task reads, one after another.
CHUNKS_A_TASK = 8


def chunks_of(keys: DataFrame, path: str, level: str = "0") -> DataFrame:
    """A chunk table of the keys(cz, cy, cx), which are counted, made distinct and dealt evenly first. Chunks that are not stored, or not of the grid, have no row."""
    root = f"{path}/{level}"
    m = array_meta(root)
    inside = " and ".join(f"{k} between 0 and {-(-n // c) - 1}" for k, n, c in zip(KEY, m.shape, m.chunks, strict=True))
    some = keys.select(*[F.col(k).cast("int").alias(k) for k in KEY]).where(inside).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = fs.FileSystem.from_uri(root)
        for b in batches:
            for key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if got := block(system, place, m, key):
                    row = dict(zip([*KEY, *PLACE, "data"], [*key, *got[0], got[1], np.ascontiguousarray(got[2]).tobytes()], strict=True))
                    yield pa.RecordBatch.from_pylist([row], _CHUNK_ARROW)

    return some.repartition(max(1, -(-some.count() // CHUNKS_A_TASK)), *KEY).mapInArrow(run, CHUNK_SCHEMA)


@dataclass
class ChunkRow(InputPartition):
    """Chunks cx of lo .. hi - 1 in the row (cz, cy)."""

    cz: int
    cy: int
    lo: int
    hi: int


class ArrayReader(DataSourceReader):
    def __init__(self, options):
        self.root = f"{options['path']}/{options.get('level', '0')}"
        self.span = int(options.get("span", 1))
        self.meta = array_meta(self.root)
        self.windows = [_window(options, a, n) for a, n in zip("zyx", self.meta.shape, strict=True)]

    def partitions(self):
        z, y, x = (range(lo // c, -(-hi // c)) if lo < hi else range(0) for (lo, hi), c in zip(self.windows, self.meta.chunks, strict=True))
        return [ChunkRow(cz, cy, lo, min(lo + self.span, x.stop)) for cz, cy in product(z, y) for lo in range(x.start, x.stop, self.span)]

    def read(self, partition):
        if partition is None:
            return
        system, place = fs.FileSystem.from_uri(self.root)
        for cx in range(partition.lo, partition.hi):
            key = (partition.cz, partition.cy, cx)
            cut = [(max(lo - k * c, 0), min(hi - k * c, c)) for (lo, hi), k, c in zip(self.windows, key, self.meta.chunks, strict=True)]
            if got := block(system, place, self.meta, key, cut):
                at = np.nonzero(got[2])
                yield pa.RecordBatch.from_arrays([*[pa.array(i + s) for i, s in zip(at, got[0], strict=True)], pa.array(got[2][at].astype(np.int64))], names=["z", "y", "x", "value"])


@dataclass
class Written(WriterCommitMessage):
    n: int


class ArrayWriter(DataSourceArrowWriter):
    """Tasks put chunk files under their final names, each whole; `.zarray`, without which there is no array, comes last. A lost task's files are written again by its successor; an aborted job's folder goes."""

    def __init__(self, options, overwrite: bool):
        self.root = f"{options['path']}/{options.get('level', '0')}"
        self.shape, self.size = (tuple(map(int, options[k].split(","))) for k in ("shape", "chunks"))
        self.codec = None if (codec := options.get("codec", "zlib")) == "none" else codec
        if len(self.shape) != 3 or len(self.size) != 3 or self.codec not in (None, "zlib", "zstd"):
            raise ValueError("an array needs three sizes, three chunk sizes, and the codec none, zlib or zstd")
        system, place = fs.FileSystem.from_uri(self.root)
        if not overwrite and system.get_file_info(f"{place}/.zarray").type != fs.FileType.NotFound:
            raise FileExistsError(self.root)
        # Without a description there is no array, only what an aborted job's last tasks left.
        if system.get_file_info(place).type != fs.FileType.NotFound:
            system.delete_dir(place)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        n = 0
        for b in iterator:
            for row in b.select([*KEY, "shape", "data"]).to_pylist():
                key = [row[k] for k in KEY]
                shape = [min(c, s - k * c) for k, c, s in zip(key, self.size, self.shape, strict=True)]
                if row["data"] is None:
                    continue
                if row["shape"] != shape:
                    raise ValueError(f"chunk {key} is {row['shape']}, the array's is {shape}")
                block = np.zeros(self.size, np.uint8)
                block[: shape[0], : shape[1], : shape[2]] = np.frombuffer(row["data"], np.uint8).reshape(shape)
                if block.any():
                    raw = block.tobytes()
                    raw = raw if self.codec is None else zlib.compress(raw, 1) if self.codec == "zlib" else zstandard.ZstdCompressor(level=1).compress(raw)
                    files.put(f"{self.root}/{'.'.join(map(str, key))}", raw)
                    n += 1
        return Written(n)

    def commit(self, messages):
        about = {"zarr_format": 2, "shape": self.shape, "chunks": self.size, "dtype": "|u1", "order": "C", "fill_value": 0, "filters": None, "compressor": self.codec and {"id": self.codec, "level": 1}, "dimension_separator": "."}
        files.put(f"{self.root}/.zarray", json.dumps(about).encode())

    def abort(self, messages):
        system, place = fs.FileSystem.from_uri(self.root)
        if system.get_file_info(place).type != fs.FileType.NotFound:
            system.delete_dir(place)


class VoxelArray(DataSource):
    @classmethod
    def name(cls):
        return "voxel_array"

    def schema(self):
        return VOXEL_SCHEMA

    def reader(self, schema):
        return ArrayReader(self.options)

    def writer(self, schema, overwrite):
        return ArrayWriter(self.options, overwrite)


@dataclass
class Rows(InputPartition):
    """Rows lo .. hi - 1 of the slice z."""

    z: int
    path: str
    lo: int
    hi: int


def _rows(system, path: str, width: int, header: int, lo: int, hi: int) -> np.ndarray:
    """A ranged read of rows of little-endian 16-bit values."""
    with system.open_input_file(path) as f:
        f.seek(header + 2 * width * lo)
        return np.frombuffer(f.read(2 * width * (hi - lo)), "<u2").reshape(-1, width).astype(np.int32)


def _row_batch(z: int, lo: int, rows: np.ndarray) -> pa.RecordBatch:
    values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), z)), pa.array(np.arange(lo, lo + len(rows))), values], names=["z", "y", "values"])


class RowReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.width, self.header, self.most = options["path"], int(options["width"]), int(options.get("header", 368)), int(options.get("rows_a_task", 4_096))
        self.z, self.y = (_window(options, a, 1 << 62) for a in "zy")

    def partitions(self):
        system, place = fs.FileSystem.from_uri(self.path)
        out = []
        for info in system.get_file_info(fs.FileSelector(place)):
            m = re.search(r"(\d+)\.[^./]*$", info.path)
            if info.type == fs.FileType.File and m and self.z[0] <= int(m[1]) < self.z[1]:
                lo, hi = self.y[0], min(self.y[1], (info.size - self.header) // (2 * self.width))
                out += [Rows(int(m[1]), info.path, a, min(a + self.most, hi)) for a in range(lo, hi, self.most)]
        return out

    def read(self, partition):
        if partition is not None:
            system, _ = fs.FileSystem.from_uri(self.path)
            yield _row_batch(partition.z, partition.lo, _rows(system, partition.path, self.width, self.header, partition.lo, partition.hi))


class ImageRows(DataSource):
    @classmethod
    def name(cls):
        return "image_rows"

    def schema(self):
        return "z long, y long, values array<int>"

    def reader(self, schema):
        return RowReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats known."""
    for source in (VoxelArray, ImageRows):
        spark.dataSource.register(source)


def row_runs(wanted: DataFrame, path: str, width: int, header: int = 368, gap: int = 64, name: str = "{z:05}.tif") -> DataFrame:
    """z, y, values of the rows that wanted(z, y) lists, and those between wanted rows at most `gap` apart.

    Rows of a slice are grouped into runs, and each run is one ranged read by the task
    that holds it; slices and rows that nobody wants are not read. Slices that are not
    stored, and rows beyond a slice, have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = fs.FileSystem.from_uri(path)
        for b in batches:
            for z, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                info = system.get_file_info(f"{place}/{name.format(z=z)}")
                n = 0 if info.type == fs.FileType.NotFound else (info.size - header) // (2 * width)
                lo, hi = max(lo, 0), min(hi + 1, n)
                if lo < hi:
                    yield _row_batch(z, lo, _rows(system, info.path, width, header, lo, hi))

    runs = split_runs(wanted.where("z is not null and y is not null"), "z", "y", gap)
    return runs.select("z", "lo", "hi").mapInArrow(run, "z long, y long, values array<int>")

