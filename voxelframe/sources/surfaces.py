"""Surface point files and stacks of image rows, through Spark's binary source."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import nearest
from . import files as out

_AXES = ["x", "y", "z", "nx", "ny", "nz"]
_END = b"<>\n"


def points(spark: SparkSession, path: str, v0: int = 0, u0: int = 0, size: int | None = None, step: int = 1) -> DataFrame:
    """file, v, u, x, y, z, nx, ny, nz of every step-th grid point of the square from (v0, u0).

    A file is text lines `width: w` and `height: h`, a line `<>`, then h x w records of
    six little-endian doubles. Missing points are all zero and kept. A file without
    both numbers, or cut short, raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = content.index(_END)
                head = dict(re.findall(r"(\w+): *(\d+)", content[:at].decode()))
                w, h = int(head["width"]), int(head["height"])
                grid = np.frombuffer(content, "<f8", h * w * 6, at + len(_END)).reshape(h, w, 6)
                u = np.arange(u0, w if size is None else min(w, u0 + size), step)
                for v in range(v0, h if size is None else min(h, v0 + size), step):
                    cols = [pa.array([name] * len(u), pa.string()), pa.array(np.full(len(u), v, np.int32)), pa.array(u.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*cols, *(pa.array(grid[v, u, i]) for i in range(6))], names=["file", "v", "u", *_AXES])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, v int, u int, " + ", ".join(f"{c} double" for c in _AXES))


def image_rows(spark: SparkSession, path: str, width: int, header: int = 368, y0: int = 0, y1: int | None = None) -> DataFrame:
    """z, y, values of the rows [y0, y1) of a stack: one file a slice, its number in the name, `header` bytes, then rows of little-endian 16-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = (len(content) - header) // (2 * width)
                for y in range(max(y0, 0), n if y1 is None else min(n, y1)):
                    row = np.frombuffer(content, "<u2", width, header + 2 * width * y).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([z], pa.int64()), pa.array([y], pa.int64()), pa.array([row], pa.list_(pa.int32()))], names=["z", "y", "values"])

    z = F.regexp_extract("path", r"(\d+)\.[^./]*$", 1)
    files = spark.read.format("binaryFile").load(path).select(z.cast("long").alias("z"), "content").where("z is not null")
    return files.mapInArrow(run, "z long, y long, values array<int>")


#: Fixed values of image files: the types' letters, and tags of width, height, bits, compression, strips, samples, rows a strip, predictor, tiles and sample format.
_TIFF_TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _STRIPS, _SAMPLES, _ROWS, _STRIP_BYTES, _PREDICTOR, _TILE, _TILE_ROWS, _TILES, _TILE_BYTES, _FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339
#: Fixed values of compressions: none, LZW and two numbers of deflate; and of LZW's codes.
_PLAIN, _LZW, _DEFLATE = 1, 5, (8, 32946)
_CLEAR, _END_OF_DATA = 256, 257


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, that grow one code early; a clear code starts anew."""
    out, held, bits, size, last = bytearray(), 0, 0, 9, b""
    table: list[bytes] = []
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < size:
            continue
        bits -= size
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == _END_OF_DATA:
            break
        if code == _CLEAR:
            table, size, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code > len(table) or (code == len(table) and not last):
            raise ValueError("broken LZW data")
        word = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + word[:1])
        out += word
        last = word
        size = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def unpredicted(raw: bytes, h: int, w: int, end: str, width: int, predictor: int) -> np.ndarray:
    """Rows of floats of a strip or tile. Predictor 2 holds differences of neighbours' words; 3 differences of bytes, the most significant bytes of a row first."""
    if predictor == 3:
        planes = np.cumsum(np.frombuffer(raw, np.uint8, h * w * width).reshape(h, width * w), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(planes.reshape(h, width, w).transpose(0, 2, 1)).view(f">f{width}").reshape(h, w)
    words = np.frombuffer(raw, f"{end}u{width}", h * w).reshape(h, w)
    if predictor == 2:
        words = np.cumsum(words, axis=1, dtype=f"u{width}").astype(f"{end}u{width}")
    return words.view(f"{end}f{width}")


def float_image(content: bytes) -> np.ndarray:
    """The first image of a file with one 32- or 64-bit float a pixel, in strips or tiles, plain, LZW or deflate, with predictor 1, 2 or 3; others raise ValueError."""
    end = {b"II": "<", b"MM": ">"}.get(content[:2])
    if end is None or struct.unpack_from(end + "H", content, 2)[0] != 42:
        raise ValueError("not an image file of the classic layout")
    (at,) = struct.unpack_from(end + "I", content, 4)
    (n,) = struct.unpack_from(end + "H", content, at)
    tags = {}
    for i in range(n):
        place = at + 2 + 12 * i
        tag, kind, count = struct.unpack_from(end + "HHI", content, place)
        if letter := _TIFF_TYPES.get(kind):
            size = count * struct.calcsize(end + letter)
            tags[tag] = struct.unpack_from(f"{end}{count}{letter}", content, place + 8 if size <= 4 else struct.unpack_from(end + "I", content, place + 8)[0])
    one = {k: tags.get(k, (1,))[0] for k in (_BITS, _COMPRESSION, _SAMPLES, _FORMAT, _PREDICTOR)}
    if one[_COMPRESSION] not in (_PLAIN, _LZW, *_DEFLATE) or one[_SAMPLES] != 1 or one[_FORMAT] != 3 or one[_BITS] not in (32, 64) or one[_PREDICTOR] not in (1, 2, 3):
        raise ValueError(f"image layout not supported: {one}")
    tiled = _TILE in tags
    if missing := {_HEIGHT, _WIDTH, *((_TILE_ROWS, _TILES, _TILE_BYTES) if tiled else (_STRIPS, _STRIP_BYTES))} - set(tags):
        raise ValueError(f"image without the tags {sorted(missing)}")
    h, w, width = tags[_HEIGHT][0], tags[_WIDTH][0], one[_BITS] // 8
    ph, pw = (tags[_TILE_ROWS][0], tags[_TILE][0]) if tiled else (min(h, tags.get(_ROWS, (h,))[0]), w)
    out = np.zeros((-(-h // ph) * ph, -(-w // pw) * pw), f"{end}f{width}")
    places = [(v, u) for v in range(0, h, ph) for u in range(0, w, pw)]
    for (v, u), start, size in zip(places, tags[_TILES if tiled else _STRIPS], tags[_TILE_BYTES if tiled else _STRIP_BYTES], strict=True):
        raw = content[start : start + size]
        raw = lzw(raw) if one[_COMPRESSION] == _LZW else zlib.decompress(raw) if one[_COMPRESSION] in _DEFLATE else raw
        rows = ph if tiled else min(ph, h - v)
        out[v : v + rows, u : u + pw] = unpredicted(raw, rows, pw, end, width, one[_PREDICTOR])
    return out[:h, :w]


def meshes(spark: SparkSession, path: str, missing: str = "zero") -> DataFrame:
    """mesh (its folder), gv, gu, x, y, z, valid, scale of every mesh folder at or below the path.

    A mesh is x.tif, y.tif and z.tif of one size, and maybe meta.json with `scale` (a
    number, or a list of which the first counts; 1.0 without). Cells of all zeros are
    not valid; with missing='nonpositive' neither is a cell with z <= 0. What one file
    lacks is null and not valid, as is a cell with NaN. Rows of a grid are shuffled as arrays, not as points.
    """
    if missing not in ("zero", "nonpositive"):
        raise ValueError(missing)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{x.tif,y.tif,z.tif,meta.json}").load(path)
    files = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("mesh"), F.regexp_extract("path", r"([^/.]*)\.[^/]*$", 1).alias("name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for mesh, name, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for gv, row in enumerate(float_image(content)):
                    cols = [pa.array([mesh], pa.string()), pa.array([name], pa.string()), pa.array([gv], pa.int32()), pa.array([row.astype(np.float64)], pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["mesh", "name", "gv", "row"])

    rows = files.where("name <> 'meta'").mapInArrow(run, "mesh string, name string, gv int, row array<double>")
    axes = [F.coalesce(F.max(F.when(F.col("name") == c, F.col("row"))), F.expr("cast(array() as array<double>)")).alias(c) for c in "xyz"]
    cells = rows.groupBy("mesh", "gv").agg(*axes).select("mesh", "gv", F.posexplode(F.arrays_zip("x", "y", "z")).alias("gu", "p")).select("mesh", "gv", "gu", "p.x", "p.y", "p.z")
    text = F.col("content").cast("string")
    scale = [F.expr(f"try_cast({c} as double)") for c in ("first_", "whole")]
    meta = files.where("name = 'meta'").select("mesh", F.get_json_object(text, "$.scale[0]").alias("first_"), F.get_json_object(text, "$.scale").alias("whole"))
    meta = meta.select("mesh", F.coalesce(*scale).alias("scale"))
    valid = "x is not null and y is not null and z is not null and not isnan(x + y + z) and abs(x) + abs(y) + abs(z) > 0" + (" and z > 0" if missing == "nonpositive" else "")
    return cells.join(meta, "mesh", "left").select("mesh", "gv", "gu", "x", "y", "z", F.expr(f"coalesce({valid}, false)").alias("valid"), F.coalesce("scale", F.lit(1.0)).alias("scale"))


def sample(pts: DataFrame, rows: DataFrame, depth: int, height: int, width: int) -> DataFrame:
    """pts with `value`: the nearest voxel (half to even, clipped to the volume). Rows meet points by (z, y), so only keys of rows are shuffled against points, not voxels; a row not in the stack, or a null place, gives null."""
    key = pts.withColumns({"_z": nearest(F.col("z"), depth), "_y": nearest(F.col("y"), height), "_x": nearest(F.col("x"), width)})
    wanted = key.select("_z", "_y").distinct()
    near = rows.selectExpr("z _z", "y _y", "values _values").join(wanted, ["_z", "_y"], "left_semi")
    out = key.join(near, ["_z", "_y"], "left").withColumn("value", F.get("_values", F.col("_x").cast("int")))
    return out.select(*[pts[c] for c in pts.columns], "value")


_FILE = "path string, content binary"


def _grid(d: pd.DataFrame, v: str, u: str, cols: list[str]) -> np.ndarray:
    a = np.zeros((int(d[v].max()) + 1, int(d[u].max()) + 1, len(cols)))
    a[d[v].to_numpy(), d[u].to_numpy()] = d[cols].fillna(0).to_numpy()
    return a


def write_points(grid: DataFrame, path: str) -> int:
    """grid(file, v, u, x, y, z, nx, ny, nz) as `<path>/<file>`, readable by `points`. Absent places and null values are zeros; a place that comes twice keeps one point. A file is made in one task and must be below 2 GB. Returns the number of files."""

    def one(d: pd.DataFrame) -> pd.DataFrame:
        a = _grid(d, "v", "u", _AXES)
        head = f"width: {a.shape[1]}\nheight: {a.shape[0]}\ndim: 6\n".encode() + _END
        return pd.DataFrame({"path": [f"{path}/{d['file'].iloc[0]}"], "content": [head + a.astype("<f8").tobytes()]})

    return out.write(grid.select("file", "v", "u", *_AXES).groupBy("file").applyInPandas(one, _FILE))


def encode_image(a: np.ndarray, deflate: bool = False, tile: int | None = None) -> bytes:
    """A little-endian image file of 64-bit floats, readable by `float_image`: one plain strip; or deflated, with byte differences (predictor 3); or in square tiles, whose side is a multiple of 16."""
    h, w = a.shape
    side = (tile, tile) if tile else (max(h, 1), max(w, 1))
    full = np.zeros((-(-h // side[0]) * side[0], -(-w // side[1]) * side[1]), "<f8")
    full[:h, :w] = a
    parts = []
    for v in range(0, full.shape[0], side[0]):
        for u in range(0, full.shape[1], side[1]):
            part = np.ascontiguousarray(full[v : v + side[0], u : u + side[1]])
            if deflate:
                planes = part.astype(">f8").view(np.uint8).reshape(side[0], side[1], 8).transpose(0, 2, 1).reshape(side[0], -1)
                parts.append(zlib.compress(np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes(), 6))
            else:
                parts.append(part.tobytes())
    starts = [8 + sum(map(len, parts[:i])) for i in range(len(parts))]
    where = {_TILE: [tile], _TILE_ROWS: [tile], _TILES: starts, _TILE_BYTES: [len(p) for p in parts]} if tile else {_STRIPS: starts, _ROWS: [h], _STRIP_BYTES: [len(p) for p in parts]}
    tags = {_WIDTH: [w], _HEIGHT: [h], _BITS: [64], _COMPRESSION: [_DEFLATE[0] if deflate else _PLAIN], _SAMPLES: [1], _PREDICTOR: [3 if deflate else 1], _FORMAT: [3], **where}
    data = b"".join(parts)
    entries, lists = b"", b""
    for tag, values in sorted(tags.items()):
        value = values[0]
        if len(values) > 1:  # behind the data
            value = 8 + len(data) + len(lists)
            lists += struct.pack(f"<{len(values)}I", *values)
        entries += struct.pack("<HHII", tag, 4, len(values), value)
    return b"II" + struct.pack("<HI", 42, 8 + len(data) + len(lists)) + data + lists + struct.pack("<H", len(tags)) + entries + bytes(4)


def write_meshes(cells: DataFrame, path: str, scale: float = 1.0, deflate: bool = False, tile: int | None = None) -> int:
    """cells(mesh, gv, gu, x, y, z) as folders `<path>/<mesh>` of x.tif, y.tif, z.tif and meta.json, readable by `meshes`. Absent cells and nulls are zeros. A mesh is made in one task. Returns the number of files."""

    def one(d: pd.DataFrame) -> pd.DataFrame:
        a, root = _grid(d, "gv", "gu", ["x", "y", "z"]), f"{path}/{d['mesh'].iloc[0]}"
        images = {f"{root}/{c}.tif": encode_image(a[:, :, i], deflate, tile) for i, c in enumerate("xyz")} | {f"{root}/meta.json": f'{{"scale": [{scale}, {scale}]}}'.encode()}
        return pd.DataFrame({"path": list(images), "content": list(images.values())})

    return out.write(cells.select("mesh", "gv", "gu", "x", "y", "z").groupBy("mesh").applyInPandas(one, _FILE))


def write_rows(rows: DataFrame, path: str, width: int, height: int, header: int = 368) -> int:
    """rows(z, y, values) as a stack `<path>/<z, five digits>.tif`, readable by `image_rows`; absent rows are zeros. A slice is made in one task. Returns the number of files."""

    def one(d: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((height, width), "<u2")
        for y, v in zip(d["y"], d["values"], strict=True):
            a[y] = v
        return pd.DataFrame({"path": [f"{path}/{int(d['z'].iloc[0]):05}.tif"], "content": [bytes(header) + a.tobytes()]})

    return out.write(rows.select("z", "y", "values").groupBy("z").applyInPandas(one, _FILE))
