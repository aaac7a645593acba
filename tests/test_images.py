"""Mesh images by their description: compressions, predictors, strips, tiles and byte orders."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from voxelframe.sources import surfaces


def lzw_encoded(data: bytes) -> bytes:
    bits, out = [], {bytes([i]): i for i in range(256)}
    size, word = 9, b""
    emit = lambda code: bits.append(format(code, f"0{size}b"))
    emit(256)
    for b in data:
        if word + bytes([b]) in out:
            word += bytes([b])
            continue
        emit(out[word])
        out[word + bytes([b])] = len(out) + 2
        if len(out) + 2 >= 4094:
            emit(256)
            out, size = {bytes([i]): i for i in range(256)}, 9
        else:
            size = max(9, (len(out) + 2).bit_length())
        word = bytes([b])
    if word:
        emit(out[word])
        size = max(9, (len(out) + 3).bit_length()) if len(out) + 3 < 4095 else 12
    emit(257)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def image(a, end, kind, compression, predictor, tile=None, rows=None):
    """An image file written by the format's description."""
    h, w = a.shape
    width = int(kind[1])
    ph, pw = (tile or rows or h), (tile or w)
    parts = []
    for v in range(0, h, ph):
        for u in range(0, w, pw):
            n = ph if tile else min(ph, h - v)
            part = np.zeros((n, pw), f"{end}{kind}")
            part[: min(n, h - v), : min(pw, w - u)] = a[v : v + n, u : u + pw]
            if predictor == 2:
                words = part.view(f"{end}u{width}").astype(f"u{width}")
                raw = np.diff(words, axis=1, prepend=np.zeros((n, 1), words.dtype)).astype(f"{end}u{width}").tobytes()
            elif predictor == 3:
                raw = b""
                for row in part.astype(f">{kind}"):
                    planes = row.view(np.uint8).reshape(pw, width).T.reshape(-1)
                    raw += bytes([planes[0], *[(int(y) - int(x)) % 256 for x, y in zip(planes, planes[1:])]])
            else:
                raw = part.tobytes()
            parts.append({1: bytes, 5: lzw_encoded, 8: zlib.compress, 32946: zlib.compress}[compression](raw))
    starts = [8 + sum(map(len, parts[:i])) for i in range(len(parts))]
    tags = {256: [w], 257: [h], 258: [8 * width], 259: [compression], 277: [1], 317: [predictor], 339: [3]}
    tags |= {322: [tile], 323: [tile], 324: starts, 325: [len(p) for p in parts]} if tile else {273: starts, 278: [ph], 279: [len(p) for p in parts]}
    data, lists, entries = b"".join(parts), b"", b""
    for tag, values in sorted(tags.items()):
        value = values[0]
        if len(values) > 1:
            value = 8 + len(data) + len(lists)
            lists += struct.pack(f"{end}{len(values)}I", *values)
        entries += struct.pack(f"{end}HHII", tag, 4, len(values), value)
    mark = b"II" if end == "<" else b"MM"
    return mark + struct.pack(f"{end}HI", 42, 8 + len(data) + len(lists)) + data + lists + struct.pack(f"{end}H", len(tags)) + entries + bytes(4)


@pytest.fixture(scope="module")
def grid():
    rng = np.random.default_rng(13)
    a = np.cumsum(rng.normal(size=(37, 50)), axis=1).round(2) * 100
    a[rng.random(a.shape) < 0.3] = 0
    a[0, :4] = np.nan, np.inf, -0.0, 1e-30
    return a


@pytest.mark.parametrize("end", ["<", ">"])
@pytest.mark.parametrize("kind", ["f4", "f8"])
@pytest.mark.parametrize("compression", [1, 5, 8, 32946])
@pytest.mark.parametrize("predictor", [1, 2, 3])
@pytest.mark.parametrize("layout", [{}, {"rows": 5}, {"tile": 16}])
def test_images(grid, end, kind, compression, predictor, layout):
    a = grid.astype(kind)
    got = surfaces.float_image(image(a, end, kind, compression, predictor, **layout))
    assert got.shape == a.shape and np.array_equal(got, a, equal_nan=True)


@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("tile", [None, 16, 64])
def test_written_images_come_back(grid, deflate, tile):
    for a in (grid, grid[:1, :1]):
        got = surfaces.float_image(surfaces.encode_image(a, deflate, tile))
        assert np.array_equal(got, a, equal_nan=True)
    assert len(surfaces.encode_image(np.zeros((500, 500)), True)) < 5_000


def test_lzw_of_long_and_empty_data():
    rng = np.random.default_rng(14)
    for data in (b"", b"a", b"a" * 10_000, bytes(rng.integers(0, 256, 30_000, dtype=np.uint8)), bytes(rng.integers(0, 3, 60_000, dtype=np.uint8))):
        assert surfaces.lzw(lzw_encoded(data)) == data


def test_other_layouts_are_refused(grid):
    good = image(grid, "<", "f8", 1, 1)
    for tag, value in ((259, 7), (277, 3), (339, 1), (258, 16), (317, 4)):
        bad = bytearray(good)
        at = good.index(struct.pack("<HHI", tag, 4, 1))
        bad[at + 8 : at + 12] = struct.pack("<I", value)
        with pytest.raises(ValueError, match="not supported"):
            surfaces.float_image(bytes(bad))
    with pytest.raises(ValueError, match="classic"):
        surfaces.float_image(b"II" + struct.pack("<HI", 43, 8) + bytes(20))
