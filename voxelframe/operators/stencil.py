"""Neighbourhood operators on a dense grid (v, u, value), as kernels on blocks with a halo.

Each gives every cell of the grid; cells without a row are 0 (see grids.apply).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from . import grids
from .grids import BLOCK, MIRROR, REPEAT, correlate

#: The 5 x 5 derivative's smoothing and difference rows.
SMOOTH, DIFF = (1, 4, 6, 4, 1), (-1, -2, 0, 2, 1)


def median5(grid: DataFrame, h: int, w: int, size: int = BLOCK) -> DataFrame:
    """5 x 5 median, edges repeated."""

    def kernel(x):
        return [np.median(np.lib.stride_tricks.sliding_window_view(x[0], (5, 5)), axis=(2, 3))]

    return grids.apply(grid, h, w, ["value"], 2, REPEAT, kernel, ["value"], size)


def tangents(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """5 x 5 derivatives along u and v of an array with a halo of two."""
    return correlate(correlate(x, SMOOTH, 0), DIFF, 1), correlate(correlate(x, DIFF, 0), SMOOTH, 1)


def sobel(grid: DataFrame, h: int, w: int, size: int = BLOCK) -> DataFrame:
    """(v, u, du, dv): 5 x 5 derivatives along u and v."""
    return grids.apply(grid, h, w, ["value"], 2, MIRROR, lambda x: tangents(x[0]), ["du", "dv"], size)


def cross(x, y, z) -> list[np.ndarray]:
    """Unit normals of arrays with a halo of two: the cross product of the tangents along u and v, divided by its length (floor 1e-9)."""
    (xu, xv), (yu, yv), (zu, zv) = map(tangents, (x, y, z))
    n = [yu * zv - zu * yv, zu * xv - xu * zv, xu * yv - yu * xv]
    length = np.maximum(np.sqrt(n[0] ** 2 + n[1] ** 2 + n[2] ** 2), 1e-9)
    return [c / length for c in n]


def normals(grid: DataFrame, h: int, w: int, size: int = BLOCK) -> DataFrame:
    """(v, u, nx, ny, nz) of a surface grid (v, u, x, y, z); all three coordinates go through one shuffle."""
    return grids.apply(grid, h, w, ["x", "y", "z"], 2, MIRROR, lambda a: cross(*a), ["nx", "ny", "nz"], size)


def gaussian(grid: DataFrame, h: int, w: int, sigma: float = 3.0, width: int = 25, size: int = BLOCK) -> DataFrame:
    """Separable Gaussian blur of `width` (odd) cells; both passes run on one block."""
    r = width // 2
    k = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    k = [x / sum(k) for x in k]
    return grids.apply(grid, h, w, ["value"], r, MIRROR, lambda x: [correlate(correlate(x[0], k, 1), k, 0)], ["value"], size)


def enlarged(x: np.ndarray, up: int) -> np.ndarray:
    """Bilinear enlargement with half-pixel centres of an array with a halo of one."""
    for axis in (0, 1):
        n = (x.shape[axis] - 2) * up
        at = (np.arange(n) + 0.5) / up + 0.5
        i = np.floor(at).astype(int)
        f = (at - i).reshape((-1, 1) if axis == 0 else (1, -1))
        x = np.take(x, i, axis) * (1 - f) + np.take(x, i + 1, axis) * f
    return x


def resize(grid: DataFrame, h: int, w: int, up: int, size: int = BLOCK) -> DataFrame:
    """(ov, ou, value): bilinear enlargement with half-pixel centres, clamped at the border."""
    return grids.apply(grid, h, w, ["value"], 1, REPEAT, lambda x: [enlarged(x[0], up)], ["value"], size, up, ("ov", "ou"))
