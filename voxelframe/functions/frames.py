"""Coordinate frames as column expressions: affine maps and the registration chain."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the coarse transform.
ANGLE, Z0, WIDTH, HEIGHT, UNIT, UP = 300.5, 1056.0, 493, 493, 7.91 / 76.77, 32
#: Drift of the in-plane shift, fitted to (z, dx, dy).
DRIFT = ((315, -65, -63), (420, -65, -58), (525, -65, -55), (630, -65, -51), (735, -73, -51))


def line(points: list[tuple[float, float]]) -> tuple[float, float]:
    """Slope and intercept of least squares."""
    n = len(points)
    mx, my = sum(x for x, _ in points) / n, sum(y for _, y in points) / n
    slope = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)
    return slope, my - slope * mx


def affine(m: list[list[float]], x: Column, y: Column, z: Column) -> list[Column]:
    """Three rows of a 3x4 or 4x4 matrix applied to a point."""
    return [r[0] * x + r[1] * y + r[2] * z + r[3] for r in m[:3]]


def padded(m: list[list[float]]) -> list[list[float]]:
    """A 3x4 or 4x4 matrix as 4x4; other shapes raise."""
    if len(m) not in (3, 4) or any(len(r) != 4 for r in m):
        raise ValueError(f"not a 3x4 or 4x4 matrix: {m}")
    return [[float(v) for v in r] for r in m] + [[0.0, 0.0, 0.0, 1.0]] * (4 - len(m))


def load_affine(spark: SparkSession, path: str) -> list[list[float]]:
    """The 4x4 matrix of a JSON file {"params": rows}; a file without it raises."""
    row = spark.read.schema("params array<array<double>>").json(path, multiLine=True).first()
    if row is None or row.params is None:
        raise ValueError(f"no params in {path}")
    return padded(row.params)


def inverse(m: list[list[float]]) -> list[list[float]]:
    """The inverse of a 3x4 or 4x4 matrix; a singular one raises."""
    return np.linalg.inv(np.array(padded(m))).tolist()


def rotate(m: list[list[float]], x: Column, y: Column, z: Column) -> list[Column]:
    """A direction under the matrix's linear part divided by its mean column norm, with length 1 (floor 1e-9)."""
    scale = sum(math.sqrt(sum(m[i][j] ** 2 for i in range(3))) for j in range(3)) / 3
    return unit(*[(r[0] * x + r[1] * y + r[2] * z) / scale for r in m[:3]])


def unit(x: Column, y: Column, z: Column) -> list[Column]:
    n = F.greatest(F.sqrt(x * x + y * y + z * z), F.lit(1e-9))
    return [x / n, y / n, z / n]


def register(x: Column, y: Column, z: Column) -> list[Column]:
    """Old frame to new frame: scale, z inversion, linear drift, inverse rotation, unflip, up-scaling."""
    (sx, ix), (sy, iy) = line([(a, b) for a, b, _ in DRIFT]), line([(a, c) for a, _, c in DRIFT])
    ca, sa = math.cos(math.radians(ANGLE)), math.sin(math.radians(ANGLE))
    cx, cy = WIDTH / 2, HEIGHT / 2
    zn = Z0 - z * UNIT
    qx = x * UNIT - cx - (sx * zn + ix)
    qy = y * UNIT - cy - (sy * zn + iy)
    return [((WIDTH - 1) - (ca * qx - sa * qy + cx)) * UP, (sa * qx + ca * qy + cy) * UP, zn * UP]


def nearest(c: Column, n: int) -> Column:
    """Half-even rounding, clipped to 0..n-1; null stays null (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(F.rint(c), F.lit(0.0)), F.lit(float(n - 1)))).cast("long")


def contrast(v: Column) -> Column:
    """Contrast table: 0, 64 at 128, 255 at 255, truncated."""
    return F.floor(F.when(v <= 128, v * 0.5).otherwise(64 + (v - 128) * 191.0 / 127)).cast("long")


def present(x: Column, y: Column, z: Column) -> Column:
    """A point that is not missing: missing ones are all zero. A null part counts as missing."""
    return F.coalesce((x != 0) | (y != 0) | (z != 0), F.lit(False)) & x.isNotNull() & y.isNotNull() & z.isNotNull()


def filled(c: Column) -> Column:
    """Null and NaN as 0."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def to_grid(u: Column, v: Column, scale: Column) -> list[Column]:
    """Pixels of a rendered image to places of the mesh's grid."""
    return [u * scale, v * scale]


#: Size of a voxel of the segmented volume in micrometres.
MICRONS = 9.6


def microns(voxels: Column) -> Column:
    return voxels * MICRONS
