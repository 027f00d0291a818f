"""Column expressions for 3-D geometry; all but `c_turns` stays inside generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column | float]


def _c(v: Column | float | str) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))


def dot(a: Vector, b: Vector) -> Column:
    """a . b"""
    out = _c(a[0]) * _c(b[0])
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + _c(x) * _c(y)
    return out


def cross(a: Vector, b: Vector) -> list[Column]:
    """a x b"""
    a, b = [_c(v) for v in a], [_c(v) for v in b]
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vector) -> Column:
    """Length of a vector."""
    return F.sqrt(dot(a, a))


def sub(a: Vector, b: Vector) -> list[Column]:
    """a - b"""
    return [_c(x) - _c(y) for x, y in zip(a, b, strict=True)]


def rotate(matrix: Sequence[Vector], p: Vector) -> list[Column]:
    """The product of a 3x3 matrix (rows) and a vector."""
    return [dot(row, p) for row in matrix]


def finite(*columns: str) -> Column:
    """Whether all columns are numbers (not null, NaN or infinite)."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def c_turns(angles: Column) -> Column:
    """array<struct<c, s>> of the cosine and sine of each angle of an array, by the C library's functions.

    The virtual machine's differ from them in the last bit for one value in some hundreds, which puts a point on a cell's border
    into the next cell. Python code and DuckDB use the C library's, so a batch has the cells of its stream and of its SQL.
    """

    def turns(rows: pa.Array) -> pa.Array:
        flat = rows.flatten().to_pylist()
        parts = [pa.array([None if v is None else f(v) if math.isfinite(v) else math.nan for v in flat], pa.float64()) for f in (math.cos, math.sin)]
        ends = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), pa.StructArray.from_arrays(parts, ["c", "s"]), mask=rows.is_null())

    # Marked so that filters above it don't repeat it.
    return F.arrow_udf(turns, "array<struct<c: double, s: double>>").asNondeterministic()(angles)


def range_xy(x: str = "x", y: str = "y") -> Column:
    """Distance from the sensor axis."""
    return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))


def align_to_up(n: Vector) -> list[list[Column]]:
    """Rotation matrix (rows) that turns the unit normal n to +z; identity where n is (anti)parallel to it."""
    nx, ny, nz = (_c(v) for v in n)
    # The axis is n x z = (ny, -nx, 0); with s = |axis| and c = nz, R = I + K + K K (1 - c) / s^2.
    s2 = nx * nx + ny * ny
    turn = F.sqrt(s2) >= 1e-6
    f = F.when(turn, (1 - nz) / s2).otherwise(0.0)
    k = [[F.lit(0.0), F.lit(0.0), -nx], [F.lit(0.0), F.lit(0.0), -ny], [nx, ny, F.lit(0.0)]]
    kk = [[-nx * nx, -nx * ny, F.lit(0.0)], [-nx * ny, -ny * ny, F.lit(0.0)], [F.lit(0.0), F.lit(0.0), -s2]]
    return [[(F.lit(1.0) if i == j else F.lit(0.0)) + F.when(turn, k[i][j]).otherwise(0.0) + kk[i][j] * f for j in range(3)] for i in range(3)]


def plane_offset(n: Vector, d: Column | float, p: Vector) -> Column:
    """Signed distance n . p + d."""
    return dot(n, p) + _c(d)


def in_box(p: Vector, center: Vector, axes: Sequence[Vector], extents: Vector, margin: float, thin_margin: float | None = None) -> Column:
    """Whether p lies strictly inside an oriented box whose half-extents grow by margin.

    With thin_margin, the first of the smallest extents grows by that instead.
    """
    local = [dot(axis, sub(p, center)) for axis in axes]
    e = [_c(v) for v in extents]
    if thin_margin is None:
        grown = [v + margin for v in e]
    else:
        thin = [(e[0] <= e[1]) & (e[0] <= e[2]), (e[1] < e[0]) & (e[1] <= e[2]), (e[2] < e[0]) & (e[2] < e[1])]
        grown = [v + F.when(t, thin_margin).otherwise(margin) for v, t in zip(e, thin, strict=True)]
    out = F.lit(True)
    for v, g in zip(local, grown, strict=True):
        out = out & (F.abs(v) < g)
    return out


def wrap_angle(a: Column) -> Column:
    """The angle in (-pi, pi]."""
    return F.atan2(F.sin(a), F.cos(a))


def azimuth_bin(x: str, y: str, bins: int) -> Column:
    """Bin of the azimuth, from 0."""
    u = F.floor((F.atan2(y, x) + math.pi) / (2 * math.pi) * bins)
    return F.least(F.greatest(u, F.lit(0)), F.lit(bins - 1)).cast("int")


def elevation_bin(x: str, y: str, z: str, bins: int) -> Column:
    """Bin of the elevation, from 0."""
    r = norm([F.col(x), F.col(y), F.col(z)])
    s = F.least(F.greatest(F.col(z) / F.greatest(r, F.lit(1e-6)), F.lit(-1.0)), F.lit(1.0))
    v = F.floor((F.asin(s) + math.pi / 2) / math.pi * bins)
    return F.least(F.greatest(v, F.lit(0)), F.lit(bins - 1)).cast("int")


def wendland(u: Column) -> Column:
    """Compactly supported C2 kernel (1 - u)^4 (4 u + 1) on [0, 1)."""
    v = 1 - u
    return F.when((u >= 0) & (u < 1), v * v * v * v * (4 * u + 1)).otherwise(0.0)


def wendland_slope(u: Column) -> Column:
    """Its derivative, -20 u (1 - u)^3."""
    v = 1 - u
    return F.when((u >= 0) & (u < 1), -20 * u * v * v * v).otherwise(0.0)


def symmetric_eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """Eigenvalues of a symmetric 3x3 matrix, ascending, by the trigonometric formula."""
    off = xy * xy + xz * xz + yz * yz
    q = (xx + yy + zz) / 3
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off
    p = F.sqrt(p2 / 6)
    bx, by, bz = (xx - q) / p, (yy - q) / p, (zz - q) / p
    cxy, cxz, cyz = xy / p, xz / p, yz / p
    det = bx * (by * bz - cyz * cyz) - cxy * (cxy * bz - cyz * cxz) + cxz * (cxy * cyz - by * cxz)
    phi = F.acos(F.least(F.greatest(det / 2, F.lit(-1.0)), F.lit(1.0))) / 3
    high = q + 2 * p * F.cos(phi)
    low = q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    flat = p2 <= 1e-300
    return [F.when(flat, q).otherwise(v) for v in (low, 3 * q - high - low, high)]


def determinant(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Column:
    """Determinant of a symmetric 3x3 matrix."""
    return xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
