"""Joins of points with the parts of a map, however large: parts are put into the grid cells that they touch.

A part is a box or a slab of a plane. A slab without bounds is cut off at the points' own box, so its cells are finite too. Each part has one row for each cell
it may touch; a point has one cell, meets every part at most once, and the exact condition is checked behind the equi-join, which
Spark does by broadcast or by shuffle as the sizes are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.stage import staged

P = ("x", "y", "z")
FEW = 64  # parts that are compared with every point
FINEST = 128  # cells along the points' box at most


@dataclass(frozen=True)
class Reach:
    """Where a part may hold points: bounds by axis (null: none) and, for slabs, the normal, offset and half-thickness of its plane (null: a box)."""

    low: Sequence[Column]
    high: Sequence[Column]
    normal: Sequence[Column] | None = None
    offset: Column | None = None
    half: Column | None = None


def box_reach(center: Sequence[Column], axes: Sequence[Sequence[Column]], extents: Sequence[Column]) -> Reach:
    """The least upright box around a turned one, for axes of any length."""
    half = [sum((F.abs(axes[i][k]) * extents[i] for i in range(3)), F.lit(0.0)) for k in range(3)]
    return Reach([c - h for c, h in zip(center, half, strict=True)], [c + h for c, h in zip(center, half, strict=True)])


def _bounds(points: DataFrame) -> list[tuple[float, float]]:
    finite = points.filter(" AND ".join(f"abs({c}) < double('Infinity')" for c in P))
    row = finite.agg(*[f(c) for c in P for f in (F.min, F.max)]).first()
    return [(float(row[2 * k] or 0.0), float(row[2 * k + 1] or 0.0)) for k in range(3)]


def _cell(value: Column, width: float) -> Column:
    return F.floor(value / width).cast("long")


def touched_cells(parts: DataFrame, reach: Reach, bounds: Sequence[tuple[float, float]], width: float) -> DataFrame:
    """Each part once for every cell (kx, ky, kz) of the points' box that it may touch."""
    names = [f"_{n}{c}" for n in ("lo", "hi", "n") for c in P]
    plane = reach.normal is not None
    values = [F.greatest(F.coalesce(v, F.lit(b[0])), F.lit(b[0])) for v, b in zip(reach.low, bounds, strict=True)]
    values += [F.least(F.coalesce(v, F.lit(b[1])), F.lit(b[1])) for v, b in zip(reach.high, bounds, strict=True)]
    values += list(reach.normal) if plane else [F.lit(None).cast("double")] * 3
    rows = parts.select("*", *[v.alias(n) for v, n in zip(values, names, strict=True)], (reach.offset if plane else F.lit(None).cast("double")).alias("_d"), (reach.half if plane else F.lit(None).cast("double")).alias("_half"))
    rows = rows.filter(" AND ".join(f"_lo{c} <= _hi{c}" for c in P))
    size = {c: F.abs(F.coalesce(F.col(f"_n{c}"), F.lit(0.0))) for c in P}
    out = None
    for k, c in enumerate(P):
        a, b = (P[(k + 1) % 3], P[(k + 2) % 3])
        # Cells are counted along the two axes that the plane rises least against; along the third it crosses few of them.
        steepest = (size[c] >= size[a]) & (size[c] > size[b]) if k == 0 else (size[c] >= size[a]) & (size[c] >= size[b]) & ~((size["x"] >= size["y"]) & (size["x"] > size["z"])) & (F.lit(k == 1) | ~((size["y"] >= size["z"]) & (size["y"] >= size["x"])))
        square = rows.filter(steepest)
        for s in (a, b):
            square = square.withColumn(f"k{s}", F.explode(F.sequence(_cell(F.col(f"_lo{s}"), width), _cell(F.col(f"_hi{s}"), width))))
        middle = {s: (F.col(f"k{s}") + 0.5) * width for s in (a, b)}
        rise = -(F.col("_d") + F.col(f"_n{a}") * middle[a] + F.col(f"_n{b}") * middle[b]) / F.col(f"_n{c}")
        slack = ((size[a] + size[b]) * width / 2 + F.col("_half")) / size[c]
        low, high = F.greatest(F.col(f"_lo{c}"), F.coalesce(rise - slack, F.col(f"_lo{c}"))), F.least(F.col(f"_hi{c}"), F.coalesce(rise + slack, F.col(f"_hi{c}")))
        square = square.withColumn("_from", _cell(low, width)).withColumn("_to", _cell(high, width)).filter("_from <= _to")
        square = square.withColumn(f"k{c}", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
        square = square.select(*parts.columns, *[f"k{s}" for s in P])
        out = square if out is None else out.unionByName(square)
    return out


def join_map(points: DataFrame, parts: DataFrame, condition: Column, reach: Reach, how: str) -> DataFrame:
    """points joined with the parts that meet the condition, which implies `reach`; `how` is left_semi, left_anti or left_outer."""
    if parts.limit(FEW + 1).count() <= FEW:
        return points.join(F.broadcast(parts), condition, how)
    bounds = _bounds(points)
    longest = max(b - a for a, b in bounds) or 1.0
    spans = [F.least(F.coalesce(h - low, F.lit(longest)), F.lit(longest)) for low, h in zip(reach.low, reach.high, strict=True)]
    typical = parts.select(F.percentile_approx(F.array_max(F.array(*spans)), 0.5)).first()[0] or 0.0
    width = max(float(typical), longest / FINEST)
    cells = staged(touched_cells(parts, reach, bounds, width), "map-cells")
    keyed = points.withColumns({f"_p{c}": _cell(F.col(c), width) for c in P})
    same = [F.col(f"_p{c}") == F.col(f"k{c}") for c in P]
    met = keyed.join(cells, same[0] & same[1] & same[2] & condition, how)
    return met.drop(*[f"_p{c}" for c in P], *[f"k{c}" for c in P])
