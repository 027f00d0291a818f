"""Neighbourhood joins on point rows, as equi-joins on grid cells.

A distance predicate alone would make Spark compare all pairs. Here every point
is put into a cubic cell as wide as the search radius, one side is repeated
for its 27 neighbouring cells, and the rest is an equi-join with an exact
distance filter, which shuffles by cell and splits skewed cells under AQE.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointloom.operators.stage import staged

P = ("x", "y", "z")
_OFFSETS = "transform(sequence(0, 26), k -> struct(cast(k % 3 - 1 AS long) AS dx, cast(floor(k / 3) % 3 - 1 AS long) AS dy, cast(floor(k / 9) - 1 AS long) AS dz))"


def cells(points: DataFrame, width: float) -> DataFrame:
    """Points with their cell (cx, cy, cz)."""
    return points.withColumns({f"c{c}": F.floor(F.col(c) / width).cast("long") for c in P})


def distance(a: str, b: str) -> Column:
    """Distance of two structs with x, y and z."""
    return F.sqrt(sum((F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), 2) for c in P), F.lit(0.0)))


def radius_join(left: DataFrame, right: DataFrame, radius: float, by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """All (a, b, d) with a from left, b from right, distance d up to radius (below it if strict), equal in `by`."""
    keys = [*by, "cx", "cy", "cz"]
    a = cells(left, radius).select(*keys, F.struct(*left.columns).alias("a"))
    b = cells(right, radius).select(*by, "cx", "cy", "cz", F.struct(*right.columns).alias("b"), F.explode(F.expr(_OFFSETS)).alias("o"))
    b = b.select(*by, *[(F.col(f"c{c}") + F.col(f"o.d{c}")).alias(f"c{c}") for c in P], "b")
    met = a.join(b, keys).withColumn("d", distance("a", "b"))
    return met.filter(F.col("d") < radius if strict else F.col("d") <= radius).select(*by, "a", "b", "d")


def eps_pairs(points: DataFrame, eps: float, by: Sequence[str] = (), key: str = "point_id") -> DataFrame:
    """Ordered pairs (i, j, d) of different points within eps."""
    met = radius_join(points, points, eps, by)
    return met.filter(F.col(f"a.{key}") != F.col(f"b.{key}")).select(*by, F.col(f"a.{key}").alias("i"), F.col(f"b.{key}").alias("j"), "d")


CROWD = 8  # points that share a cell with one, on average, where a search starts
HALVINGS = 12  # at most, of a search radius


def _first_radius(points: DataFrame, radius: float, by: Sequence[str]) -> float:
    """The radius, halved until a point shares its cell with no more than CROWD others on average."""
    fine = cells(points, radius / 2**HALVINGS).groupBy(*by, "cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"))
    crowd = []
    for level in range(HALVINGS + 1):
        up = [F.shiftright(f"c{c}", HALVINGS - level).alias(f"c{c}") for c in P]
        crowd.append(fine.groupBy(*by, *up).agg(F.sum("n").alias("n")).agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).alias("mates"), F.lit(level).alias("level")))
    found = {r.level: r.mates or 0.0 for r in functools.reduce(DataFrame.unionByName, crowd).collect()}
    return radius / 2 ** next((level for level in range(HALVINGS + 1) if found[level] <= CROWD), HALVINGS)


def knn_within(points: DataFrame, k: int, radius: float, by: Sequence[str] = (), key: str = "point_id") -> DataFrame:
    """(i, j, d, rank): each point's k nearest within radius, itself included; ties by key, which tells points of all groups apart.

    The search starts as wide as points lie apart, and doubles up to the radius for those that have not found k: what is joined and shuffled grows with
    the points, not with the pairs within the radius. Of points at one place only the k least keys can be among anyone's k nearest, so no more are met.
    """
    points = staged(points.select(*by, key, *P), "knn")
    place = W.partitionBy(*by, *P).orderBy(key)
    reference = staged(points.withColumn("copy", F.row_number().over(place)).filter(F.col("copy") <= k).drop("copy"), "knn")
    reach, left, out = _first_radius(reference, radius, by), points, None
    while True:
        met = radius_join(reference, left, reach, by).select(*by, F.col(f"b.{key}").alias("i"), F.col(f"a.{key}").alias("j"), "d")
        ranked = staged(met.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy("d", "j"))).filter(F.col("rank") <= k), "knn")
        if reach >= radius:
            return ranked if out is None else out.unionByName(ranked)
        done = ranked.filter(F.col("rank") == k).select("i")
        full = ranked.join(done, "i", "left_semi").select(*ranked.columns)
        out = full if out is None else out.unionByName(full)
        left, reach = staged(left.join(done, F.col(key) == F.col("i"), "left_anti"), "knn"), min(2 * reach, radius)


def _diameter(*clouds: DataFrame) -> float:
    """The diagonal of the least box around the finite points of all clouds."""
    spans = [F.max(c) - F.min(c) for c in P]
    finite = [c.select(*P).filter(" AND ".join(f"abs({a}) < double('Infinity')" for a in P)) for c in clouds]
    return sum((v or 0.0) ** 2 for v in functools.reduce(DataFrame.unionByName, finite).agg(*spans).first()) ** 0.5


def nearest_label(points: DataFrame, reference: DataFrame, radius: float | None, label: str, by: Sequence[str] = (), key: str = "point_id", others: bool = False) -> DataFrame:
    """Each point's label of its nearest reference point (of another key, if `others`), however far that is.

    The radius (by default as far as reference points lie apart on average) doubles until all points have one, or until it spans both clouds: points that have none
    then (not finite, or without a reference point in their group) get no row. The points still left, fewer each time, are those repeated for their cells.
    """
    points, reference, out = staged(points, "nearest"), staged(reference, "nearest"), None
    left, reach = points, _diameter(points, reference)
    radius = radius or max(reach, 1e-9) / max(1, reference.count()) ** (1 / 3)
    while True:
        met = radius_join(reference, left, radius, by)
        met = met.filter(F.col(f"a.{key}") != F.col(f"b.{key}")) if others else met
        found = met.groupBy(F.col(f"b.{key}").alias(key)).agg(F.min_by(F.struct(F.col(f"a.{label}").alias(label), "d"), F.struct("d", F.col(f"a.{key}").alias("j"))).alias("n")).select(key, f"n.{label}", "n.d")
        found = staged(found, "nearest")
        out = found if out is None else out.unionByName(found)
        left = points.join(out.select(key), key, "left_anti")
        if radius > reach or left.isEmpty():
            return out
        radius *= 2


def ball_promote(points: DataFrame, centre: DataFrame, radius: float, source: int, target: int) -> DataFrame:
    """Points of label `source` within radius of the one-row centre (mx, my, mz) get label `target`."""
    joined = points.crossJoin(F.broadcast(centre))
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"m{c}"), 2) for c in P), F.lit(0.0)))
    return joined.withColumn("label", F.when((F.col("label") == source) & (d <= radius), target).otherwise(F.col("label"))).drop("mx", "my", "mz")


VOXEL_ROWS = 1 << 19  # points of one task that puts them into voxels


def voxel_key(points: DataFrame, size: float, by: Sequence[str] = (), half: bool = False) -> DataFrame:
    """Points with voxel indices vx, vy, vz, anchored at the cloud's least corner (half a voxel lower if `half`).

    More than VOXEL_ROWS points are dealt by group (without groups by voxel) into tasks of about as many, so that what a task sorts and
    sums for its voxels doesn't grow with the input. The corners are written once, with their counts.
    """
    low = staged(points.groupBy(*by).agg(*[F.min(c).alias(f"l{c}") for c in P], F.count(F.lit(1)).alias("rows")), "corners")
    rows = low.agg(F.sum("rows")).first()[0] or 0
    many, tasks = rows > VOXEL_ROWS, max(-(-rows // VOXEL_ROWS), points.sparkSession.sparkContext.defaultParallelism)
    low = low.drop("rows")
    dealt = points.repartition(tasks, *by) if many and by else points
    joined = dealt.join(low, list(by)) if by else points.crossJoin(F.broadcast(low))
    shift = size / 2 if half else 0.0
    keyed = joined.withColumns({f"v{c}": F.floor((F.col(c) - F.col(f"l{c}") + shift) / size).cast("long") for c in P}).drop("lx", "ly", "lz")
    return keyed.repartition(tasks, "vx", "vy", "vz") if many and not by else keyed


def voxel_mean(points: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    """One row a voxel: mean position and intensity, and its number of points."""
    keyed = voxel_key(points, size, by)
    return keyed.groupBy(*by, "vx", "vy", "vz").agg(*[F.avg(c).alias(c) for c in (*P, "intensity")], F.count(F.lit(1)).alias("n"))


def voxel_trace(points: DataFrame, size: float, by: Sequence[str] = (), key: str = "point_id") -> DataFrame:
    """One row a voxel with the sorted ids of its members; a voxel holds what a sensor puts into its volume."""
    return voxel_key(points, size, by).groupBy(*by, "vx", "vy", "vz").agg(F.sort_array(F.collect_list(key)).alias("members"))


def voxel_first(points: DataFrame, size: float, by: Sequence[str] = (), key: str = "point_id") -> DataFrame:
    """One row a voxel: mean position, the intensity and id of its first point."""
    keyed = voxel_key(points, size, by, half=True)
    first = F.min(F.struct(F.col(key).alias("first_id"), "intensity")).alias("first")
    out = keyed.groupBy(*by, "vx", "vy", "vz").agg(*[F.avg(c).alias(c) for c in P], first)
    return out.select(*by, "vx", "vy", "vz", *P, "first.intensity", "first.first_id")


BLOCK, REACH = 4096, 65_536  # points, and primitives around them, of one block
DENSE = 1 << 20  # pairs of a cell and its sides from which on they are summed in blocks
TASKS = 1000
_TILE = 1 << 17  # pairs at once


def _field_block(x: np.ndarray, q: np.ndarray, h: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, how many primitives hold it) of each point x over primitives q; small boxes of points meet only what their supports reach."""
    widest, total, met = h.max(), np.zeros(len(x)), np.zeros(len(x), np.int64)
    box = np.floor((x - x.min(axis=0)) / (widest / 4)).astype(np.int64)
    _, of = np.unique(box, axis=0, return_inverse=True)
    order = np.argsort(of, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        own = x[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        gap = np.maximum(np.maximum(low - q, q - high), 0.0)
        reach = np.flatnonzero((gap * gap).sum(axis=1) <= widest * widest)
        step = max(1, _TILE // len(rows))
        for first in range(0, len(reach), step):
            k = reach[first : first + step]
            hk, ak, centred = h[k], alpha[k], q[k] - low
            r = np.sqrt(sum((own[:, c, None] - q[k, c]) ** 2 for c in range(3)))
            v = np.maximum(1 - r / hk, 0.0)
            cube = v * v * v
            met[rows] += (r < hk).sum(axis=1)
            total[rows] += (cube * v * (5 - 4 * v)) @ ak[:, 0]
            pull = (own - low) @ ak[:, 1:].T - (centred * ak[:, 1:]).sum(axis=1)
            total[rows] += (np.where(r > 1e-9, cube, 0.0) * (20 / (hk * hk)) * pull).sum(axis=1)
    return total, met


def field_value(points: DataFrame, primitives: DataFrame, key: str = "point_id", default: float = 0.08, by: Sequence[str] = ()) -> DataFrame:
    """Implicit field at each point: sum of kernel times alpha_v minus slope / r times D . alpha_g over the
    primitives (px, py, pz, support h) whose support holds it, of the point's group in `by`; `default` where none does. `key` tells points of all groups apart.

    Points meet primitives by grid cells as wide as the widest support. Cells with few pairs are joined; in the others the pairs, which may
    be quadratic in the input, never become rows: points and primitives around them are dealt into blocks of bounded size, each summed in arrays.
    """
    from pointloom.functions.geometry import wendland, wendland_slope

    primitives = staged(primitives, "field")  # a fitted surface is built once
    widest = primitives.agg(F.max("h")).first()[0]
    if not widest:
        return points.withColumn("field", F.lit(default))
    keys, weights = [*by, "cx", "cy", "cz"], ["alpha_v", *[f"alpha_g{c}" for c in P]]
    a = cells(points.select(*by, key, *P), widest)
    placed = cells(primitives.select(*by, *[F.col(f"p{c}").alias(c) for c in P], "h", *weights), widest)
    around = lambda df: df.withColumn("o", F.explode(F.expr(_OFFSETS))).withColumns({f"c{c}": F.col(f"c{c}") + F.col(f"o.d{c}") for c in P}).drop("o")
    sizes = around(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))).groupBy(*keys).agg(F.sum("m").alias("m"))
    plan = staged(a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(sizes, keys), "field")
    b = around(placed)

    light = plan.filter(F.col("n") * F.col("m") < DENSE).select(*keys)
    few = a.join(light, keys).select(*keys, key, F.struct(*P).alias("a")).join(b.select(*keys, F.struct(*P, "h", *weights).alias("b")), keys).withColumn("d", distance("a", "b")).filter(F.col("d") < F.col("b.h"))
    r, h = F.col("d"), F.col("b.h")
    u = r / h
    pull = sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * F.col(f"b.alpha_g{c}") for c in P), F.lit(0.0))
    term = wendland(u) * F.col("b.alpha_v") - F.when(r > 1e-9, wendland_slope(u) / h / r).otherwise(0.0) * pull
    sums = few.select(key, term.alias("field"))

    dense = plan.filter(F.col("n") * F.col("m") >= DENSE).select(*keys, F.ceil(F.col("n") / BLOCK).alias("n"), F.ceil(F.col("m") / REACH).alias("m"))
    blocks = dense.agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    if blocks:
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = a.join(dense, keys).select(*keys, key, *P, F.pmod(F.xxhash64(key), "n").alias("i"), every("m").alias("j"))
        right = b.join(dense, keys).select(*keys, *P, "h", *weights, F.pmod(F.xxhash64(*P, "h", *weights), "m").alias("j"), every("n").alias("i"))

        def run(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            own, near = (df[np.isfinite(df[list(P)].to_numpy(float)).all(axis=1)] for df in (own, near))
            if not len(own) or not len(near):
                return pd.DataFrame({key: own[key].head(0), "field": []})
            total, met = _field_block(own[list(P)].to_numpy(float), near[list(P)].to_numpy(float), near["h"].to_numpy(float), near[weights].to_numpy(float))
            return pd.DataFrame({key: own[key].to_numpy(), "field": total})[met > 0]

        block, tasks = [*keys, "i", "j"], min(int(blocks), TASKS)  # by number, since a block's work exceeds its bytes by far
        dealt = [df.repartition(tasks, *block).groupBy(*block) for df in (left, right)]
        sums = sums.unionByName(dealt[0].cogroup(dealt[1]).applyInPandas(run, f"{key} {dict(points.dtypes)[key]}, field double"))
    sums = sums.groupBy(key).agg(F.sum("field").alias("field"))
    return points.join(sums, key, "left").withColumn("field", F.coalesce("field", F.lit(default)))


def box_neighbours(boxes: DataFrame, margin: float, key: str = "shell_id") -> DataFrame:
    """Pairs i < j of boxes whose centres are nearer than their largest half-extents and the margin together.

    Boxes are one map's shells; the larger ones set the cell width, so this is the same grid join.
    """
    reach = F.greatest("e0", "e1", "e2")
    sized = boxes.select(F.col(key), *[F.col(f"c{c}").alias(c) for c in P], reach.alias("reach"))
    widest = sized.agg(F.max("reach")).first()[0] or 0.0
    met = radius_join(sized, sized, 2 * widest + margin)
    near = met.filter((F.col(f"a.{key}") < F.col(f"b.{key}")) & (F.col("d") < F.col("a.reach") + F.col("b.reach") + margin))
    return near.select(F.col(f"a.{key}").alias("i"), F.col(f"b.{key}").alias("j"), "d")
