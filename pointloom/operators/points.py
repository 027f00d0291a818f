"""Row-wise operators on point rows (frame_id, point_id, x, y, z, intensity)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions import geometry as g
from pointloom.operators.map_cells import Reach, box_reach, join_map

#: Semantic labels, fixed values.
GROUND, STRUCTURE, CANDIDATE, TARGET, UNKNOWN = 0, 1, 2, 3, -1
P = ("x", "y", "z")


def _p() -> list[Column]:
    return [F.col(c) for c in P]


def drop_nonfinite(points: DataFrame) -> DataFrame:
    """Rows whose x, y and z are finite; intensity is not checked."""
    return points.filter(g.finite(*P))


def drop_empty_frames(frames: DataFrame) -> DataFrame:
    """Frames with at least one point."""
    return frames.filter(F.size("points") > 0)


def explode_frames(frames: DataFrame) -> DataFrame:
    """frames(frame_id, ts, points array) as point rows with an explicit point_id."""
    rows = frames.select("frame_id", "ts", F.posexplode("points").alias("point_id", "p"))
    return rows.select("frame_id", "ts", "point_id", "p.x", "p.y", "p.z", "p.intensity")


def outside_blind_spot(points: DataFrame, radius: float) -> DataFrame:
    """Points at least `radius` from the sensor's axis."""
    return points.filter(g.range_xy() >= radius)


def align(points: DataFrame, rotation: Sequence[Sequence[float]]) -> DataFrame:
    """Points turned by a rotation matrix (rows)."""
    moved = g.rotate(rotation, _p())
    return points.withColumns(dict(zip(P, moved, strict=True)))


def fill_intensity(points: DataFrame, default: float = 100.0) -> DataFrame:
    """Missing intensities by a default."""
    return points.withColumn("intensity", F.coalesce("intensity", F.lit(default)))


def ground_band(points: DataFrame, z0: float, delta: float) -> DataFrame:
    """Points with |z - z0| <= 1.5 delta."""
    return points.filter(F.abs(F.col("z") - z0) <= 1.5 * delta)


def recentre(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Points minus their centroid, over all rows or per group; the one-row or grouped means are joined back."""
    means = points.groupBy(*by).agg(*[F.avg(c).alias(f"m{c}") for c in P])
    joined = points.join(means, list(by)) if by else points.crossJoin(F.broadcast(means))
    return joined.withColumns({c: F.col(c) - F.col(f"m{c}") for c in P}).drop(*[f"m{c}" for c in P])


def wall_condition(p: Sequence[Column], delta: float) -> Column:
    """Whether p lies within delta of a row of `walls`, inside its bounds where it has any."""
    n = [F.col("nx"), F.col("ny"), F.col("nz")]
    at = g.sub(p, [F.col("cx"), F.col("cy"), F.col("cz")])
    u = F.abs(g.dot([F.col("ux"), F.col("uy"), F.col("uz")], at))
    v = F.abs(g.dot([F.col("vx"), F.col("vy"), F.col("vz")], at))
    bounded = F.col("half_width").isNull() | ((u <= F.col("half_width")) & (v <= F.col("half_height")))
    return (F.abs(g.plane_offset(n, F.col("d"), p)) <= delta) & bounded


def shell_condition(p: Sequence[Column], margin: float, thin_margin: float) -> Column:
    """Whether p lies inside a row of `shells` stretched by the margins."""
    axes = [[F.col(f"a{i}{c}") for c in P] for i in range(3)]
    return g.in_box(p, [F.col(f"c{c}") for c in P], axes, [F.col(f"e{i}") for i in range(3)], margin, thin_margin)


def _wall_reach(delta: float) -> Reach:
    """A slab; where a wall has bounds, its axes u, v and normal are taken to be at right angles and of length 1."""
    n, u, v, c = ([F.col(f"{a}{k}") for k in P] for a in "nuvc")
    off = g.plane_offset(n, F.col("d"), c)
    foot = [ck - off * nk for ck, nk in zip(c, n, strict=True)]
    box = box_reach(foot, [n, u, v], [F.lit(delta), F.col("half_width"), F.col("half_height")])
    # The centre may lie beside its plane; moving it there along the normal leaves both bounds as they are.
    return Reach(box.low, box.high, n, F.col("d"), F.lit(delta))


def _shell_reach(margin: float, thin_margin: float) -> Reach:
    widest = max(margin, thin_margin)
    return box_reach([F.col(f"c{c}") for c in P], [[F.col(f"a{i}{c}") for c in P] for i in range(3)], [F.col(f"e{i}") + widest for i in range(3)])


def on_walls(points: DataFrame, walls: DataFrame, delta: float, how: str = "left_semi") -> DataFrame:
    """Points on (left_semi) or off (left_anti) any wall."""
    return join_map(points, walls, wall_condition(_p(), delta), _wall_reach(delta), how)


def in_shells(points: DataFrame, shells: DataFrame, margin: float = 0.15, thin_margin: float = 0.04, how: str = "left_semi") -> DataFrame:
    """Points in (left_semi) or outside (left_anti) all stretched shells."""
    return join_map(points, shells, shell_condition(_p(), margin, thin_margin), _shell_reach(margin, thin_margin), how)


def near_wall_share(points: DataFrame, shells: DataFrame, by: Sequence[str], margin: float, thin_margin: float) -> DataFrame:
    """Per group: how many (point, shell) hits there are for each point; a point in two shells counts twice."""
    hits = join_map(points, shells, shell_condition(_p(), margin, thin_margin), _shell_reach(margin, thin_margin), "left_outer")
    counts = hits.groupBy(*by).agg(F.count("shell_id").alias("hits"), F.countDistinct("point_id").alias("n"))
    return counts.withColumn("share", F.col("hits") / F.col("n"))


def semantic_label(blind: Column, ground: Column, structure: Column) -> Column:
    """The label by precedence: blind spot, ground, structure, else target residue."""
    return F.when(blind, UNKNOWN).when(ground, GROUND).when(structure, STRUCTURE).otherwise(TARGET)


def default_label(points: DataFrame, names: DataFrame, key: str, default: int) -> DataFrame:
    """Labels looked up by key; a key without an entry gets the default."""
    return points.join(names, key, "left").withColumn("label", F.coalesce("label", F.lit(default)))


def height_gate(points: DataFrame, by: Sequence[str], z0: float, highest: float, label: int = STRUCTURE) -> DataFrame:
    """Relabel every point of groups whose mean height over z0 exceeds `highest`."""
    means = points.groupBy(*by).agg(F.avg("z").alias("mean_z"))
    return points.join(means, list(by)).withColumn("label", F.when(F.col("mean_z") - z0 > highest, label).otherwise(F.col("label"))).drop("mean_z")


def heat_colour(value: Column, scale: float) -> list[Column]:
    """Red, green and blue of a residual: green at 0, red from `scale` on."""
    e = F.least(F.abs(value) / scale, F.lit(1.0))
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    return [clip(2 * e), clip(2 * (1 - e)), F.lit(0.0)]


def box_corners(boxes: DataFrame) -> DataFrame:
    """The eight corners of each shell as rows (shell_id, corner, x, y, z)."""
    signs = F.explode(F.expr("transform(sequence(0, 7), k -> struct(k AS corner, 1 - 2 * (k & 1) AS s0, 1 - (k & 2) AS s1, 1 - div(k & 4, 2) AS s2))".replace("div(k & 4, 2)", "cast((k & 4) / 2 AS int)"))).alias("k")
    rows = boxes.select("*", signs)
    at = {c: F.col(f"c{c}") + sum((F.col(f"a{i}{c}") * F.col(f"e{i}") * F.col(f"k.s{i}") for i in range(3)), F.lit(0.0)) for c in P}
    return rows.select("shell_id", "k.corner", *[v.alias(c) for c, v in at.items()])


def regular_grid(bounds: DataFrame, step: float, pad: float) -> DataFrame:
    """Grid nodes (ix, iy, iz, x, y, z) over one row of bounds (lox, hix, ...), padded; meant for one object's box."""
    out = bounds
    for c in P:
        n = F.floor((F.col(f"hi{c}") - F.col(f"lo{c}") + 2 * pad) / step).cast("int")
        out = out.withColumn(f"i{c}", F.explode(F.sequence(F.lit(0), n)))
    return out.select(*[f"i{c}" for c in P], *[(F.col(f"lo{c}") - pad + F.col(f"i{c}") * step).alias(c) for c in P])
