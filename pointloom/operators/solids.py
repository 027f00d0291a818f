"""Convex hulls, corner tests and the cascade that keeps body-like clusters."""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.config import DEFAULT, Config
from pointloom.functions import geometry as g
from pointloom.operators import features as A
from pointloom.operators.cluster import ransac_planes
from pointloom.operators.stage import staged

P = ["x", "y", "z"]
PART = 20_000  # points that one task hulls
FLAT_VOLUME = 0.02  # stands for the volume of clusters that span no solid
_NONE = np.zeros(0, np.int64)


def _hull(points: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray] | None:
    """Faces of the convex hull of different points, and a point inside; None where they span no solid.

    Every face keeps the points outside of it. The farthest of them is added next: the faces that see it, found from face to face, are replaced
    by a fan over their horizon, which takes over their points. So each step costs what it changes, though all points may be corners.
    """
    if len(points) < 4:
        return None
    scale = np.ptp(points, axis=0).max()
    eps = 1e-10 * max(scale, 1e-300)
    a = points[:, 0].argmin()
    b = ((points - points[a]) ** 2).sum(axis=1).argmax()
    ab = points[b] - points[a]
    off_line = np.linalg.norm(np.cross(points - points[a], ab), axis=1)
    c = off_line.argmax()
    if off_line[c] <= eps * scale:
        return None
    n = np.cross(ab, points[c] - points[a])
    off_plane = (points - points[a]) @ n
    d = np.abs(off_plane).argmax()
    if abs(off_plane[d]) <= eps * np.linalg.norm(n):
        return None
    inside = points[[a, b, c, d]].mean(axis=0)
    xyz = points.tolist()
    corners: list[tuple[int, int, int] | None] = []
    planes: list[tuple[float, float, float, float]] = []  # unit normal and offset; no plane for faces without area, which nothing sees
    outside: list[np.ndarray] = []
    beside: dict[tuple[int, int], int] = {}  # the face on whose border an edge runs

    def add(i: int, j: int, k: int) -> int:
        (x, y, z), u, v = xyz[i], xyz[j], xyz[k]
        ux, uy, uz, vx, vy, vz = u[0] - x, u[1] - y, u[2] - z, v[0] - x, v[1] - y, v[2] - z
        nx, ny, nz = uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx
        length = sqrt(nx * nx + ny * ny + nz * nz)
        if length:
            nx, ny, nz = nx / length, ny / length, nz / length
        beside[i, j] = beside[j, k] = beside[k, i] = len(corners)
        corners.append((i, j, k))
        planes.append((nx, ny, nz, nx * x + ny * y + nz * z))
        outside.append(_NONE)
        return len(corners) - 1

    def deal(rows: np.ndarray, new: list[int]) -> None:
        """Each of the rows goes to the new face that it is farthest outside of, or inside all."""
        where = np.array([planes[f] for f in new])
        height = points[rows] @ where[:, :3].T - where[:, 3]
        best = height.argmax(axis=1)
        out = height[np.arange(len(rows)), best] > eps
        for k in np.unique(best[out]).tolist():
            outside[new[k]] = rows[out & (best == k)]
            todo.append(new[k])

    todo: list[int] = []
    first = []
    for i, j, k in ((a, b, c), (a, b, d), (a, c, d), (b, c, d)):
        turned = np.cross(points[j] - points[i], points[k] - points[i]) @ (inside - points[i]) > 0
        first.append(add(*map(int, (j, i, k) if turned else (i, j, k))))
    deal(np.setdiff1d(np.arange(len(points)), [a, b, c, d]), first)
    while todo:
        f = todo.pop()
        if corners[f] is None:
            continue
        rows, (nx, ny, nz, offset) = outside[f], planes[f]
        p = int(rows[(points[rows] @ np.array((nx, ny, nz))).argmax()])
        px, py, pz = xyz[p]
        seen, stack, horizon = {f}, [f], []
        while stack:
            i, j, k = corners[stack.pop()]
            for e in ((i, j), (j, k), (k, i)):
                g = beside.get((e[1], e[0]))
                if g in seen:
                    continue
                if g is not None and planes[g][0] * px + planes[g][1] * py + planes[g][2] * pz - planes[g][3] > eps:
                    seen.add(g)
                    stack.append(g)
                else:
                    horizon.append(e)
        horizon = [e for e in horizon if beside.get((e[1], e[0])) not in seen]
        rows = np.concatenate([outside[g] for g in seen])
        rows = rows[rows != p]
        for g in seen:
            i, j, k = corners[g]
            corners[g], outside[g] = None, _NONE
            for e in ((i, j), (j, k), (k, i)):
                if beside.get(e) == g:
                    del beside[e]
        new = [add(i, j, p) for i, j in horizon]
        if len(rows):
            deal(rows, new)
    return [c for c in corners if c is not None], inside


def hull_volume(points: np.ndarray) -> float | None:
    """Volume of the convex hull of an (n, 3) array; None where it spans no solid."""
    points = np.unique(np.asarray(points, float), axis=0)
    found = _hull(points)
    if found is None:
        return None
    faces, inside = found
    return float(sum(abs((points[i] - inside) @ np.cross(points[j] - inside, points[k] - inside)) for i, j, k in faces) / 6)


def hull_vertices(points: np.ndarray) -> np.ndarray:
    """The corners of the hull; all different points where they span no solid."""
    points = np.unique(np.asarray(points, float), axis=0)
    found = _hull(points)
    return points if found is None else points[sorted({i for face in found[0] for i in face})]


def hull_volumes(points: DataFrame, by: Sequence[str], part: int = PART) -> DataFrame:
    """Hull volume per cluster; FLAT_VOLUME where there is none.

    A hull of hulls' corners is the hull of all: where a cluster holds more than `part` points, it is cut into parts of about so many, each
    reduced to its corners in a task of its own, again and again while that makes it smaller.
    """
    keys = list(by)
    types = dict(points.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        volume = hull_volume(pdf[P].to_numpy(float))
        return pdf[keys].head(1).assign(volume=FLAT_VOLUME if volume is None else volume, solid=volume is not None)

    def corners_of(pdf: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(hull_vertices(pdf[P].to_numpy(float)), columns=P)
        return found.assign(**{k: pdf[k].iloc[0] for k in keys})[keys + P]

    left, total = points.select(*keys, *[F.col(c).cast("double").alias(c) for c in P]), None
    while True:
        sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
        most, now = sizes.agg(F.max("size"), F.sum("size")).first()
        if (most or 0) <= part or (total is not None and now >= total):
            break
        total = now
        same = F.struct(*keys).eqNullSafe(F.struct(*[f"_{k}" for k in keys]))
        dealt = left.join(sizes.withColumnsRenamed({k: f"_{k}" for k in keys}), same).withColumn("part", F.pmod(F.xxhash64(*P), F.ceil(F.col("size") / part)))
        left = staged(dealt.select(*keys, *P, "part").groupBy(*keys, "part").applyInPandas(corners_of, f"{schema}, x double, y double, z double"), "hulls")
    return left.groupBy(*keys).applyInPandas(run, f"{schema}, volume double, solid boolean")


def corners(points: DataFrame, by: Sequence[str], config: Config = DEFAULT, threshold: float = 0.04, rounds: int = 30, seed: int = 7, key: str = "point_id") -> DataFrame:
    """two_plane_share and corner per cluster: the share of points on the best plane and the best one through the rest, and whether these meet like walls.

    Clusters under 20 points, or without a plane of six, have share 0; fewer than six points beside the first plane make no second one.
    """
    keys = list(by)
    offset = lambda n: F.abs(g.plane_offset([F.col(f"{n}x"), F.col(f"{n}y"), F.col(f"{n}z")], F.col(f"{n}d"), [F.col(c) for c in P]))
    named = lambda df, n: df.select(*keys, *[F.col(f"n{c}").alias(f"{n}{c}") for c in P], F.col("d").alias(f"{n}d"), F.col("inliers").alias(f"{n}n"))
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    large = points.select(*keys, key, *P).join(sizes.filter("n >= 20"), keys, "left_semi")
    first = staged(named(ransac_planes(large, keys, threshold, rounds, key, seed).filter("inliers >= 6"), "f"), "corners")
    rest = staged(large.join(first, keys).filter(offset("f") >= threshold).select(*keys, key, *P), "corners")
    enough = rest.groupBy(*keys).count().filter("count >= 6")
    second = named(ransac_planes(rest.join(enough, keys, "left_semi"), keys, threshold, rounds, key, seed + 1), "s")
    found = sizes.join(first, keys, "left").join(second, keys, "left")
    share = (F.coalesce("fn", F.lit(0)) + F.coalesce("sn", F.lit(0))) / F.col("n")
    angle = F.degrees(F.acos(F.least(F.abs(g.dot([F.col(f"f{c}") for c in P], [F.col(f"s{c}") for c in P])), F.lit(1.0))))
    corner = (share >= config.dihedral_share) & angle.between(config.dihedral_low_deg, config.dihedral_high_deg)
    return found.select(*keys, share.alias("two_plane_share"), F.coalesce(corner, F.lit(False)).alias("corner"))


def cascade(points: DataFrame, by: Sequence[str], config: Config = DEFAULT, extent_mean: Sequence[float] = (0.38, 0.38, 0.42), extent_sigma: Sequence[float] = (0.15, 0.15, 0.18), least_likelihood: float = -15.0) -> DataFrame:
    """Features of each cluster of at least min_cluster points and `passes`: solid enough, no corner, voluminous, of a body's extents."""
    keys = list(by)
    large = A.at_least(points, keys, config.min_cluster)
    centre = A.centroid(large, keys).withColumn("r2", F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz"))
    table = centre.join(hull_volumes(large, keys), keys).join(corners(large, keys, config), keys).join(A.volumetricity(large, keys), keys).join(A.extents(large, keys), keys).join(A.circle_fit(large, keys), keys)
    least_volume, least_solidity = A.adaptive_bounds(F.col("n"), F.col("r2"), config)
    most = config.kappa_volume * float(np.prod(config.body_extents))
    solidity = F.when(F.col("solid"), F.col("n") / F.greatest("volume", F.lit(1e-5))).otherwise(30.0)
    hull = (F.col("volume") >= least_volume) & (F.col("volume") <= most) & (solidity >= least_solidity)
    arc = F.col("radius").between(config.circle_low, config.circle_high) & (F.col("rms") <= config.circle_rms)
    hull = hull | (F.lit(config.arc_rescue) & arc)
    likelihood = A.extent_likelihood(F.col("sx"), F.col("sy"), F.col("sz"), extent_mean, extent_sigma)
    out = table.withColumns({"solidity": solidity, "log_likelihood": likelihood, "hull_ok": hull, "arc_ok": arc})
    passes = F.col("hull_ok") & ~F.col("corner") & (F.col("volumetricity") >= config.volumetricity_min) & (F.col("log_likelihood") > least_likelihood)
    return out.withColumn("passes", passes).select(*keys, "n", "volume", "solidity", "two_plane_share", "corner", "volumetricity", "log_likelihood", "arc_ok", "hull_ok", "passes")
