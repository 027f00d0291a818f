"""Background shells: agglomeration of points, splitting of hollow boxes, merging of fragments."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointloom.operators.graph import connected_components
from pointloom.operators.neighbours import nearest
from pointloom.operators.spatial import knn_within
from pointloom.operators.stage import staged

P = ["x", "y", "z"]
SMALL = 1024  # points of which all distances are quicker than cell lists


class _Groups:
    """Disjoint sets with additive moments.

    A point's covariance is START of the identity; a merge takes the mean of both parts' by size, and adds GROWTH of it.
    """

    START, GROWTH, LEAST = 1e-6, 1e-8, 1e-12  # LEAST: of a determinant

    def __init__(self, points: np.ndarray):
        self.parent = list(range(len(points)))
        self.n = np.ones(len(points))
        self.s = points.copy()
        self.q = points[:, :, None] * points[:, None, :]
        self.ridge = np.full(len(points), self.START)
        self.v = np.full(len(points), max(self.START**3, self.LEAST) ** 0.5)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def merged(self, i: int, j: int) -> tuple[float, float]:
        """Ridge and volume of two groups as one."""
        n = self.n[i] + self.n[j]
        ridge = (self.n[i] * self.ridge[i] + self.n[j] * self.ridge[j]) / n + self.GROWTH
        m = (self.s[i] + self.s[j]) / n
        c = (self.q[i] + self.q[j]) / n - np.outer(m, m) + ridge * np.eye(3)
        return ridge, max(float(np.linalg.det(c)), self.LEAST) ** 0.5

    def cost(self, i: int, j: int) -> float:
        return float(self.merged(i, j)[1] - self.v[i] - self.v[j])

    def join(self, i: int, j: int) -> int:
        i, j = min(i, j), max(i, j)
        self.ridge[i], self.v[i] = self.merged(i, j)
        self.parent[j] = i
        self.n[i] += self.n[j]
        self.s[i] += self.s[j]
        self.q[i] += self.q[j]
        return i


def neighbour_edges(points: np.ndarray, k: int, radius: float) -> list[tuple[int, int]]:
    """Pairs i < j with j among i's k nearest (i counts) and nearer than radius."""
    near, d = nearest(points, k, radius)
    i, rank = np.nonzero((near > np.arange(len(points))[:, None]) & (d < radius))
    return list(zip(i.tolist(), near[i, rank].tolist(), strict=True))


Merge = tuple[float, int, int]  # cost, and the first points of the two groups


def merges(points: np.ndarray, edges: list[tuple[int, int]]) -> Iterator[Merge]:
    """The merges of neighbouring groups by least growth of volume, ties by their first points, until no edges are left."""
    groups = _Groups(np.asarray(points, float))
    near: dict[int, set[int]] = {}
    for i, j in edges:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    heap = [(groups.cost(i, j), i, j, 0, 0) for i, j in edges]
    heapq.heapify(heap)
    version = [0] * len(points)
    while heap:
        cost, i, j, vi, vj = heapq.heappop(heap)
        if groups.parent[i] != i or groups.parent[j] != j or version[i] != vi or version[j] != vj:
            continue  # one side has grown since
        r = groups.join(i, j)
        version[r] += 1
        yield cost, i, j
        near[r] = {groups.root(x) for x in near.pop(i) | near.pop(j)} - {r}
        for x in near[r]:
            near[x] = {groups.root(y) for y in near[x]} - {x}
            heapq.heappush(heap, (groups.cost(min(r, x), max(r, x)), min(r, x), max(r, x), version[min(r, x)], version[max(r, x)]))


def agglomerate(points: np.ndarray, k: int = 12, radius: float = 0.10, components: int = 30) -> np.ndarray:
    """Group of each point, named by its first: neighbours merge until `components` groups or no edges are left."""
    parent = np.arange(len(points))
    for _, i, j in islice(merges(points, neighbour_edges(np.asarray(points, float), k, radius)), max(0, len(points) - components)):
        parent[parent == j] = i
    return parent


_MERGES = "{by} long, part long, seq long, high double, hi long, hj long, i long, j long"


def agglomerate_frames(points: DataFrame, by: str = "frame_id", key: str = "point_id", k: int = 12, radius: float = 0.10, components: int = 30) -> DataFrame:
    """point -> group, named by its first point, as `agglomerate` gives it for each frame; `key` tells points of all frames apart.

    Neighbours are found by a grid join and cut into connected parts, which cannot merge with each other: each part is
    merged in a task of its own, down to nothing. Taken together, a frame's merges come in the order of the dearest merge that
    each had to wait for in its part. The last of them, as many as the frame has groups to spare, are undone; what the others connect are the groups.
    """
    rows = staged(points.select(by, key, *P), "agglomerate")
    edges = staged(knn_within(rows, k, radius, [by], key).filter((F.col("i") < F.col("j")) & (F.col("d") < radius)).select(by, "i", "j"), "agglomerate")
    parts = staged(connected_components(edges, "i", "j").toDF(key, "part"), "agglomerate")

    def run(cloud: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        cloud = cloud.sort_values(key)
        ids = cloud[key].to_numpy()
        ends = zip(np.searchsorted(ids, links["i"]).tolist(), np.searchsorted(ids, links["j"]).tolist(), strict=True)
        out, high = [], (-np.inf, -1, -1)
        for seq, (cost, i, j) in enumerate(merges(cloud[P].to_numpy(float), sorted(ends))):
            high = max(high, (cost, int(ids[i]), int(ids[j])))
            out.append((cloud[by].iloc[0], cloud["part"].iloc[0], seq, *high, ids[i], ids[j]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _MERGES.format(by=by).split(", ")])

    clouds, links = rows.join(parts, key), edges.join(parts.toDF("i", "owner"), "i").select(by, "owner", "i", "j")
    found = staged(clouds.groupBy("part").cogroup(links.groupBy("owner")).applyInPandas(run, _MERGES.format(by=by)), "agglomerate")
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("points"))
    spare = found.groupBy(by).agg(F.count(F.lit(1)).alias("merges")).join(counts, by).select(by, (F.col("merges") - F.greatest(F.col("points") - components, F.lit(0))).alias("spare"))
    # Merges leave a group each, so no more than `components` are to be undone.
    last = W.partitionBy(by).orderBy(*[F.col(c).desc() for c in ("high", "hi", "hj", "seq")])
    undone = found.withColumn("back", F.row_number().over(last)).filter(F.col("back") <= components).join(spare, by).filter("back <= spare")
    cut = undone.groupBy("part").agg(F.min("seq").alias("cut"))
    kept = found.join(cut, "part", "left").filter("cut IS NULL OR seq < cut").select("i", "j")
    groups = connected_components(kept, "i", "j").toDF(key, "cluster")
    return rows.select(by, key).join(groups, key, "left").select(by, key, F.coalesce("cluster", key).alias("cluster"))


@dataclass
class Box:
    """An upright box and the points it was fitted to."""

    points: np.ndarray
    center: np.ndarray
    axes: np.ndarray  # columns
    extents: np.ndarray
    solidity: float

    @property
    def height(self) -> float:
        return float(2 * self.extents[2])


def upright_box(points: np.ndarray, voxel: float) -> Box | None:
    """The box along the principal axes of the plane; None under ten points."""
    if len(points) < 10:
        return None
    m = points[:, :2].mean(axis=0)
    c = np.cov(points[:, :2].T)
    yaw = 0.5 * np.arctan2(2 * c[0, 1], c[0, 0] - c[1, 1])
    axes = np.array([[np.cos(yaw), -np.sin(yaw), 0], [np.sin(yaw), np.cos(yaw), 0], [0, 0, 1.0]])
    origin = np.array([m[0], m[1], 0.0])
    local = (points - origin) @ axes
    low, high = local.min(axis=0), local.max(axis=0)
    extents = (high - low) / 2
    return Box(points, origin + axes @ ((low + high) / 2), axes, extents, float(len(points) * voxel**3 / (8 * extents.prod() + 1e-8)))


def without_outliers(points: np.ndarray, k: int = 20, deviations: float = 1.0) -> np.ndarray:
    """Points whose mean distance to their k nearest is not far above the mean."""
    if len(points) <= k:
        return points
    if len(points) <= SMALL:
        d = sum((points[:, None, c] - points[None, :, c]) ** 2 for c in range(3))
        mean = np.sqrt(np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1)).mean(axis=1)
    else:
        mean = nearest(points, k)[1].mean(axis=1)
    return points[mean <= mean.mean() + deviations * mean.std(ddof=1)]


def split_boxes(points: np.ndarray, voxel: float = 0.04, solidity: float = 0.35, min_points: int = 50, min_height: float = 0.15) -> list[Box]:
    """Boxes of a cluster; hollow ones are split at the median of their longest axis, low ones are dropped."""
    todo, out = [points], []
    while todo:
        part = without_outliers(todo.pop())
        box = upright_box(part, voxel) if len(part) >= min_points else None
        if box is None or box.height < min_height:
            continue
        if box.solidity < solidity and len(part) > 2 * min_points:
            along = ((part - box.center) @ box.axes)[:, int(box.extents.argmax())]
            upper = along > np.median(along)
            if min(upper.sum(), (~upper).sum()) >= min_points:
                todo += [part[upper], part[~upper]]
                continue
        out.append(box)
    return out


def _near_pairs(boxes: list[Box], margin: float) -> list[tuple[int, int]]:
    """Pairs i < j, in order, of boxes whose centres are nearer than their largest half-extents and the margin together."""
    centers, reach = np.array([b.center for b in boxes]), np.array([b.extents.max() for b in boxes])
    apart = np.linalg.norm(centers[:, None] - centers[None], axis=2)
    return [(int(i), int(j)) for i, j in np.argwhere(np.triu(apart < reach[:, None] + reach[None] + margin, 1))]


def merge_boxes(boxes: list[Box], voxel: float = 0.04, solidity: float = 0.35, margin: float = 0.10) -> list[Box]:
    """Boxes joined pair by pair, each at most once a round and with the first near one that leaves a solid box, until a round joins none."""
    boxes = list(boxes)
    while len(boxes) > 1:
        kept = np.ones(len(boxes), bool)
        joined = np.zeros(len(boxes), bool)
        for i, j in _near_pairs(boxes, margin):
            if kept[i] and kept[j] and not joined[i]:
                both = upright_box(np.vstack([boxes[i].points, boxes[j].points]), voxel)
                if both is not None and both.solidity >= solidity:
                    boxes[i], kept[j], joined[i] = both, False, True
        if not joined.any():
            break
        boxes = [b for b, k in zip(boxes, kept, strict=True) if k]
    return boxes


_SHELL = "cx double, cy double, cz double, yaw double, e0 double, e1 double, e2 double, solidity double, height double, points long"


def _rows(boxes: list[Box]) -> pd.DataFrame:
    order = sorted(boxes, key=lambda b: tuple(b.center))
    return pd.DataFrame([(*b.center, float(np.arctan2(b.axes[1, 0], b.axes[0, 0])), *b.extents, b.solidity, b.height, len(b.points)) for b in order], columns=[c.split()[0] for c in _SHELL.split(", ")])


def shell_table(points: DataFrame, by: str = "frame_id", cluster: str = "cluster", merge: bool = True, voxel: float = 0.04, solidity: float = 0.35, min_points: int = 50, min_height: float = 0.15) -> DataFrame:
    """Shells of each frame's clusters, split and (if asked) merged over the frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([cluster, *P])
        boxes = [b for _, g in pdf.groupby(cluster) for b in split_boxes(g[P].to_numpy(float), voxel, solidity, min_points, min_height)]
        out = _rows(merge_boxes(boxes, voxel, solidity) if merge else boxes)
        out.insert(0, by, pdf[by].iloc[0])
        out.insert(1, "shell_id", range(len(out)))
        return out

    return points.select(by, cluster, *P).groupBy(by).applyInPandas(run, f"{by} long, shell_id long, {_SHELL}")
