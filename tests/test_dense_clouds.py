"""Operators on clouds that lie densely within the radius asked for: the work must not be that of all pairs."""

from __future__ import annotations

import time

import numpy as np

from pyspark.sql import functions as F

from pointloom.operators import cluster as C
from pointloom.operators import spatial as S


def _table(spark, folder, points, frames=None):
    frames = [1] * len(points) if frames is None else frames
    rows = [(int(f), i, *map(float, p)) for i, (f, p) in enumerate(zip(frames, points, strict=True))]
    spark.createDataFrame(rows, "frame_id long, point_id long, x double, y double, z double").write.parquet(f"{folder}/points")
    return spark.read.parquet(f"{folder}/points")


def test_nearest_in_a_radius_that_holds_all(spark, tmp_path):
    """40,000 points, 3,000 of them copies: 1.6 thousand million pairs lie within the radius."""
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(36_900, 3)) * 0.01, np.zeros((3_000, 3)), rng.normal(size=(100, 3)) * 3])
    begin = time.perf_counter()
    found = S.knn_within(_table(spark, tmp_path, x), 5, 0.4).select("i", "rank", "j").toPandas()
    assert time.perf_counter() - begin < 120
    got = {i: g.sort_values("rank")["j"].tolist() for i, g in found.groupby("i")}
    for i in (*range(0, 36_900, 1_999), 36_900, 39_899, *range(39_900, 40_000, 9)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = np.lexsort((np.arange(len(x)), d))[:5]
        assert got[i] == order[d[order] <= 0.4].tolist()


def test_large_frames_are_clustered_without_all_pairs(spark, tmp_path):
    """Two dense balls that meet only by their rims, a bridge, copies, and lone points, against the clusters of one task."""
    rng = np.random.default_rng(2)
    ball = rng.normal(size=(700, 3))
    ball *= (0.3 * rng.random(700) ** (1 / 3) / np.linalg.norm(ball, axis=1))[:, None]
    x = np.vstack([ball, ball + [0.66, 0, 0], rng.uniform(-2, 2, (150, 3)), np.tile([[1.7, 1.7, 1.7]], (9, 1)), np.column_stack([np.arange(1, 2, 0.07), np.zeros(15), np.zeros(15)])])
    frames = np.where(np.arange(len(x)) % 5 == 4, 2, 1)
    points = _table(spark, tmp_path, x, frames)
    want = {}
    for f in (1, 2):
        ids = np.flatnonzero(frames == f)
        want |= dict(zip(ids.tolist(), C._dbscan_frame(x[ids], ids, 0.1, 6).tolist(), strict=True))
    found = C.dbscan_per_frame(points, 0.1, 6, frame=400)  # one frame in a task, one by cells
    assert {r.point_id: -1 if r.cluster is None else r.cluster for r in found.collect()} == want


def test_field_sums_pairs_in_blocks(spark, tmp_path):
    """A dense cell goes through blocks, lone points through the join, groups apart: both as the definition has it."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.random((2_000, 3)) * 0.1 + 0.01, rng.uniform(-1, 1, (60, 3))])
    frames = np.arange(len(x)) % 2
    points = _table(spark, tmp_path, x, frames)
    primitives = points.select("frame_id", *[F.col(c).alias(f"p{c}") for c in "xyz"], F.lit(0.12).alias("h"), (F.col("x") + 1).alias("alpha_v"), *[F.col(c).alias(f"alpha_g{c}") for c in "xyz"])
    S.DENSE, before = 10_000, S.DENSE
    try:
        found = S.field_value(points, primitives, by=["frame_id"])
        got = {r.point_id: r.field for r in found.collect()}
        assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        S.DENSE = before
    for i in (*range(0, 2_000, 97), *range(2_000, 2_060)):
        own = frames == frames[i]
        d = x[i] - x[own]
        r = np.linalg.norm(d, axis=1)
        v = np.maximum(1 - r / 0.12, 0)
        terms = v**4 * (5 - 4 * v) * (x[own, 0] + 1) + 20 * v**3 / 0.12**2 * (d * x[own]).sum(axis=1)
        assert np.isclose(got[i], terms[r < 0.12].sum(), rtol=1e-9)


def test_voxels_of_many_points_are_dealt_into_tasks_of_few(spark, monkeypatch):
    """The tasks follow the points, not the session's 4 shuffle partitions, with the same voxels (F20, F21)."""
    xyz = [((F.hash(F.lit(k), "id") % 1000) / 250).alias(c) for k, c in enumerate("xyz")]
    points = spark.range(6000).select((F.col("id") % 120).alias("frame_id"), F.col("id").alias("point_id"), *xyz, F.lit(1.0).alias("intensity"))
    for by in (["frame_id"], []):
        means = lambda: sorted((*r[: len(by) + 3], *(round(v, 9) for v in r[len(by) + 3 : -1]), r[-1]) for r in S.voxel_mean(points, 0.5, by).collect())  # noqa: E731, B023
        firsts = lambda: sorted((*r[: len(by) + 3], r.first_id) for r in S.voxel_first(points, 0.5, by).collect())  # noqa: E731, B023
        monkeypatch.setattr(S, "VOXEL_ROWS", 1 << 19, raising=False)
        want = means(), firsts()
        monkeypatch.setattr(S, "VOXEL_ROWS", 200)
        assert (means(), firsts()) == want
        per_task = S.voxel_key(points, 0.5, by).groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("*")).first()
        assert per_task[0] <= 800 and per_task[1] > 8
