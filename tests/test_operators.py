"""Operators against brute force, analytic shapes and edge cases."""

from __future__ import annotations

import itertools
from dataclasses import astuple

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.config import Config
from pointloom.functions import geometry as g
from pointloom.operators import cluster as C
from pointloom.operators import features as A
from pointloom.operators import points as P
from pointloom.operators import spatial as S
from pointloom.operators.graph import connected_components
from pointloom.operators.registration import gauss_newton, score
from pointloom.operators.shells import agglomerate, merge_boxes, split_boxes, upright_box
from pointloom.operators.solids import corners, hull_vertices, hull_volume, hull_volumes
from pointloom.operators.surface import build_surface, hermite_matrix
from pointloom.streaming.tracker import ACTIVE, COASTING, SEARCHING, Track, step

SCHEMA = "frame_id long, point_id long, x double, y double, z double, intensity double"


def _cloud(spark, xyz, frame=0):
    return spark.createDataFrame([(frame, i, *map(float, p), 1.0) for i, p in enumerate(xyz)], SCHEMA)


def test_radius_join_equals_brute_force(spark):
    xyz = np.random.default_rng(1).random((120, 3))
    got = {(r.i, r.j) for r in S.eps_pairs(_cloud(spark, xyz), 0.2).collect()}
    want = {(i, j) for i, j in itertools.permutations(range(120), 2) if np.linalg.norm(xyz[i] - xyz[j]) <= 0.2}
    assert got == want


def test_nearest_label_grows_its_radius(spark):
    xyz = np.array([[0, 0, 0], [5, 0, 0], [0.1, 0, 0]])
    cloud = _cloud(spark, xyz)
    reference = cloud.filter("point_id = 2").withColumn("label", F.lit(7))
    got = {r.point_id: r.label for r in S.nearest_label(cloud.filter("point_id < 2"), reference, 0.2, "label").collect()}
    assert got == {0: 7, 1: 7}
    far = _cloud(spark, np.array([[0, 0, 0], [1e5, 0, 0], [0.1, 0, 0], [float("nan"), 0, 0]]))
    got = {r.point_id: r.label for r in S.nearest_label(far.filter("point_id <> 2"), far.filter("point_id = 2").withColumn("label", F.lit(7)), 0.2, "label").collect()}
    assert got == {0: 7, 1: 7}
    assert S.nearest_label(cloud, reference.filter("false"), 0.2, "label").count() == 0


def test_dbscan_forms_agree_and_handle_edges(spark):
    rng = np.random.default_rng(2)
    xyz = np.vstack([rng.normal(0, 0.05, (40, 3)), rng.normal(1, 0.05, (40, 3)), [[9, 9, 9]], [[0, 0, 0]] * 3])
    cloud = _cloud(spark, xyz)
    a = {r.point_id: r.cluster for r in C.dbscan(cloud, 0.15, 5).collect()}
    b = {r.point_id: r.cluster for r in C.dbscan_per_frame(cloud, 0.15, 5).collect()}
    assert a == b and a[80] is None and a[0] == 0 and a[40] != 0
    assert C.dbscan(cloud.filter("false"), 0.15, 5).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 200), (None, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[100 + i] == 100 for i in range(20)) and got[200] == 200
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_a_very_long_path(spark):
    ids = np.random.default_rng(7).permutation(10_000).tolist()
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "src long, dst long")
    got = connected_components(edges).agg(F.count(F.lit(1)).alias("n"), F.max("component").alias("top")).first()
    assert (got.n, got.top) == (10_000, 0)


def test_alignment_turns_a_tilted_normal_up(spark):
    n = np.array([0.3, 0.0, 0.9539])
    n /= np.linalg.norm(n)
    for vector, up in ((n, [0, 0, 1]), (np.array([0, 0, 1.0]), [0, 0, 1])):
        m = g.align_to_up(list(map(float, vector)))
        row = spark.range(1).select(*[m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)]).first()
        assert np.allclose(np.array(row).reshape(3, 3) @ vector, up, atol=1e-5)


def test_nonfinite_rows_and_thresholds(spark):
    cloud = _cloud(spark, [[float("nan"), 0, 0], [float("inf"), 0, 0], [0.35, 0, 0], [0.3499, 0, 0]])
    kept = P.outside_blind_spot(P.drop_nonfinite(cloud), 0.35)
    assert [r.point_id for r in kept.collect()] == [2]


def test_hulls_of_parts_make_the_hull(spark):
    rng = np.random.default_rng(14)
    clouds = {"ball": rng.normal(size=(3000, 3)), "cube": rng.random((900, 3)), "flat": rng.random((500, 3)) * [1, 1, 0], None: rng.random((30, 3))}
    rows = [(k, *map(float, p)) for k, c in clouds.items() for p in c]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double").repartition(5)
    got = {r.k: r for r in hull_volumes(df, ["k"], part=100).collect()}
    whole = {r.k: r for r in hull_volumes(df, ["k"]).collect()}
    assert set(got) == set(clouds) == set(whole)
    for k in ("ball", "cube"):
        assert got[k].solid and got[k].volume == pytest.approx(hull_volume(clouds[k]), rel=1e-9) == pytest.approx(whole[k].volume, rel=1e-9)
    assert not got["flat"].solid and len(hull_vertices(clouds["cube"])) < 200


@pytest.mark.parametrize(("points", "volume"), [(np.array([*itertools.product((0, 1), (0, 2), (0, 3))]), 6.0), (np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]]), 1 / 6)])
def test_hull_of_solids(points, volume):
    inside = points.mean(axis=0) + 0.01 * np.random.default_rng(3).random((50, 3))
    assert hull_volume(np.vstack([points, inside, points])) == pytest.approx(volume)


def test_hull_of_flat_sets_is_none():
    rng = np.random.default_rng(4)
    flat = np.column_stack([rng.random((20, 2)), np.zeros(20)])
    assert hull_volume(flat) is None and hull_volume(flat[:3]) is None and hull_volume(np.outer(np.arange(9.0), [1, 1, 1])) is None


def test_corner_test_tells_corners_from_balls(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random((150, 3)) * [1, 0.01, 1], rng.random((150, 3)) * [0.01, 1, 1]
    ball = rng.normal(size=(300, 3))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    wall = rng.random((60, 3)) * [1, 0.001, 1]
    clouds = {0: np.vstack([a, b]), 1: ball, 2: ball[:5], 3: wall, 4: np.repeat(ball[:1], 30, axis=0)}
    rows = [(f, 1000 * f + i, *map(float, p)) for f, c in clouds.items() for i, p in enumerate(c)]
    found = {r.frame_id: r for r in corners(spark.createDataFrame(rows, "frame_id long, point_id long, x double, y double, z double"), ["frame_id"]).collect()}
    assert found[0].corner and found[0].two_plane_share > 0.95 and not found[1].corner
    assert (found[2].two_plane_share, found[2].corner) == (0.0, False)  # too few points
    assert (found[3].two_plane_share, found[3].corner) == (1.0, False)  # nothing beside the first plane
    assert (found[4].two_plane_share, found[4].corner) == (0.0, False)  # no triple spans a plane


def test_inliers_are_counted_for_groups_and_planes_alike(spark):
    rng = np.random.default_rng(12)
    points = spark.createDataFrame([(f, 100 * f + i, *map(float, p)) for f in range(3) for i, p in enumerate(rng.normal(size=(40, 3)))], "frame_id long, point_id long, x double, y double, z double")
    planes = C.triple_planes(points, C.hashed_triples(points, 9, by=["frame_id"]), by=["frame_id"])
    got = {(r.frame_id, r.hypothesis): r for r in C.count_inliers(points, planes, 0.4, ["frame_id"]).collect()}
    xyz = {f: np.array([[r.x, r.y, r.z] for r in points.collect() if r.frame_id == f]) for f in range(3)}
    assert len(got) == planes.count() and {f for f, _ in got} == {0, 1, 2}
    for (f, _), r in got.items():
        assert r.inliers == int((np.abs(xyz[f] @ [r.nx, r.ny, r.nz] + r.d) < 0.4).sum())


def test_eigenvalues_equal_numpy(spark):
    xyz = np.random.default_rng(6).normal(size=(200, 3)) * [1, 0.5, 0.1]
    low = np.linalg.eigvalsh(np.cov(xyz.T))
    row = A.volumetricity(_cloud(spark, xyz), ["frame_id"]).first()
    assert row.volumetricity == pytest.approx(low[0] / low.sum(), rel=1e-6)


def test_circle_fit_finds_circle_and_singular_case(spark):
    t = np.linspace(0, np.pi, 40)
    arc = _cloud(spark, np.column_stack([2 + 0.18 * np.cos(t), 1 + 0.18 * np.sin(t), 0 * t]))
    row = A.circle_fit(arc, ["frame_id"]).first()
    assert (row.cx, row.cy, row.radius) == pytest.approx((2, 1, 0.18), abs=1e-6) and row.rms < 1e-6
    line = A.circle_fit(_cloud(spark, np.column_stack([t, 0 * t, 0 * t])), ["frame_id"]).first()
    assert (line.cx, line.cy, line.radius, line.rms) == (0.0, 0.0, 0.0, 999.0)


def test_surface_meets_its_conditions_and_gradient():
    rng = np.random.default_rng(7)
    n = rng.normal(size=(800, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    s = build_surface(0.18 * n, n, 120)
    f, grad = s.evaluate(s.p)
    assert np.abs(f).max() < 5e-3 and np.abs(grad - s.n).max() < 0.1
    q = s.p[:10] + 0.01
    numeric = np.column_stack([(s.evaluate(q + 1e-6 * e)[0] - s.evaluate(q - 1e-6 * e)[0]) / 2e-6 for e in np.eye(3)])
    assert np.allclose(numeric, s.evaluate(q)[1], atol=1e-6)
    assert s.evaluate(np.array([[9.0, 9, 9]]))[0][0] == 0.08


def test_hermite_matrix_is_positive_definite():
    rng = np.random.default_rng(8)
    t = rng.random(200) * 2 * np.pi
    p = np.column_stack([0.18 * np.cos(t), 0.18 * np.sin(t), rng.random(200) * 0.4])
    assert np.linalg.eigvalsh(hermite_matrix(p, np.full(200, 0.06))).min() > -1e-9


def test_registration_recovers_a_pose():
    rng = np.random.default_rng(9)
    t, z = rng.random(3000) * 2 * np.pi, rng.random(3000) * 0.4 - 0.2
    body = np.column_stack([0.25 * np.cos(t), 0.12 * np.sin(t), z])
    n = np.column_stack([np.cos(t) / 0.25, np.sin(t) / 0.12, 0 * z])
    s = build_surface(body, n / np.linalg.norm(n, axis=1)[:, None], 300)
    c, k = np.cos(0.6), np.sin(0.6)
    seen = body[::20] - s.centroid * [1, 1, 0]
    world = np.column_stack([c * seen[:, 0] - k * seen[:, 1] + 1, k * seen[:, 0] + c * seen[:, 1] - 0.5, seen[:, 2]])
    pose = gauss_newton(s, world, [1.0, -0.5, 0.55], s.centroid[2], rounds=12)
    assert pose == pytest.approx([1, -0.5, 0.6], abs=0.02)
    assert score(s, world, pose, s.centroid[2], 0.012) < score(s, world, [1.0, -0.5, 0.55], s.centroid[2], 0.012)


def test_agglomeration_and_boxes():
    rng = np.random.default_rng(10)
    two = np.vstack([rng.random((60, 3)) * 0.2, rng.random((60, 3)) * 0.2 + 2])
    labels = agglomerate(two, 12, 0.3, 2)
    assert len(set(labels[:60])) == 1 and len(set(labels[60:])) == 1 and labels[0] != labels[-1]
    arms = np.vstack([rng.random((400, 3)) * [1, 0.02, 0.5], rng.random((400, 3)) * [0.02, 1, 0.5]])
    boxes = split_boxes(arms)
    assert len(boxes) >= 2 and upright_box(arms[:5], 0.04) is None
    halves = [upright_box(arms[:200], 0.08), upright_box(arms[200:400], 0.08)]
    assert len(merge_boxes(halves, 0.08, 0.01)) == 1 and merge_boxes([]) == []


def test_tracker_contract():
    t = Track()
    assert step(t, 0.0, None, False) == (False, None) and t.lifecycle == SEARCHING
    for k in range(4):
        assert not step(t, 0.1 * k, (1, 1, 0), False)[0]
    assert step(t, 0.5, (1, 1, 0), False)[0] and t.lifecycle == ACTIVE
    assert step(t, 0.6, (1.1, 1, 0), True)[0] and t.x[0] == 1.1
    accepted, nis = step(t, 0.7, (9, 9, 0), False)
    assert not accepted and nis > 9.21
    step(t, 0.8, None, False)
    assert t.lifecycle == COASTING
    step(t, 3.0, None, False)
    assert t.lifecycle == SEARCHING and t.health == 0 and not t.started
    assert Track(*astuple(t)) == t


def test_tracker_is_consistent_with_its_noise():
    rng, t, inside = np.random.default_rng(42), Track(), []
    step(t, 0.0, (0, 0, 0), True)
    for k in range(1, 101):
        z = rng.normal(0, np.sqrt([0.05, 0.05, 0.1]))
        _, nis = step(t, 0.1 * k, tuple(z), False)
        inside.append(nis <= 9.35)
    assert np.mean(inside) >= 0.85


def test_config_names():
    assert Config.from_mapping({"a": {"voxel": 0.1}}).voxel == 0.1
    with pytest.raises(ValueError, match="unknown"):
        Config.from_mapping({"nope": 1})


def test_single_row_groups_do_not_crash(spark):
    one = _cloud(spark, [[1, 2, 3]])
    assert A.upright_box(one, ["frame_id"], 0.05).count() == 1
    assert S.voxel_mean(one, 0.1, ["frame_id"]).first().n == 1
    assert C.ransac_plane(one, 0.1, 5).count() == 0
    assert C.farthest_points(one, 5).count() == 1
    assert pd.DataFrame().empty
