"""In-task neighbours and agglomeration against brute force."""

from __future__ import annotations

import itertools
import time

import numpy as np
import pytest

from pointloom.operators import neighbours as N
from pointloom.operators import shells as H
from pointloom.operators.solids import hull_vertices, hull_volume


def _clouds():
    rng = np.random.default_rng(2)
    yield rng.random((300, 3))
    yield np.vstack([rng.random((150, 3)) * 0.01, rng.random((20, 3)) * 50, [[1e9, 0, 0], [-1e9, 5, 5]]])
    yield np.repeat(rng.random((9, 3)), 8, axis=0)  # copies tie
    yield np.column_stack([np.arange(60.0), np.zeros(60), np.zeros(60)])  # a line
    yield rng.random((1, 3))


@pytest.mark.parametrize("cloud", list(_clouds()), ids=["cube", "outliers", "copies", "line", "one"])
def test_neighbours_equal_brute_force(cloud):
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(axis=2))
    for radius in (0.05, 1.0):
        i, j = N.within(cloud, radius)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(d <= radius)), strict=True))
    for k, radius in ((1, np.inf), (7, np.inf), (12, 0.2)):
        index, far = N.nearest(cloud, k, radius)
        for a in range(len(cloud)):
            want = [(x, b) for x, b in sorted((x, b) for b, x in enumerate(d[a].tolist())) if x <= radius][:k]
            assert [b for _, b in want] == [b for b in index[a].tolist() if b >= 0] and np.allclose(far[a, : len(want)], [x for x, _ in want])


def test_pairs_come_in_parts(monkeypatch):
    cloud = np.random.default_rng(4).random((200, 3))
    whole = N.nearest(cloud, 9)
    monkeypatch.setattr(N, "PAIRS", 50)
    assert all(np.array_equal(a, b) for a, b in zip(whole, N.nearest(cloud, 9), strict=True))


def test_components_of_chains_and_rings():
    i = np.array([5, 4, 3, 8, 7, 9, 9])
    j = np.array([4, 3, 2, 7, 6, 10, 9])
    assert N.components(12, i, j).tolist() == [0, 1, 2, 2, 2, 2, 6, 6, 6, 9, 9, 11]


def _volume(points, members, ridge):
    if len(members) == 1:
        return np.sqrt(1e-12)
    c = np.cov(points[sorted(members)].T, bias=True) + ridge * np.eye(3)
    return float(np.sqrt(max(np.linalg.det(c), 1e-12)))


def _greedy(points, edges, left):
    """Merge the pair of least cost again and again, with volumes of all members each time. Returns the groups and the lowest gap between the two best costs."""
    groups = {i: ({i}, 1e-6) for i in range(len(points))}
    links = {frozenset(e) for e in edges}
    while len(groups) > left and links:
        best = None
        for i, j in sorted(tuple(sorted(e)) for e in links):
            (a, ra), (b, rb) = groups[i], groups[j]
            ridge = (len(a) * ra + len(b) * rb) / (len(a) + len(b)) + 1e-8
            cost = _volume(points, a | b, ridge) - _volume(points, a, ra) - _volume(points, b, rb)
            if best is None or cost < best[0] - 1e-15:
                best = (cost, i, j, ridge)
        _, i, j, ridge = best
        groups[i] = (groups[i][0] | groups.pop(j)[0], ridge)
        links = {frozenset(i if x == j else x for x in e) for e in links}
        links = {e for e in links if len(e) == 2}
    return {x: i for i, (m, _) in groups.items() for x in m}


@pytest.mark.parametrize(("left", "radius"), [(1, 0.4), (8, 0.4), (12, 0.25), (60, 0.3)])
def test_agglomeration_equals_greedy_merging(spark, left, radius):
    rng = np.random.default_rng(left)
    frames = {f: np.vstack([rng.random((14, 3)) * 0.6 + c for c in ([0, 0, 0], [2, 0, 0], [0, 3, 1])]) for f in (0, 1)}
    rows = [(f, 1000 * f + i, *map(float, p)) for f, cloud in frames.items() for i, p in enumerate(cloud)]
    df = spark.createDataFrame(rows, "frame_id long, point_id long, x double, y double, z double")
    got = {r.point_id: r.cluster for r in H.agglomerate_frames(df, k=6, radius=radius, components=left).collect()}
    for f, cloud in frames.items():
        edges = H.neighbour_edges(cloud, 6, radius)
        d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(axis=2))
        assert set(edges) == {(i, j) for i, j in itertools.combinations(range(len(cloud)), 2) if j in np.argsort(d[i], kind="stable")[:6] and d[i, j] < radius}
        want = _greedy(cloud, edges, left)
        assert H.agglomerate(cloud, 6, radius, left).tolist() == [want[i] for i in range(len(cloud))]
        assert [got[1000 * f + i] - 1000 * f for i in range(len(cloud))] == [want[i] for i in range(len(cloud))]


def test_volume_of_single_points_and_merges():
    g = H._Groups(np.array([[0.0, 0, 0], [1.0, 0, 0], [0.0, 1, 0]]))
    assert g.v[0] == pytest.approx(1e-6)
    cov = np.cov(np.array([[0.0, 0, 0], [1.0, 0, 0]]).T, bias=True) + 1.01e-6 * np.eye(3)
    assert g.merged(0, 1)[1] == pytest.approx(np.sqrt(max(np.linalg.det(cov), 1e-12)))


def test_nearest_of_some_points():
    points = np.random.default_rng(8).normal(size=(300, 3))
    of = np.array([250, 3, 77])
    some, every = N.nearest(points, 7, of=of), N.nearest(points, 7)
    assert all(np.array_equal(a, b[of]) for a, b in zip(some, every, strict=True))


def test_hull_of_many_corners_takes_time_in_proportion():
    """All points are corners: the work of each must not grow with their number."""
    q = np.random.default_rng(9).normal(size=(12_000, 3))
    q /= np.linalg.norm(q, axis=1)[:, None]
    begin = time.perf_counter()
    few = hull_volume(q[:1500])
    middle = time.perf_counter()
    many = hull_volume(q)
    assert time.perf_counter() - middle < 25 * (middle - begin)  # 8 times the points
    assert few < many < 4 / 3 * np.pi and many > 4.17 and len(hull_vertices(q[:1500])) == 1500
    grid = np.array([(i, j, k) for i in range(7) for j in range(6) for k in range(5)], float)
    assert np.isclose(hull_volume(grid), 120) and hull_volume(grid[grid[:, 2] == 2]) is None


def test_small_clouds_lose_the_same_outliers_without_cell_lists(monkeypatch):
    points = np.random.default_rng(10).normal(size=(600, 3))
    points[:40] = np.round(points[:40], 1)
    monkeypatch.setattr(H, "SMALL", 0)
    want = H.without_outliers(points)
    monkeypatch.undo()
    monkeypatch.setattr(H, "nearest", None)
    assert np.array_equal(H.without_outliers(points), want)
