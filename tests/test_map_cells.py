"""Joins with a large map by cells, against plain comparison of all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import map_cells
from pointloom.operators import points as P
from pointloom.plans.views import SHELL_COLUMNS, WALL_COLUMNS


def _frame(spark, rows, columns):
    return spark.createDataFrame(rows, f"{columns[0]} int, " + ", ".join(f"{c} double" for c in columns[1:]))


def _turn(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q


def _walls(rng, n):
    rows = []
    for i in range(n):
        normal, u, v = _turn(rng) if i % 4 else np.roll(np.eye(3), i % 3, axis=0)
        centre, d = rng.random(3) * 4 - 2, float(rng.normal())
        bounds = (float(rng.random()) * 0.5, float(rng.random()) * 0.5) if i % 5 else (None, None)
        rows.append((i, *normal.tolist(), d, *centre.tolist(), *u.tolist(), *v.tolist(), *bounds))
    return rows


def _shells(rng, n):
    return [(i, *(rng.random(3) * 4 - 2).tolist(), *_turn(rng).ravel().tolist(), *(rng.random(3) * 0.3).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(6)
    xyz = rng.random((1500, 3)) * 4 - 2
    rows = [(i % 7, i, *map(float, p)) for i, p in enumerate(xyz)] + [(0, 9001, float("nan"), 0.0, 0.0), (0, 9002, 1e6, 0.0, 0.0)]
    return spark.createDataFrame(rows, "frame_id long, point_id long, x double, y double, z double").cache()


def _ids(df):
    return sorted(r.point_id for r in df.select("point_id").collect())


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_walls_and_shells_by_cells_equal_all_pairs(spark, cloud, how, monkeypatch):
    rng = np.random.default_rng(9)
    walls, shells = _frame(spark, _walls(rng, 90), WALL_COLUMNS), _frame(spark, _shells(rng, 90), SHELL_COLUMNS)
    by_cells = P.on_walls(cloud, walls, 0.03, how), P.in_shells(cloud, shells, 0.02, 0.01, how)
    assert all(set(df.columns) == set(cloud.columns) for df in by_cells)
    assert not any("NestedLoop" in df._jdf.queryExecution().toString() for df in by_cells)
    got = [_ids(df) for df in by_cells]
    monkeypatch.setattr(map_cells, "FEW", 1000)
    assert got == [_ids(P.on_walls(cloud, walls, 0.03, how)), _ids(P.in_shells(cloud, shells, 0.02, 0.01, how))]
    assert 0 < len(got[0]) < 1502 and 0 < len(got[1]) < 1502


def test_shares_count_every_shell_once(spark, cloud, monkeypatch):
    shells = _frame(spark, _shells(np.random.default_rng(10), 120), SHELL_COLUMNS)
    rows = lambda: sorted(map(tuple, P.near_wall_share(cloud, shells, ["frame_id"], 0.05, 0.02).collect()))
    got = rows()
    monkeypatch.setattr(map_cells, "FEW", 1000)
    assert got == rows() and sum(r[1] for r in got) > 100


def test_large_map_needs_no_nested_loop(spark, cloud):
    shells = spark.range(20_000).select(F.col("id").cast("int").alias("shell_id"), *[((F.col("id") * k) % 97 / 25 - 2).alias(f"c{c}") for k, c in ((7, "x"), (11, "y"), (13, "z"))], *[F.lit(float(i == "xyz".index(c))).alias(f"a{i}{c}") for i in range(3) for c in "xyz"], *[F.lit(0.3).alias(f"e{i}") for i in range(3)])
    for how in ("left_semi", "left_anti"):
        df = P.in_shells(cloud, shells, 0.0, 0.0, how)
        assert "NestedLoop" not in df._jdf.queryExecution().toString() and df.count() > 0


def test_map_without_parts_or_points(spark, cloud):
    none = _frame(spark, [], SHELL_COLUMNS)
    assert P.in_shells(cloud, none).count() == 0 and P.in_shells(cloud, none, how="left_anti").count() == cloud.count()
    many = _frame(spark, _shells(np.random.default_rng(1), 70), SHELL_COLUMNS)
    assert P.in_shells(cloud.limit(0), many).count() == 0
