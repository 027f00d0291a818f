"""The chained pipelines on a small synthetic room, and the SQL names."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.config import Config
from pointloom.functions import sql
from pointloom.operators.surface import build_surface
from pointloom.plans import pipelines as L
from pointloom.plans.views import SHELL_COLUMNS

CLOUD = "frame_id long, point_id long, x double, y double, z double, intensity double"


def _body(rng, n):
    t, z = rng.random(n) * 2 * np.pi, rng.random(n) * 0.4
    p = np.column_stack([0.25 * np.cos(t), 0.12 * np.sin(t), z])
    m = np.column_stack([np.cos(t) / 0.25, np.sin(t) / 0.12, 0 * z])
    return p, m / np.linalg.norm(m, axis=1)[:, None]


def _room(rng, pose, ground=400, wall=200, body=150):
    p, _ = _body(rng, body)
    c, s = np.cos(pose[2]), np.sin(pose[2])
    p = np.column_stack([c * p[:, 0] - s * p[:, 1] + pose[0], s * p[:, 0] + c * p[:, 1] + pose[1], p[:, 2] + 0.1])
    floor = np.column_stack([rng.random((ground, 2)) * 8 - 4, rng.normal(0, 0.005, ground)])
    side = np.column_stack([np.full(wall, 3.5), rng.random(wall) * 4 - 2, rng.random(wall) * 1.2 + 0.1])
    return np.vstack([floor, side, p])


def _rows(spark, clouds):
    return spark.createDataFrame([(f, f * 10_000 + i, *map(float, q), None) for f, cloud in enumerate(clouds) for i, q in enumerate(cloud)], CLOUD)


def test_online_tracking_follows_the_body(spark):
    rng = np.random.default_rng(11)
    points, normals = _body(rng, 2500)
    surface = build_surface(points, normals, 250)
    poses = [(1.5 + 0.02 * k, 0.5, 0.02 * k) for k in range(6)]
    clouds = _rows(spark, [_room(rng, p) for p in poses])
    frames = spark.createDataFrame([(1, k, 0.1 * k) for k in range(7)], "track long, frame long, ts double")
    wall = (0, 3.5, 0.0, 0.7, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.01, 2.0, 0.6)
    shells = spark.createDataFrame([wall], f"{SHELL_COLUMNS[0]} int, " + ", ".join(f"{c} double" for c in SHELL_COLUMNS[1:]))
    config = Config(dbscan_eps=0.2, dbscan_min_points=6, yaw_starts=16, yaw_kept=4)
    shifted = clouds.withColumn("z", clouds.z - 0.1)  # the surface's own height
    rows = L.online_tracking(frames, shifted, shells, surface, -0.1, config).orderBy("frame").collect()
    assert len(rows) == 7 and rows[-1].lifecycle == "COASTING"
    for r, p in zip(rows[:6], poses, strict=False):
        assert r.lifecycle == "ACTIVE" and (r.x, r.y) == pytest.approx(p[:2], abs=0.03)


def test_offline_candidates_and_static_map(spark):
    rng = np.random.default_rng(12)
    cloud = _rows(spark, [_room(rng, (1.2, -0.4, 0.3), 1500, 900, 600)])
    config = Config(dbscan_eps=0.25, dbscan_min_points=8, ground_threshold=0.03, kappa_volume=3.0, rho_floor=1.0, rho_base=1.0, volumetricity_min=0.01)
    out = L.offline_candidates(cloud, config, (0.5, 0.3, 0.4)).toPandas()
    assert set(out.label) <= {0, 1, 2, 3} and (out.label == 0).sum() > 1000
    body = out[out.label == 3]
    assert len(body) > 300 and np.hypot(body.x.mean() - 1.2, body.y.mean() + 0.4) < 0.1
    shells = L.static_map(spark.createDataFrame(out[out.label == 1][["point_id", "x", "y", "z", "intensity", "label"]]), config, solidity=0.01).collect()
    wall = [s for s in shells if abs(s.cx - 3.5) < 0.05]  # thirty groups at most, so the wall may come in pieces
    reach = [(s.cy - max(s.e0, s.e1), s.cy + max(s.e0, s.e1)) for s in wall]
    assert wall and len(shells) <= 30 and max(h for _, h in reach) - min(low for low, _ in reach) > 2


def test_sql_names(spark):
    sql.register(spark)
    spark.createDataFrame([(float(i), float(j), float(k)) for i in (0, 1) for j in (0, 1) for k in (0, 2)], "x double, y double, z double").createOrReplaceTempView("cube")
    assert spark.sql("SELECT hull_volume(x, y, z) AS v FROM cube").first().v == pytest.approx(2.0)
    corners = spark.sql("SELECT * FROM box_corners(0D, 0D, 0D, 0D, 1D, 2D, 3D)").collect()
    assert len(corners) == 8 and {abs(c.z) for c in corners} == {3.0}
    row = spark.sql("SELECT wrap_angle(7D) AS a, wendland(0D) AS w, wendland(1D) AS e").first()
    assert row.a == pytest.approx(7 - 2 * np.pi) and (row.w, row.e) == (1.0, 0.0)


def test_buffer_stream_equals_batch(spark, tmp_path):
    from pointloom.streaming.buffer import accumulate, accumulate_stream

    rng = np.random.default_rng(13)
    rows = [(t, k, 0.3 * k, 0.1, -0.05, 0.2, [tuple(map(float, (*rng.random(3), 1.0 + k))) for _ in range(int(rng.integers(0, 6)))]) for t in (1, 2) for k in range(12)]
    frames = spark.createDataFrame(rows, "track long, frame long, ts double, vx double, vy double, omega double, points array<struct<x:double,y:double,z:double,intensity:double>>")
    config = Config(buffer_trigger=5, buffer_cap=6, buffer_voxel=0.3)
    want = sorted((r.track, r.frame, *(round(v, 9) for v in r[3:])) for r in accumulate(frames, config).collect())
    for part in (0, 1):  # two files, one micro-batch each
        frames.filter(f"frame >= {6 * part} AND frame < {6 * part + 6}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = accumulate_stream(stream, config).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.track, r.frame, *(round(v, 9) for v in r[3:])) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want


def test_buffer_cells_are_those_of_its_stream(spark):
    """At this time and turn the virtual machine's sine and cosine differ from the C library's in their last bit (F5)."""
    from pointloom.functions.geometry import c_turns

    angles = [34.089627451249996, *(0.001 * k for k in range(1, 20_000))]
    frame = spark.createDataFrame([(0, angles), (1, []), (2, None), (3, [float("inf"), None])], "k long, a array<double>")
    rows = {r.k: r.t for r in frame.select("k", c_turns(F.col("a")).alias("t")).collect()}
    assert [tuple(r) for r in rows[0]] == [(math.cos(v), math.sin(v)) for v in angles]
    assert rows[1] == [] and rows[2] is None and math.isnan(rows[3][0].c) and rows[3][1].s is None
    plain = frame.filter("k = 0").select(F.explode("a").alias("a")).select(F.cos("a").alias("c"), F.sin("a").alias("s")).collect()
    assert any(tuple(r) != (math.cos(v), math.sin(v)) for r, v in zip(plain, angles, strict=True))


def test_motion_buffer_on_the_border_of_a_cell(spark, tmp_path):
    """A point 5 cells from the corner, whose cell follows from the last bit of the sine (F5)."""
    import duckdb

    from pointloom.plans import catalog

    at = dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=round(34.089627451249996 * 40_000 * 1e6))
    rows = [(152801 - 4 * k, at - dt.timedelta(microseconds=1_000_000 * k * step), step, "x", 50.0 + k, "{}") for k in range(5) for step in range(1, 4001)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.queries()["motion_buffer"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    cur = con.execute(catalog.oracle_sql()["motion_buffer"])
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall())
