"""Queries of the row-wise operators, each with its DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import geometry as g
from pointloom.operators import points as P
from pointloom.plans.registry import query
from pointloom.plans.views import BIG, PTS, SHELLS, TRAJ, WALLS, big_pts, pts, shells, traj, walls

_C, _S = math.cos(0.3), math.sin(0.3)
ROTATION = ((_C, -_S, 0.0), (_S * _C, _C * _C, -_S), (_S * _S, _S * _C, _C))
DAMAGED = "damaged AS (SELECT frame_id, point_id, CASE point_id % 50 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE x END AS x, y, z, intensity FROM pts)"
WALL_SQL = "abs(nx * x + ny * y + nz * z + d) <= 0.03 AND (half_width IS NULL OR (abs(ux * (x - cx) + uy * (y - cy) + uz * (z - cz)) <= half_width AND abs(vx * (x - cx) + vy * (y - cy) + vz * (z - cz)) <= half_height))"


def _thin(i: int) -> str:
    first = ["e0 <= e1 AND e0 <= e2", "e1 < e0 AND e1 <= e2", "e2 < e0 AND e2 < e1"][i]
    return f"e{i} + CASE WHEN {first} THEN 0.04 ELSE 0.15 END"


SHELL_SQL = " AND ".join(f"abs(a{i}x * (x - cx) + a{i}y * (y - cy) + a{i}z * (z - cz)) < {_thin(i)}" for i in range(3))


def r6(c):
    return F.round(c, 6) + 0.0


@query(f"WITH {PTS}, {DAMAGED} SELECT frame_id, point_id, round(x, 6) AS x FROM damaged WHERE isfinite(x) AND isfinite(y) AND isfinite(z)")
def finite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("point_id") % 50
    damaged = pts(spark, sf_dir).withColumn("x", F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, F.lit(None)).otherwise(F.col("x")))
    return P.drop_nonfinite(damaged).select("frame_id", "point_id", F.round("x", 6).alias("x"))


@query(f"WITH {PTS} SELECT frame_id, point_id FROM pts WHERE sqrt(x * x + y * y) >= 0.12")
def blind_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.outside_blind_spot(pts(spark, sf_dir), 0.12).select("frame_id", "point_id")


@query("WITH " + BIG + " SELECT frame_id, point_id, " + ", ".join(f"round({a} * x + {b} * y + {c} * z, 6) + 0.0 AS {n}" for n, (a, b, c) in zip("xyz", ROTATION, strict=True)) + " FROM big")
def rigid_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.align(big_pts(spark, sf_dir), ROTATION).select("frame_id", "point_id", *[r6(F.col(c)).alias(c) for c in "xyz"])


@query(
    f"""WITH {PTS}, u AS (SELECT point_id, x / l AS nx, y / l AS ny, abs(z) / l AS nz FROM (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM pts)),
    f AS (SELECT *, nx * nx + ny * ny AS s2, CASE WHEN sqrt(nx * nx + ny * ny) >= 1e-6 THEN (1 - nz) / (nx * nx + ny * ny) ELSE 0 END AS f FROM u)
    SELECT point_id, round(1 - nx * nx * f, 6) AS m00, round(-nx * ny * f, 6) + 0.0 AS m01, round(-nx, 6) + 0.0 AS m02,
    round(1 - ny * ny * f, 6) AS m11, round(-ny, 6) + 0.0 AS m12, round(nx, 6) AS m20, round(ny, 6) AS m21, round(1 - s2 * f, 6) AS m22 FROM f"""
)
def rodrigues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = g.norm([F.col(c) for c in "xyz"])
    m = g.align_to_up([F.col("x") / n, F.col("y") / n, F.abs("z") / n])
    picked = {f"m{i}{j}": r6(m[i][j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2))}
    return pts(spark, sf_dir).select("point_id", *[v.alias(k) for k, v in picked.items()])


@query(f"WITH {PTS} SELECT frame_id, point_id FROM pts WHERE abs(z + 0.1) <= 1.5 * 0.05")
def ground_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ground_band(pts(spark, sf_dir), -0.1, 0.05).select("frame_id", "point_id")


@query(f"WITH {PTS}, {WALLS} SELECT frame_id, point_id FROM pts WHERE EXISTS (SELECT 1 FROM walls WHERE {WALL_SQL})")
def wall_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.on_walls(pts(spark, sf_dir), walls(spark), 0.03).select("frame_id", "point_id")


@query(f"WITH {PTS}, {WALLS} SELECT frame_id, point_id FROM pts WHERE NOT EXISTS (SELECT 1 FROM walls WHERE {WALL_SQL})")
def wall_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.on_walls(pts(spark, sf_dir), walls(spark), 0.03, "left_anti").select("frame_id", "point_id")


@query(f"WITH {PTS}, {SHELLS} SELECT frame_id, point_id FROM pts WHERE EXISTS (SELECT 1 FROM shells WHERE {SHELL_SQL})")
def shell_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.in_shells(pts(spark, sf_dir), shells(spark)).select("frame_id", "point_id")


@query(f"WITH {PTS}, {SHELLS}, h AS (SELECT frame_id, count(*) AS hits FROM pts JOIN shells ON {SHELL_SQL} GROUP BY frame_id), n AS (SELECT frame_id, count(*) AS n FROM pts GROUP BY frame_id) SELECT frame_id, coalesce(hits, 0) AS hits, n, round(coalesce(hits, 0) / n, 6) AS share, coalesce(hits, 0) / n > 0.6 AS structure FROM n LEFT JOIN h USING (frame_id)")
def near_wall_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = P.near_wall_share(pts(spark, sf_dir), shells(spark), ["frame_id"], 0.15, 0.04)
    return shares.select("frame_id", "hits", "n", F.round("share", 6).alias("share"), (F.col("share") > 0.6).alias("structure"))


LABEL_SQL = f"CASE WHEN x * x + y * y < 0.0064 THEN -1 WHEN abs(z + 0.1) < 0.05 + 0.03 THEN 0 WHEN EXISTS (SELECT 1 FROM shells WHERE {SHELL_SQL}) THEN 1 ELSE 3 END"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pts(spark, sf_dir)
    inside = P.in_shells(points, shells(spark)).select("point_id", F.lit(True).alias("inside"))
    x, y, z = (F.col(c) for c in "xyz")
    label = P.semantic_label(x * x + y * y < 0.0064, F.abs(z + 0.1) < 0.05 + 0.03, F.coalesce("inside", F.lit(False)))
    return points.join(inside, "point_id", "left").withColumn("label", label)


@query(f"WITH {PTS}, {SHELLS} SELECT frame_id, point_id, {LABEL_SQL} AS label FROM pts")
def label_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("frame_id", "point_id", "label")


@query(f"WITH {PTS}, {SHELLS}, l AS (SELECT {LABEL_SQL} AS label FROM pts) SELECT label, count(*) AS n FROM l GROUP BY label")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PTS}, names(frame_id, label) AS (VALUES (0, 2), (1, 3), (4, 2)) SELECT point_id, coalesce(label, 1) AS label FROM pts LEFT JOIN names USING (frame_id)")
def label_default_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(0, 2), (1, 3), (4, 2)], "frame_id long, label int")
    return P.default_label(pts(spark, sf_dir), names, "frame_id", 1).select("point_id", "label")


@query(f"WITH {PTS}, m AS (SELECT frame_id, avg(z) AS mean_z FROM pts GROUP BY frame_id) SELECT point_id, CASE WHEN mean_z + 0.1 > 0.1 THEN 1 ELSE 3 END AS label FROM pts JOIN m USING (frame_id)")
def height_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.height_gate(pts(spark, sf_dir).withColumn("label", F.lit(3)), ["frame_id"], -0.1, 0.1).select("point_id", "label")


@query(f"WITH {PTS} SELECT point_id, round(coalesce(CASE WHEN point_id % 7 = 0 THEN NULL ELSE intensity END, 100.0), 6) AS intensity FROM pts")
def intensity_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = pts(spark, sf_dir).withColumn("intensity", F.when(F.col("point_id") % 7 != 0, F.col("intensity")))
    return P.fill_intensity(holes).select("point_id", F.round("intensity", 6).alias("intensity"))


@query(f"WITH {PTS}, m AS (SELECT frame_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pts GROUP BY frame_id) SELECT point_id, round(x - mx, 6) + 0.0 AS x, round(y - my, 6) + 0.0 AS y, round(z - mz, 6) + 0.0 AS z FROM pts JOIN m USING (frame_id)")
def recentre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.recentre(pts(spark, sf_dir), ["frame_id"]).select("point_id", *[r6(F.col(c)).alias(c) for c in "xyz"])


@query(f"WITH {PTS}, e AS (SELECT point_id, least(abs(x) / 0.15, 1.0) AS e FROM pts) SELECT point_id, round(greatest(least(2 * e, 1.0), 0.0), 6) AS red, round(greatest(least(2 * (1 - e), 1.0), 0.0), 6) AS green, 0.0::DOUBLE AS blue FROM e")
def heat_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    red, green, blue = P.heat_colour(F.col("x"), 0.15)
    return pts(spark, sf_dir).select("point_id", F.round(red, 6).alias("red"), F.round(green, 6).alias("green"), blue.alias("blue"))


@query(f"WITH {SHELLS}, k AS (SELECT CAST(i AS INTEGER) AS corner, 1 - 2 * (i & 1) AS s0, 1 - (i & 2) AS s1, 1 - (i & 4) // 2 AS s2 FROM range(8) t(i)) SELECT shell_id, corner, " + ", ".join(f"round(c{c} + a0{c} * e0 * s0 + a1{c} * e1 * s1 + a2{c} * e2 * s2, 6) + 0.0 AS {c}" for c in "xyz") + " FROM shells CROSS JOIN k")
def box_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.box_corners(shells(spark)).select("shell_id", "corner", *[r6(F.col(c)).alias(c) for c in "xyz"])


@query(f"WITH {TRAJ}, l AS (SELECT track, event_id, lead(event_id) OVER w AS next_id, x, lead(x) OVER w AS next_x FROM traj WINDOW w AS (PARTITION BY track ORDER BY ts, event_id)) SELECT track, event_id, next_id, x, next_x FROM l WHERE next_id IS NOT NULL")
def polyline_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.operators.tracks import polyline

    return polyline(traj(spark, sf_dir), "track", ["ts", "event_id"], {"event_id": "next_id", "x": "next_x"}).select("track", "event_id", "next_id", "x", "next_x")


@query(
    f"""WITH {PTS}, b AS (SELECT min(x) lox, max(x) hix, min(y) loy, max(y) hiy, min(z) loz, max(z) hiz FROM pts)
    SELECT i.i AS ix, j.i AS iy, k.i AS iz, round(lox - 0.05 + i.i * 0.05, 6) AS x, round(loy - 0.05 + j.i * 0.05, 6) AS y, round(loz - 0.05 + k.i * 0.05, 6) AS z
    FROM b, LATERAL (SELECT CAST(unnest(range(0, CAST(floor((hix - lox + 0.1) / 0.05) AS BIGINT) + 1)) AS INTEGER) AS i) i,
    LATERAL (SELECT CAST(unnest(range(0, CAST(floor((hiy - loy + 0.1) / 0.05) AS BIGINT) + 1)) AS INTEGER) AS i) j,
    LATERAL (SELECT CAST(unnest(range(0, CAST(floor((hiz - loz + 0.1) / 0.05) AS BIGINT) + 1)) AS INTEGER) AS i) k"""
)
def grid_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = pts(spark, sf_dir).agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    grid = P.regular_grid(one, 0.05, 0.05)
    return grid.select("ix", "iy", "iz", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(f"WITH {PTS} SELECT point_id, round(atan2(sin(x * 100), cos(x * 100)), 6) + 0.0 AS yaw FROM pts")
def yaw_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts(spark, sf_dir).select("point_id", r6(g.wrap_angle(F.col("x") * 100)).alias("yaw"))


BINS_SQL = f"CAST(least(greatest(floor((atan2(y, x) + {math.pi}) / (2 * {math.pi}) * 90), 0), 89) AS INTEGER) AS u, CAST(least(greatest(floor((asin(least(greatest(z / greatest(sqrt(x * x + y * y + z * z), 1e-6), -1.0), 1.0)) + {math.pi} / 2) / {math.pi} * 45), 0), 44) AS INTEGER) AS v"


@query(f"WITH {PTS} SELECT point_id, {BINS_SQL} FROM pts")
def spherical_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts(spark, sf_dir).select("point_id", g.azimuth_bin("x", "y", 90).alias("u"), g.elevation_bin("x", "y", "z", 45).alias("v"))


@query(f"WITH {PTS} SELECT point_id, intensity FROM pts WHERE frame_id < 3")
def first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts(spark, sf_dir).filter("frame_id < 3").select("point_id", "intensity")


@query(f"WITH {PTS} SELECT point_id, 'ground' AS part FROM pts WHERE abs(z + 0.1) <= 0.075 UNION ALL SELECT point_id, 'rest' AS part FROM pts WHERE NOT abs(z + 0.1) <= 0.075")
def union_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pts(spark, sf_dir)
    ground = P.ground_band(points, -0.1, 0.05)
    rest = points.join(ground.select("point_id"), "point_id", "left_anti")
    return ground.select("point_id", F.lit("ground").alias("part")).unionByName(rest.select("point_id", F.lit("rest").alias("part")))


@query(f"WITH {PTS} SELECT point_id FROM pts WHERE abs(0.6 * x + 0.8 * z) > 0.04")
def except_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pts(spark, sf_dir)
    inliers = points.filter(F.abs(g.dot([0.6, 0.0, 0.8], [F.col(c) for c in "xyz"])) <= 0.04)
    return points.join(inliers.select("point_id"), "point_id", "left_anti").select("point_id")
