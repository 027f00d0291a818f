"""Point-cloud views of the driver tables, for Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points: frame_id, point_id, x, y, z, intensity."""
    dims = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "z", "intensity"))]
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("frame_id"), F.col("vec_id").alias("point_id"), *dims)


def big_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as points, one frame a supplier."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("frame_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"),
        (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 20000).alias("y"), (F.col("l_tax") * 10).alias("z"), (F.col("l_discount") * 1000 + 0.0).alias("intensity"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as diagnostics rows: bag, frame order (ts, event_id), latency_total_ms, nis, fsm_state."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("bag"), "ts", "event_id", F.col("value").alias("latency_total_ms"), (F.col("value") / 10).alias("nis"), (F.col("user_id") % 3 + 1).cast("int").alias("fsm_state"))


def traj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tracks: track, ts, event_id, x, y."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), "ts", "event_id", F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))


PTS = "pts AS (SELECT CAST(label AS BIGINT) AS frame_id, vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS intensity FROM embeddings)"
BIG = "big AS (SELECT l_suppkey AS frame_id, l_orderkey * 8 + l_linenumber AS point_id, l_quantity / 10 AS x, l_extendedprice / 20000 AS y, l_tax * 10 AS z, l_discount * 1000 + 0.0 AS intensity FROM lineitem)"
METRICS = "metrics AS (SELECT event_type AS bag, ts, event_id, value AS latency_total_ms, value / 10 AS nis, CAST(user_id % 3 + 1 AS INTEGER) AS fsm_state FROM events)"
TRAJ = "traj AS (SELECT user_id AS track, ts, event_id, value AS x, CAST(event_id % 100 AS DOUBLE) AS y FROM events)"

#: A small room: two bounded walls and an endless one, three shells, and their names.
WALL_ROWS = [
    (0, 1.0, 0.0, 0.0, -0.1, 0.1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.12, 0.15),
    (1, 0.0, 1.0, 0.0, 0.12, 0.0, -0.12, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.2, 0.08),
    (2, 0.0, 0.6, 0.8, -0.15, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, None),
]
WALL_COLUMNS = "wall_id nx ny nz d cx cy cz ux uy uz vx vy vz half_width half_height".split()
SHELL_ROWS = [
    (0, 0.05, 0.05, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.06, 0.02, 0.1),
    (1, -0.1, 0.0, 0.05, 0.8, 0.6, 0.0, -0.6, 0.8, 0.0, 0.0, 0.0, 1.0, 0.03, 0.08, 0.05),
    (2, 0.02, -0.15, -0.05, 0.6, -0.8, 0.0, 0.8, 0.6, 0.0, 0.0, 0.0, 1.0, 0.04, 0.05, 0.02),
]
SHELL_COLUMNS = "shell_id cx cy cz a0x a0y a0z a1x a1y a1z a2x a2y a2z e0 e1 e2".split()


def _frame(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    return spark.createDataFrame(rows, f"{columns[0]} int, " + ", ".join(f"{c} double" for c in columns[1:]))


def walls(spark: SparkSession) -> DataFrame:
    return _frame(spark, WALL_ROWS, WALL_COLUMNS)


def shells(spark: SparkSession) -> DataFrame:
    return _frame(spark, SHELL_ROWS, SHELL_COLUMNS)


def _values(name: str, rows: list[tuple], columns: list[str]) -> str:
    cells = lambda r: ", ".join([str(r[0]), *("CAST(NULL AS DOUBLE)" if v is None else f"{v}::DOUBLE" for v in r[1:])])
    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join(f'({cells(r)})' for r in rows)})"


WALLS = _values("walls", WALL_ROWS, WALL_COLUMNS)
SHELLS = _values("shells", SHELL_ROWS, SHELL_COLUMNS)
