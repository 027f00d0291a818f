"""Queries of the tables that stages exchange, written with Spark and read again, and of the SQL names; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import sql
from pointloom.operators import points as P
from pointloom.operators.spatial import field_value
from pointloom.operators.stage import shared_dir, staged
from pointloom.plans.feature_queries import FIELD, PRIMS
from pointloom.plans.point_queries import r6
from pointloom.plans.registry import query
from pointloom.plans.views import PTS, pts
from pointloom.sources import tables as T

ARRAY = 512  # primitives of a frame that the SQL function takes as an array


@query(f"WITH {PTS} SELECT round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, CAST(frame_id % 4 AS INTEGER) AS label FROM pts WHERE frame_id % 4 IN (1, 2)")
def labelled_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled points written by label; structure and candidates read again, the other folders are not opened."""
    points = pts(spark, sf_dir).select(*[F.col(c).cast("float").alias(c) for c in "xyz"], (F.col("frame_id") % 4).cast("int").alias("label"), F.col("intensity").cast("float").alias("intensity"))
    path = shared_dir(spark, "labelled")
    T.write_labelled(points, path)
    found = T.read_labelled(spark, path, [P.STRUCTURE, P.CANDIDATE])
    return found.select(*[r6(F.col(c).cast("double")).alias(c) for c in "xyz"], "label")


@query(f"WITH {PTS}, f AS (SELECT frame_id, count(*) FILTER (intensity > 0.1) AS n FROM pts GROUP BY frame_id) SELECT p.frame_id, p.point_id, round(p.x, 6) + 0.0 AS x FROM pts p JOIN f ON f.frame_id = p.frame_id WHERE n > 0 AND p.intensity > 0.1")
def frame_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points packed into frames, of which those with points are unpacked again."""
    bright = F.filter(F.collect_list(F.struct("point_id", *"xyz", "intensity")), lambda p: p["intensity"] > 0.1)
    frames = pts(spark, sf_dir).groupBy("frame_id").agg(bright.alias("found")).select("frame_id", F.lit(0).alias("ts"), F.col("found").alias("points"))
    rows = P.drop_empty_frames(frames).select("frame_id", F.explode("points").alias("p"))
    return rows.select("frame_id", "p.point_id", r6(F.col("p.x")).alias("x"))


@query(f"WITH {PTS}, {PRIMS.replace('SELECT point_id AS k', 'SELECT frame_id AS of_frame, point_id AS k')}, {FIELD.replace('pts JOIN prims ON', 'pts JOIN prims ON frame_id = of_frame AND')} SELECT point_id, round(field, 6) + 0.0 AS field FROM f")
def field_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field at each point, over the primitives of its frame: by the SQL function in sensor frames, by the blocks of `field_value` where a frame's array would be long."""
    sql.register(spark)
    points = pts(spark, sf_dir)
    sizes = points.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
    large = staged(points.join(sizes.filter(F.col("n") > ARRAY), "frame_id", "left_semi"), "field")
    points = points.join(sizes.filter(F.col("n") <= ARRAY), "frame_id", "left_semi")
    primitives = large.select("frame_id", *[F.col(c).alias(f"p{c}") for c in "xyz"], F.lit(0.12).alias("h"), (0.5 + F.col("intensity")).alias("alpha_v"), *[F.col(c).alias(f"alpha_g{c}") for c in "xyz"])
    by_blocks = field_value(large, primitives, by=["frame_id"]).select("point_id", r6(F.col("field")).alias("field"))
    one = F.struct(*[F.col(c).alias(f"p{c}") for c in "xyz"], F.lit(0.12).alias("h"), (0.5 + F.col("intensity")).alias("alpha_v"), *[F.col(c).alias(f"alpha_g{c}") for c in "xyz"])
    frames = points.groupBy("frame_id").agg(F.collect_list(one).alias("primitives"))
    by_function = points.join(frames, "frame_id").select("point_id", r6(F.expr("field_eval(x, y, z, primitives, 0.08D)")).alias("field"))
    return by_function.unionByName(by_blocks)
