"""Queries of the diagnostics and order-dependent operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators import diagnostics as G
from pointloom.operators import tracks as T
from pointloom.plans.registry import query
from pointloom.plans.views import METRICS, PTS, TRAJ, metrics, pts, table, traj

ORDER = ["ts", "event_id"]


def seconds():
    """Seconds since 1970 of `ts`, the same in every session time zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))") / 1e6


SECONDS_SQL = "epoch_us(ts) / 1e6"
NIS_LIMIT = 7.814727903251179  # the 95 % quantile of chi-square with 3 degrees of freedom


@query(
    f"""WITH {TRAJ}, l AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM traj WINDOW w AS (PARTITION BY track ORDER BY ts, event_id))
    SELECT track, round(sum(coalesce(sqrt(dx * dx + dy * dy), 0)), 4) AS length, count(*) AS rows FROM l GROUP BY track"""
)
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.path_length(traj(spark, sf_dir), "track", ORDER).select("track", F.round("length", 4).alias("length"), "rows")


@query(f"WITH {TRAJ}, l AS (SELECT *, {SECONDS_SQL} - lag({SECONDS_SQL}) OVER (PARTITION BY track ORDER BY ts, event_id) AS gap FROM traj) SELECT track, event_id, round(coalesce(greatest(0.01, gap), 0.1), 4) AS dt FROM l")
def frame_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.frame_dt(traj(spark, sf_dir), "track", ORDER, seconds()).select("track", "event_id", F.round("dt", 4).alias("dt"))


@query(f"WITH {TRAJ} SELECT track, event_id, list(event_id) OVER (PARTITION BY track ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS buffer FROM traj")
def sliding_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.last_frames(traj(spark, sf_dir), "track", ORDER, "event_id", 5).select("track", "event_id", "buffer")


@query(
    f"""WITH {TRAJ}, n AS (SELECT track, event_id, {SECONDS_SQL} AS s, row_number() OVER (PARTITION BY track ORDER BY ts, event_id) AS k FROM traj)
    SELECT a.track, a.event_id, b.event_id AS past_id, round(a.s - b.s, 4) AS tau FROM n a JOIN n b ON a.track = b.track AND b.k BETWEEN a.k - 4 AND a.k - 1 AND a.s - b.s > 1e-4 AND a.s - b.s <= 20000"""
)
def history_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = T.history_pairs(traj(spark, sf_dir), "track", ORDER, seconds(), 20000, 5)
    return pairs.select("track", "event_id", F.col("p.event_id").alias("past_id"), F.round("tau", 4).alias("tau"))


@query(
    f"""WITH RECURSIVE {TRAJ}, n AS (SELECT track, CASE WHEN x < 20 THEN 25 WHEN x < 60 THEN 5 ELSE -5 END AS delta, row_number() OVER (PARTITION BY track ORDER BY ts, event_id) AS k FROM traj),
    f(track, k, h) AS (SELECT track, 0::BIGINT, 0.0::DOUBLE FROM (SELECT DISTINCT track FROM n) UNION ALL SELECT f.track, n.k, least(100.0, greatest(0.0, f.h + n.delta)) FROM f JOIN n ON n.track = f.track AND n.k = f.k + 1)
    SELECT track, arg_max(h, k) AS health, max(k) AS rows FROM f GROUP BY track"""
)
def health_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = F.when(F.col("x") < 20, 25.0).when(F.col("x") < 60, 5.0).otherwise(-5.0)
    return T.clamped_fold(traj(spark, sf_dir), "track", ORDER, delta, 0.0, 100.0)


@query(
    f"""WITH {TRAJ}, l AS (SELECT track, {SECONDS_SQL} AS s, ts, event_id, coalesce(CAST({SECONDS_SQL} - lag({SECONDS_SQL}) OVER w > 21600 AS BIGINT), 1) AS opens FROM traj WINDOW w AS (PARTITION BY track ORDER BY ts, event_id)),
    n AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY track ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM l)
    SELECT track, session, count(*) AS rows, round(min(s), 3) AS first_s, round(max(s), 3) AS last_s FROM n GROUP BY track, session"""
)
def coasting_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.sessions(traj(spark, sf_dir), "track", ORDER, seconds(), 21600)
    return found.select("track", "session", "rows", F.round("first_s", 3).alias("first_s"), F.round("last_s", 3).alias("last_s"))


@query(
    f"""WITH {PTS}, q AS (SELECT frame_id, quantile_cont(x, 0.15) AS lo, quantile_cont(x, 0.85) AS hi FROM pts GROUP BY frame_id),
    b AS (SELECT DISTINCT frame_id, lo, CAST(floor((x - lo) / 0.004) AS BIGINT) AS bin FROM pts JOIN q USING (frame_id) WHERE x >= lo AND x <= hi),
    g AS (SELECT frame_id, lo, bin, lead(bin) OVER (PARTITION BY frame_id ORDER BY bin) AS next FROM b),
    w AS (SELECT *, (next - bin - 1) * 0.004::DOUBLE AS width FROM g WHERE (next - bin - 1) * 0.004 >= 0.01)
    SELECT frame_id, round(arg_max(lo + (bin + next + 1) / 2 * 0.004, struct_pack(w := width, f := -bin)), 6) + 0.0 AS centre, round(max(width), 6) AS width FROM w GROUP BY frame_id"""
)
def histogram_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = T.widest_gap(pts(spark, sf_dir), "frame_id", "x", 0.004, 0.01)
    return gaps.select("frame_id", (F.round("centre", 6) + 0.0).alias("centre"), F.round("width", 6).alias("width"))


@query(f"WITH {PTS}, h AS (SELECT CAST(least(floor((x + 0.4) / 0.1), CASE WHEN x <= -0.4 + 8 * 0.1 THEN 7 ELSE 8 END) AS INTEGER) AS bin FROM pts) SELECT CAST(r.bin AS INTEGER) AS bin, count(h.bin) AS count FROM range(8) r(bin) LEFT JOIN h ON h.bin = r.bin GROUP BY r.bin")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.histogram(pts(spark, sf_dir), "x", -0.4, 0.1, 8)


@query(f"WITH {METRICS} SELECT bag, count(*) AS frames, round(avg(latency_total_ms), 4) AS latency_mean, round(quantile_cont(latency_total_ms, 0.5), 4) AS latency_p50, round(quantile_cont(latency_total_ms, 0.95), 4) AS latency_p95, round(quantile_cont(latency_total_ms, 0.99), 4) AS latency_p99, round(avg(CAST(latency_total_ms <= 100 AS DOUBLE)) * 100, 4) AS real_time_pct FROM metrics GROUP BY bag")
def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.latency_report(metrics(spark, sf_dir), "bag")


@query(f"WITH {METRICS} SELECT bag, round(avg(nis), 4) AS nis_mean, round(quantile_cont(nis, 0.95), 4) AS nis_p95, round(avg(CAST(nis <= {NIS_LIMIT} AS DOUBLE)) * 100, 4) AS consistent_pct FROM metrics GROUP BY bag")
def nis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nis_report(metrics(spark, sf_dir), "bag", NIS_LIMIT)


@query(f"WITH {METRICS} SELECT bag, round(avg(CAST(fsm_state = 2 AS DOUBLE)) * 100, 4) AS active_pct, round(avg(CAST(fsm_state = 3 AS DOUBLE)) * 100, 4) AS coasting_pct FROM metrics GROUP BY bag")
def fsm_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fsm_report(metrics(spark, sf_dir), "bag")


@query(
    f"""WITH {METRICS}, {TRAJ}, m AS (SELECT bag, count(*) AS frames, round(avg(latency_total_ms), 4) AS latency_mean FROM metrics WHERE bag <> 'view' GROUP BY bag),
    l AS (SELECT event_type AS bag, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dx FROM events WHERE event_type <> 'error'),
    t AS (SELECT bag, round(sum(coalesce(abs(dx), 0)), 4) AS path_m FROM l GROUP BY bag)
    SELECT bag, coalesce(frames, 0) AS frames, coalesce(latency_mean, 0.0) AS latency_mean, coalesce(path_m, 0.0) AS path_m FROM m FULL JOIN t USING (bag)"""
)
def bag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics(spark, sf_dir)
    tracks = table(spark, sf_dir, "events").filter("event_type <> 'error'").select(F.col("event_type").alias("bag"), "ts", "event_id", F.col("value").alias("x"), F.lit(0.0).alias("y"))
    return G.bag_summary(rows.filter("bag <> 'view'"), tracks, "bag", ORDER)


@query(f"WITH {PTS}, s AS (SELECT frame_id, yaw_id, avg(abs(x * cos(yaw_id * 0.7853981633974483) + y * sin(yaw_id * 0.7853981633974483))) AS score FROM pts, (SELECT unnest(range(8)) AS yaw_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY round(score, 9), yaw_id) AS rank FROM s) SELECT frame_id, yaw_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 2")
def topk_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    yaw = F.col("yaw_id") * 0.7853981633974483
    seeds = spark.range(8).select(F.col("id").alias("yaw_id"))
    scores = pts(spark, sf_dir).crossJoin(F.broadcast(seeds)).groupBy("frame_id", "yaw_id").agg(F.avg(F.abs(F.col("x") * F.cos(yaw) + F.col("y") * F.sin(yaw))).alias("score"))
    return G.top_seeds(scores, "frame_id", [F.round("score", 9), F.col("yaw_id")], 2).select("frame_id", "yaw_id", "rank", F.round("score", 6).alias("score"))
