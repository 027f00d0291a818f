"""The runnable jobs as queries: each runs twice into one new folder, and the output is read back; with DuckDB SQL."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from jobs import background_map, diagnostics_report
from pointloom.operators.stage import shared_dir
from pointloom.plans.registry import query
from pointloom.plans.track_queries import NIS_LIMIT, SECONDS_SQL
from pointloom.plans.views import METRICS

_JOBS = Path(diagnostics_report.__file__).parent


def _settings(name: str) -> dict:
    """The settings that lie beside a job; they map the columns of the given tables."""
    return json.loads((_JOBS / f"{name}.json").read_text())


@query(
    f"""WITH {METRICS.replace(" FROM events)", ", CAST(ts AS DATE) AS day, value AS x, CAST(event_id % 100 AS DOUBLE) AS y FROM events)")},
    q AS (SELECT bag, day, count(*) AS frames, round(avg(latency_total_ms), 6) AS latency_mean, round(quantile_cont(latency_total_ms, 0.5), 6) AS latency_p50,
          round(quantile_cont(latency_total_ms, 0.95), 6) AS latency_p95, round(quantile_cont(latency_total_ms, 0.99), 6) AS latency_p99,
          round(avg(CAST(latency_total_ms <= 100 AS DOUBLE)) * 100, 6) AS real_time_pct, round(avg(nis), 6) AS nis_mean, round(quantile_cont(nis, 0.95), 6) AS nis_p95,
          round(avg(CAST(nis <= {NIS_LIMIT} AS DOUBLE)) * 100, 6) AS consistent_pct, round(avg(CAST(fsm_state = 2 AS DOUBLE)) * 100, 6) AS active_pct,
          round(avg(CAST(fsm_state = 3 AS DOUBLE)) * 100, 6) AS coasting_pct FROM metrics GROUP BY bag, day),
    l AS (SELECT bag, day, {SECONDS_SQL} AS s, ts, event_id, coalesce(CAST({SECONDS_SQL} - lag({SECONDS_SQL}) OVER w > 2 AS BIGINT), 1) AS opens,
          sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM metrics WINDOW w AS (PARTITION BY bag, day ORDER BY ts, event_id)),
    n AS (SELECT *, sum(opens) OVER (PARTITION BY bag, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM l),
    r AS (SELECT bag, day, session, max(s) - min(s) AS lasts FROM n GROUP BY bag, day, session),
    s AS (SELECT bag, day, count(*) AS sessions, round(max(lasts), 6) AS longest_session_s FROM r GROUP BY bag, day),
    p AS (SELECT bag, day, round(sum(coalesce(step, 0)), 6) AS path_m FROM l GROUP BY bag, day)
    SELECT * FROM q JOIN s USING (bag, day) JOIN p USING (bag, day)"""
)
def job1_diagnostics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, settings = shared_dir(spark, "job1"), _settings("diagnostics_report")
    for _ in range(2):
        out = diagnostics_report.run(spark, f"{sf_dir}/events.parquet", f"{folder}/out", settings)
    return out


@query(
    """WITH p AS (SELECT l_suppkey AS frame_id, l_quantity / 10 AS x, l_extendedprice / 20000 AS y, l_tax * 10 AS z, l_discount * 1000 AS intensity FROM lineitem),
    k AS (SELECT *, CAST(floor(x / 0.25) AS BIGINT) AS ix, CAST(floor(y / 0.25) AS BIGINT) AS iy, CAST(floor(z / 0.25) AS BIGINT) AS iz FROM p WHERE sqrt(x * x + y * y) >= 0.35),
    s AS (SELECT ix, iy, iz, count(*) AS n, CAST(sum(CAST(floor(x * 1e6 + 0.5) AS BIGINT)) AS BIGINT) AS sx, CAST(sum(CAST(floor(y * 1e6 + 0.5) AS BIGINT)) AS BIGINT) AS sy,
          CAST(sum(CAST(floor(z * 1e6 + 0.5) AS BIGINT)) AS BIGINT) AS sz, CAST(sum(CAST(floor(intensity * 1e6 + 0.5) AS BIGINT)) AS BIGINT) AS si,
          min(frame_id) AS first_frame, max(frame_id) AS last_frame FROM k GROUP BY ix, iy, iz)
    SELECT ix, iy, iz, n, sx / 1e6::DOUBLE / n AS x, sy / 1e6::DOUBLE / n AS y, sz / 1e6::DOUBLE / n AS z, si / 1e6::DOUBLE / n AS intensity, first_frame, last_frame,
           CAST(CASE WHEN abs(sz / 1e6::DOUBLE / n - 0.1) <= 1.5 * 0.1 THEN 0 WHEN n >= 3 THEN 1 ELSE 2 END AS INTEGER) AS label,
           CAST(CAST(floor(ix / 4) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(iy / 4) AS BIGINT) AS VARCHAR) AS tile FROM s"""
)
def job2_background_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A stream takes a pattern where the table may be one file or a folder of files.
    folder, settings = shared_dir(spark, "job2"), _settings("background_map")
    for _ in range(2):
        out = background_map.run(spark, f"{sf_dir}/lineitem.parquet*", f"{folder}/out", f"{folder}/checkpoint", settings)
    return out
