"""Reports on latency, filter consistency and lifecycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointloom.operators.quantiles import with_quantiles
from pointloom.operators.tracks import path_length


def share_pct(condition: Column) -> Column:
    """Percentage of rows that meet a condition."""
    return F.avg(condition.cast("double")) * 100


def _keys(by: str | list[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def latency_report(metrics: DataFrame, by: str | list[str], limit_ms: float = 100.0, digits: int = 4) -> DataFrame:
    """Frames, mean, exact percentiles and share of frames within the limit."""
    t, r = "latency_total_ms", lambda c: F.round(c, digits)
    means = metrics.groupBy(by).agg(F.count(F.lit(1)).alias("frames"), r(F.avg(t)).alias("latency_mean"), r(share_pct(F.col(t) <= limit_ms)).alias("real_time_pct"))
    names = {f"latency_p{round(q * 100)}": q for q in (0.5, 0.95, 0.99)}
    found = with_quantiles(means, metrics, _keys(by), t, names)
    return found.select(*_keys(by), "frames", "latency_mean", *[r(c).alias(c) for c in names], "real_time_pct")


def nis_report(metrics: DataFrame, by: str | list[str], limit: float, digits: int = 4) -> DataFrame:
    """Mean and 95th percentile of the normalised innovation, and the share within the chi-square limit."""
    r = lambda c: F.round(c, digits)
    means = metrics.groupBy(by).agg(r(F.avg("nis")).alias("nis_mean"), r(share_pct(F.col("nis") <= limit)).alias("consistent_pct"))
    found = with_quantiles(means, metrics, _keys(by), "nis", {"nis_p95": 0.95})
    return found.select(*_keys(by), "nis_mean", r("nis_p95").alias("nis_p95"), "consistent_pct")


def fsm_report(metrics: DataFrame, by: str | list[str], digits: int = 4) -> DataFrame:
    """Shares of frames in the active (2) and coasting (3) states."""
    r = lambda c: F.round(c, digits)
    return metrics.groupBy(by).agg(r(share_pct(F.col("fsm_state") == 2)).alias("active_pct"), r(share_pct(F.col("fsm_state") == 3)).alias("coasting_pct"))


def bag_summary(metrics: DataFrame, tracks: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """Metrics and path length per bag; a side that a bag lacks counts as 0."""
    left = metrics.groupBy(by).agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("latency_total_ms"), 4).alias("latency_mean"))
    right = path_length(tracks, by, order).select(by, F.round("length", 4).alias("path_m"))
    return left.join(right, by, "full_outer").select(by, F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("latency_mean", F.lit(0.0)).alias("latency_mean"), F.coalesce("path_m", F.lit(0.0)).alias("path_m"))


def top_seeds(scores: DataFrame, by: str, order: Sequence[Column], k: int) -> DataFrame:
    """The k rows of least score per group, with their rank."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def console_table(report: DataFrame, width: int = 20) -> DataFrame:
    """One text line a row, padded for a console."""
    cells = [F.rpad(F.substring(F.col(c).cast("string"), 1, width), width, " ") if t == "string" else F.lpad(F.format_number(F.col(c).cast("double"), 2), 12, " ") for c, t in report.dtypes]
    return report.select(F.concat_ws(" | ", *cells).alias("line"))
