"""Batch job: the diagnostics report of recorded sessions, by bag and day.

    python -m jobs.diagnostics_report --config jobs/diagnostics_report.json --input metrics/ --output report/

Reads metrics of frames (CSV files `<bag>_metrics.csv`, or any table whose columns the configuration maps), and writes one
row a bag and day to `report`: frames, latency (mean, exact percentiles, share in time), consistency of the filter, shares of
lifecycle states, runs of frames without a gap and the longest one, path length. `histogram` holds the counts of
latencies behind the plots. Both are partitioned by bag; a rerun replaces the partitions of the bags it read with the
same rows and leaves others alone. The input is scanned by column for each report, not copied.
Rows without a time belong to no day and get a row with a null day; rows without a bag go to the null partition.
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import checked, counted, main, read_config
from pointloom.operators import diagnostics as G
from pointloom.operators import tracks as T
from pointloom.sources.tables import read_metrics

log = logging.getLogger("diagnostics_report")

#: `columns` are SQL expressions over the input; empty for CSV files of metrics, whose bag is their name and whose frames are seconds / frame_rate apart.
DEFAULTS: dict[str, Any] = {
    "columns": {},
    "frame_rate": 10.0,
    "real_time_ms": 100.0,
    "nis_limit": 7.814727903251179,
    "gap_s": 2.0,
    "bin_ms": 10.0,
    "bins": 20,
}
DIGITS = 6
_NEEDED = ("bag", "ts", "frame", "latency_total_ms", "nis", "fsm_state")
REPORT = (
    "day date, frames long, latency_mean double, latency_p50 double, latency_p95 double, latency_p99 double, real_time_pct double, nis_mean double, nis_p95 double, "
    "consistent_pct double, active_pct double, coasting_pct double, sessions long, longest_session_s double, path_m double, bag string"
)
HISTOGRAM = "bin int, count long, bag string"


def read_frames(spark: SparkSession, source: str, config: dict[str, Any]) -> DataFrame:
    """bag, day, ts, frame, at (seconds), latency_total_ms, nis, fsm_state, and x and y where they are mapped."""
    columns = config["columns"]
    if not columns:
        rows = read_metrics(spark, source).withColumn("ts", F.lit(None).cast("timestamp_ntz")).withColumn("at", F.col("frame") / config["frame_rate"])
    else:
        missing = set(_NEEDED) - set(columns)
        if missing:
            raise ValueError(f"columns are not mapped: {sorted(missing)}")
        rows = spark.read.parquet(source).select(*[F.expr(e).alias(c) for c, e in columns.items()]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        rows = rows.withColumn("at", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6)
    place = [F.col(c).cast("double").alias(c) if c in rows.columns else F.lit(0.0).alias(c) for c in ("x", "y")]
    return rows.select(F.col("bag").cast("string").alias("bag"), F.col("ts").cast("date").alias("day"), "ts", "frame", "at", "latency_total_ms", "nis", "fsm_state", *place)


def report(frames: DataFrame, config: dict[str, Any]) -> DataFrame:
    """One row a bag and day, in the columns of REPORT."""
    by, order = ["bag", "day"], ["at", "frame"]
    quality = G.latency_report(frames, by, config["real_time_ms"], DIGITS)
    runs = T.sessions(frames, by, order, F.col("at"), config["gap_s"])
    runs = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("sessions"), F.round(F.max(F.col("last_s") - F.col("first_s")), DIGITS).alias("longest_session_s"))
    paths = T.path_length(frames, by, order).select(*by, F.round("length", DIGITS).alias("path_m"))
    out = quality
    for other in (G.nis_report(frames, by, config["nis_limit"], DIGITS), G.fsm_report(frames, by, DIGITS), runs, paths):
        same = other.select(F.struct(*by).alias("key"), *[c for c in other.columns if c not in by])
        out = out.join(same, F.struct(*by).eqNullSafe(F.col("key"))).drop("key")  # null bags and days meet too
    return out.select(*[c.split()[0] for c in REPORT.split(", ")])


def run(spark: SparkSession, source: str, output: str, settings: dict[str, Any] | None = None) -> DataFrame:
    """Report on all frames of source; returns the written report, read back."""
    config = checked(DEFAULTS, settings or {})
    frames = read_frames(spark, source, config)
    tables = {
        "report": (report(frames, config), REPORT),
        "histogram": (T.histogram(frames.filter("bag IS NOT NULL"), "latency_total_ms", 0.0, config["bin_ms"], config["bins"], ["bag"]).select("bin", F.col("count").cast("long").alias("count"), "bag"), HISTOGRAM),
    }
    for name, (df, _) in tables.items():
        rows, wrote = counted(df, name)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bag").parquet(f"{output}/{name}")
        log.info("wrote %d rows to %s/%s", wrote.get["rows"], output, name)
    written = spark.read.schema(REPORT).parquet(f"{output}/report")
    log.info("the report at %s covers %d frames", output, written.agg(F.sum("frames")).first()[0] or 0)
    return written


if __name__ == "__main__":
    main(lambda spark, a: run(spark, a.input, a.output, read_config(spark, a.config, DEFAULTS)), "diagnostics-report", __doc__, "input", "output")
