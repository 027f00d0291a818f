"""Order-dependent operators on tracks: edges, lengths, gaps, folds and buffers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointloom.operators.quantiles import exact_quantiles


def _keys(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def polyline(rows: DataFrame, by: str, order: Sequence[str], ends: dict[str, str]) -> DataFrame:
    """Edges from each row to the next of its track: columns `ends` hold the next row's values."""
    w = W.partitionBy(by).orderBy(*order)
    out = rows.withColumns({new: F.lead(old).over(w) for old, new in ends.items()})
    return out.filter(F.col(next(iter(ends.values()))).isNotNull())


def in_runs(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with `run`: consecutive numbers of ranges of (by, order) that hold about equally many rows, however many a group has."""
    return rows.repartitionByRange(*by, *order).withColumn("run", F.spark_partition_id())


def path_length(rows: DataFrame, by: str | list[str], order: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Length of each track's path in the plane; 0 for a single row.

    A track is cut into runs of its rows; each run's steps are summed where it lies, and the steps from run to run are added from
    their first and last rows alone, so that a track of any length is summed in many tasks.
    """
    keys = _keys(by)
    points = in_runs(rows.select(*keys, *order, F.col(x).alias("x"), F.col(y).alias("y")), keys, order)
    step = lambda w: F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    inside = points.withColumn("step", step(W.partitionBy(*keys, "run").orderBy(*order)))
    at = F.struct(*order)
    place = F.struct(*order, "x", "y")
    runs = inside.groupBy(*keys, "run").agg(F.sum("step").alias("length"), F.count(F.lit(1)).alias("rows"), F.min_by(place, at).alias("first"), F.max_by(place, at).alias("last"))
    w = W.partitionBy(*keys).orderBy("run")
    gap = lambda c: F.col(f"first.{c}") - F.lag(f"last.{c}").over(w)
    joined = runs.withColumn("length", F.col("length") + F.coalesce(F.hypot(gap("x"), gap("y")), F.lit(0.0)))
    return joined.groupBy(*keys).agg(F.sum("length").alias("length"), F.sum("rows").alias("rows"))


def frame_dt(rows: DataFrame, by: str, order: Sequence[str], seconds: Column, first: float = 0.1, least: float = 0.01) -> DataFrame:
    """dt since the previous row of the track, at least `least`; `first` where there is none."""
    gap = seconds - F.lag(seconds).over(W.partitionBy(by).orderBy(*order))
    return rows.withColumn("dt", F.coalesce(F.greatest(F.lit(least), gap), F.lit(first)))


def last_frames(rows: DataFrame, by: str, order: Sequence[str], value: str, n: int) -> DataFrame:
    """The values of the last n rows up to each row, oldest first."""
    return rows.withColumn("buffer", F.collect_list(value).over(W.partitionBy(by).orderBy(*order).rowsBetween(1 - n, 0)))


def history_pairs(rows: DataFrame, by: str, order: Sequence[str], seconds: Column, reach_s: float, frames: int, least_s: float = 1e-4) -> DataFrame:
    """Each row with the earlier rows among its last `frames` (itself included) whose age lies in (least_s, reach_s].

    The interval join of a motion-compensated buffer: as its past is bounded by rank, it is a
    sliding window, not a join.
    """
    w = W.partitionBy(by).orderBy(*order)
    past = F.collect_list(F.struct(*order, seconds.alias("at"))).over(w.rowsBetween(1 - frames, -1))
    pairs = rows.withColumn("now", seconds).withColumn("past", past).select("*", F.explode("past").alias("p"))
    age = F.col("now") - F.col("p.at")
    return pairs.withColumn("tau", age).filter((F.col("tau") > least_s) & (F.col("tau") <= reach_s)).drop("past")


def clamped_fold(rows: DataFrame, by: str, order: Sequence[str], delta: Column, low: float, high: float) -> DataFrame:
    """Per track the value of a counter that starts at `low` and moves by delta within [low, high].

    Clamped additions compose: each is a map x -> min(b, max(a, x + c)), and so is one after another. A track is cut into runs of
    its rows; each run is composed to one map where it lies, and a track's maps are applied in order, so a track of any length is folded in many tasks.
    """
    keys = _keys(by)
    lo, hi = F.lit(float(low)), F.lit(float(high))
    clamp = lambda v: F.least(hi, F.greatest(lo, v))
    runs = in_runs(rows.select(*keys, *order, delta.cast("double").alias("delta")), keys, order)
    steps = F.sort_array(F.collect_list(F.struct(*order, "delta")))
    start = F.struct(F.lit(float("-inf")).alias("a"), F.lit(float("inf")).alias("b"), F.lit(0.0).alias("c"))
    after = lambda f, s: F.struct(clamp(f["a"] + s["delta"]).alias("a"), clamp(f["b"] + s["delta"]).alias("b"), (f["c"] + s["delta"]).alias("c"))
    maps = runs.groupBy(*keys, "run").agg(F.aggregate(steps, start, after).alias("map"), F.count(F.lit(1)).alias("rows"))
    ordered = F.sort_array(F.collect_list(F.struct("run", "map")))
    value = F.aggregate(ordered, lo, lambda x, r: F.least(r["map"]["b"], F.greatest(r["map"]["a"], x + r["map"]["c"])))
    return maps.groupBy(*keys).agg(value.alias("health"), F.sum("rows").alias("rows"))


def sessions(rows: DataFrame, by: str | list[str], order: Sequence[str], seconds: Column, gap_s: float) -> DataFrame:
    """Runs of rows with no gap over gap_s: session number, rows, first and last second."""
    w = W.partitionBy(by).orderBy(*order)
    opens = F.coalesce((seconds - F.lag(seconds).over(w) > gap_s).cast("int"), F.lit(1))
    numbered = rows.withColumn("at", seconds).withColumn("opens", opens).withColumn("session", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*([by] if isinstance(by, str) else by), "session").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first_s"), F.max("at").alias("last_s"))


def widest_gap(values: DataFrame, by: str, column: str, bins: float, least_gap: float, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """Centre of the widest run of empty bins between two percentiles; none under least_gap; the first of equals."""
    limits = exact_quantiles(values, [by], column, [low, high]).select(by, F.col("quantiles")[0].alias("lo"), F.col("quantiles")[1].alias("hi"))
    inside = values.join(limits, by).filter((F.col(column) >= F.col("lo")) & (F.col(column) <= F.col("hi")))
    filled = inside.select(by, "lo", F.floor((F.col(column) - F.col("lo")) / bins).cast("long").alias("bin")).distinct()
    w = W.partitionBy(by).orderBy("bin")
    gaps = filled.withColumn("next", F.lead("bin").over(w)).withColumn("width", (F.col("next") - F.col("bin") - 1) * bins).filter(F.col("width") >= least_gap)
    centre = F.col("lo") + (F.col("bin") + F.col("next") + 1) / 2 * bins
    best = F.max_by(F.struct(centre.alias("centre"), "width"), F.struct("width", (-F.col("bin")).alias("first"))).alias("best")
    return gaps.groupBy(by).agg(best).select(by, "best.centre", "best.width")


def histogram(values: DataFrame, column: str, low: float, width: float, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts of n bins from `low` on, empty ones included; the last bin is closed."""
    bin_of = F.least(F.floor((F.col(column) - low) / width), F.when(F.col(column) <= low + n * width, n - 1).otherwise(n)).cast("int")
    counted = values.withColumn("bin", bin_of).filter((F.col("bin") >= 0) & (F.col("bin") < n)).groupBy(*by, "bin").count()
    bins = values.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    frame = values.select(*by).distinct().crossJoin(F.broadcast(bins)) if by else bins
    return frame.join(counted, [*by, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
