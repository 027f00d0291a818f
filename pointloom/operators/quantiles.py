"""Exact quantiles of groups of any size, by counts of values and histograms that are refined where a quantile lies.

Equal values are counted together first, in every task before the shuffle and then dealt by group and value, so a group that holds
most rows is spread over all tasks. A group of few different values is ranked by a running sum. In a larger one the
interval of each wanted rank is cut into BUCKETS equal parts, the part in which the rank lies is found from their counts, and
only that is cut again, until it holds FEW values. Quantiles lie linearly between the two values at their rank, as `percentile` has them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointloom.operators.stage import staged

FEW = 1 << 16  # different values that one task puts in order
BUCKETS = 1 << 10


def _same(keys: Sequence[str], prefix: str) -> Column:
    return F.struct(*[F.col(k) for k in keys]).eqNullSafe(F.struct(*[F.col(f"{prefix}{k}") for k in keys]))


def _renamed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{prefix}{k}" for k in keys})


def _refined(counts: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """ranks (by, rank, low, high, below) whose interval holds more than FEW values, with narrower intervals."""
    key = [*by, "low", "high"]
    spans = _renamed(ranks.select(*key).distinct(), by, "_")
    inside = counts.join(spans, _same(by, "_") & F.col("v").between(F.col("low"), F.col("high"))).drop(*[f"_{k}" for k in by])
    bucket = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    parts = inside.groupBy(*key, bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"), F.min("v").alias("first"), F.max("v").alias("last"))
    before = F.sum("n").over(W.partitionBy(*key).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    parts = _renamed(parts.withColumn("before", before), key, "_")
    met = ranks.join(parts, _same(key, "_"))
    place = F.col("rank") - F.col("below")
    return met.filter((place >= F.col("before")) & (place < F.col("before") + F.col("n"))).select(*by, "rank", F.col("first").alias("low"), F.col("last").alias("high"), (F.col("below") + F.col("before")).alias("below"), F.col("values"))


def exact_quantiles(rows: DataFrame, by: Sequence[str], column: str, probs: Sequence[float], few: int = FEW) -> DataFrame:
    """by and the array `quantiles` of each group, in the order of probs; nulls don't count, and a group of nulls alone has no row."""
    by = list(by)
    counts = staged(rows.select(*by, F.col(column).cast("double").alias("v")).filter("v IS NOT NULL").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n")), "quantiles")
    groups = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for i, p in enumerate(probs)])).alias("p")
    wanted = groups.select(*by, "values", "low", "high", place)
    wanted = wanted.select(*by, "values", "low", "high", "p.i", "p.at", F.explode(F.array_distinct(F.array(F.floor("p.at"), F.ceil("p.at")))).alias("rank"))
    ranks = staged(wanted.select(*by, "rank", "low", "high", F.lit(0).cast("long").alias("below"), "values").distinct(), "quantiles")
    while not (large := ranks.filter(F.col("values") > few)).isEmpty():
        ranks = staged(_refined(counts, large.drop("values"), by).unionByName(ranks.filter(F.col("values") <= few)), "quantiles")

    key = [*by, "low", "high"]
    spans = _renamed(ranks.select(*key).distinct(), by, "_")
    inside = counts.join(spans, _same(by, "_") & F.col("v").between(F.col("low"), F.col("high"))).drop(*[f"_{k}" for k in by])
    upto = F.sum("n").over(W.partitionBy(*key).orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    placed = _renamed(inside.withColumn("upto", upto), key, "_")
    at = F.col("rank") - F.col("below")
    found = ranks.join(placed, _same(key, "_")).filter((at >= F.col("upto") - F.col("n")) & (at < F.col("upto"))).select(*by, "rank", "v")
    ends = _renamed(found, [*by, "rank"], "_")
    met = wanted.select(*by, "i", "at", "rank").join(ends, _same([*by, "rank"], "_"))
    between = (F.ceil("at") - F.col("at")) * F.min("v") + (F.col("at") - F.floor("at")) * F.max("v")
    each = met.groupBy(*by, "i", "at").agg(F.when(F.floor("at") == F.ceil("at"), F.min("v")).otherwise(between).alias("q"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("quantiles"))


def with_quantiles(table: DataFrame, rows: DataFrame, by: Sequence[str], column: str, probs: dict[str, float]) -> DataFrame:
    """table (one row a group) with a column for each named quantile of the group's rows; null where the group has no value."""
    found = _renamed(exact_quantiles(rows, by, column, list(probs.values())), list(by), "_q_")
    met = table.join(found, _same(list(by), "_q_"), "left").drop(*[f"_q_{k}" for k in by])
    return met.withColumns({name: F.col("quantiles")[i] for i, name in enumerate(probs)}).drop("quantiles")
