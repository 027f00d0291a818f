"""Mixing sources to target weights by nested hash thresholds.

A document's size is its number of words. Sources share `share` of all sizes by
weights that repeat in code point order (null last); a target stops at `cap` times
its source's size and the excess is shared again, which is the level at which
min(cap * size, level * weight) sums to the budget.

A source takes every document floor(target / size) times and, once more, those
whose hash of doc_id and text lies below a threshold. The threshold comes from histograms: sizes are summed by
source and hash bucket, the bucket in which the budget runs out is
found, and only that bucket is summed again by the next bits, until it holds
one hash. Where that hash holds several rows, which are copies with one doc_id, the same is done once more with a hash of their row numbers. Nothing is sorted by hash, and smaller budgets take subsets of what
larger ones take. Sums combine in every task before the shuffle, so a source
that holds most rows is no hot key.

Defined cases: null text has size 0; a null source is a source of its own; rows that share a doc_id, or have none, are told
apart by their text; of equal rows as many are taken as come nearest to the target, and which of them does not matter, as they
are equal; equal prefixes go on to finer bits; a very long text is one row that is taken whole or not; an empty table gives no rows;
other input columns are ignored. The last row is taken if that ends nearer to the target.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointloom.llm.shared import NOT_SPACE, SPACE, discard, shared_dir, text_column, written

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
HASH_BITS, STEP_BITS = 60, 12
SMALL_SOURCES = 10_000  # tables of one row a source are broadcast up to so many rows


def word_count(text: Column) -> Column:
    """How many maximal runs of bytes other than ASCII white space a text has."""
    return F.length(F.regexp_replace(text, f"{SPACE}*{NOT_SPACE}+{SPACE}*", "x")) * F.when(F.length(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))) > 0, 1).otherwise(0)


def _bits(text: Column) -> Column:
    """A fixed pseudo-random number of HASH_BITS bits."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def hash_cell(doc_id: Column, text: Column) -> Column:
    """A number of HASH_BITS bits for a doc_id and its text."""
    return _bits(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size -> also target; one row a source, so a window over all of them is small."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), number + 1)
    rows = sources.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, every = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    rows = rows.withColumn("level", (share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The first source, by ratio, that its share does not fill sets the level of all after it.
    rows = rows.withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level")))
    level = F.min(F.when(F.col("open").isNotNull(), F.struct((F.col("most") / F.col("weight")).alias("r"), F.col("open").alias("level")))).over(every)["level"]
    return rows.withColumn("target", F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most")))).select("source", "source_size", "target")


def _with_sources(rows: DataFrame, sources: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    other = sources.withColumnRenamed("source", "source_of")
    return rows.join(F.broadcast(other) if few else other, F.col("source").eqNullSafe(F.col("source_of")), how).drop("source_of")


def thresholds(sizes: DataFrame, aims: DataFrame, folder: str, few: bool) -> DataFrame:
    """source, cell, below, rest, rows: the cell at which a source's budget runs out, the sizes under it, what is left of the budget, and the rows of that cell.

    sizes: source, size, cell. aims: source, budget. Each round sums only the documents in
    the bucket where the budget of their source runs out. A source whose budget does not run out has no row.
    """
    state = aims.filter("budget > 0").select("source", "budget", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("below"))
    found = []
    for used in range(0, HASH_BITS, STEP_BITS):
        rest = HASH_BITS - used
        inside = _with_sources(sizes.filter("size > 0"), state, few).filter(F.shiftright("cell", rest) == F.col("bucket"))
        fine = F.shiftright("cell", rest - STEP_BITS).alias("bucket")
        sums = inside.groupBy("source", "budget", "below", fine).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.min("cell").alias("first"), F.max("cell").alias("last"))
        w = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        crossed = sums.withColumn("upto", F.col("below") + F.sum("size").over(w)).filter("upto >= budget")
        edge = crossed.groupBy("source").agg(F.min_by(F.struct("budget", "bucket", (F.col("upto") - F.col("size")).alias("below"), "upto", "rows", "first", "last"), "bucket").alias("e")).select("source", "e.*")
        edge = written(edge, f"{folder}/edge-{used}")
        one = edge.filter(F.col("first") == F.col("last"))
        found.append(one.select("source", F.col("first").alias("cell"), "below", "upto", (F.col("budget") - F.col("below")).alias("rest"), "rows"))
        state = edge.filter(F.col("first") != F.col("last")).select("source", "budget", "bucket", "below")
        if state.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, found)


def _nearer() -> Column:
    """Whether taking the cell at the edge ends nearer to the budget than leaving it."""
    return F.col("upto") - F.col("below") - F.col("rest") < F.col("rest")


def _limits(sizes: DataFrame, aims: DataFrame, folder: str, few: bool) -> DataFrame:
    """source, cell, tie: a source takes its rows below the cell, and those of the cell whose tie lies below the tie."""
    edges = thresholds(sizes, aims, f"{folder}/cells", few)
    every = F.lit(1 << HASH_BITS)
    alone = edges.filter("rows = 1").select("source", "cell", F.when(_nearer(), every).otherwise(0).alias("tie"))
    tied = written(edges.filter("rows > 1").select("source", "cell", F.col("rest").alias("budget")), f"{folder}/tied")
    if tied.isEmpty():
        return alone
    copies = _with_sources(sizes.withColumnRenamed("cell", "of"), tied, few).filter("of = cell").select("source", "size", F.col("tie").alias("cell"))
    found = thresholds(copies, tied.select("source", "budget"), f"{folder}/ties", few)
    last = found.select(F.col("source").alias("in_source"), (F.col("cell") + _nearer().cast("long")).alias("tie"))
    split = tied.join(last, F.col("source").eqNullSafe(F.col("in_source")), "left").select("source", "cell", F.coalesce("tie", every).alias("tie"))
    return alone.unionByName(split)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, folder: str | None = None, row: str | None = None) -> DataFrame:
    """Per row: doc_id, size, source_size, target (its source's), taken (words the mix takes), copies, and row if that column is named."""
    folder = folder or shared_dir(docs.sparkSession, "mixing")
    own = [F.col(row).alias("row")] if row else []
    text = text_column().cast("string")
    sizes = docs.select(*own, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).cast("long").alias("size"), hash_cell(F.col("doc_id"), text).alias("cell"))
    # Row numbers are written with the rows, so that they stay.
    sizes = written(sizes.withColumn("tie", _bits(F.monotonically_increasing_id().cast("string"))), f"{folder}/sizes")
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = written(sources.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")), f"{folder}/sources")
    few = sources.count() <= SMALL_SOURCES
    limits = _limits(sizes, sources, folder, few).select("source", F.col("cell").alias("last_cell"), F.col("tie").alias("last_tie"))
    aims = _with_sources(sources, limits, few, "left").select("source", "source_size", "target", "passes", "last_cell", "last_tie")
    once = (F.col("cell") < F.col("last_cell")) | ((F.col("cell") == F.col("last_cell")) & (F.col("tie") < F.col("last_tie")))
    copies = F.col("passes") + F.coalesce(once.cast("long"), F.lit(0))
    found = _with_sources(sizes, aims, few).withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *(["row"] if row else []))
    result = written(found, f"{folder}/result")
    discard(docs.sparkSession, *[f"{folder}/{name}" for name in ("sizes", "sources", "cells", "ties", "tied")])
    return result


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS cell
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS most,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
             - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level FROM l WHERE level * weight <= most ORDER BY most / weight LIMIT 1),
t AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM f) * weight, most)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
b AS (SELECT *, target - passes * source_size AS budget FROM p),
c AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.passes, b.budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.cell RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.cell) AS here
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN budget > 0 AND (upto < budget OR (upto - here < budget AND upto - budget < budget - (upto - here))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
