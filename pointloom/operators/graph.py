"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.stage import discard, shared_dir, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", folder: str | None = None) -> DataFrame:
    """(node, component) for every node of the edges; a component is its smallest node.

    Each round links every node's larger neighbours to its smallest neighbour
    and then every node to the smallest of its smaller neighbours, until
    nothing changes, however long that takes (in practice rounds logarithmic in the longest path). Minima combine
    in every task before the shuffle, and a node with many edges is joined as a skewed
    key, never collected. Rounds are written to the shared folder, so lineage stays short, and
    replace each other there (in `folder`, if given). Null ends are ignored; a self-loop only names its node.
    """
    pairs = edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull())

    spark = edges.sparkSession
    folder = folder or shared_dir(spark, "components")
    found = written(pairs.distinct(), f"{folder}/edges")
    nodes = found.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    current = found.filter("u < v")
    state, k = None, 0
    while True:
        # Large star: from both ends, larger neighbours go to the least neighbour.
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select("v", "m").filter("v > m").select(F.col("m").alias("u"), "v").distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        small_least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(small_least, "v")
        small = joined.select(F.col("m").alias("u"), "v").unionByName(joined.select(F.col("m").alias("u"), F.col("u").alias("v"))).filter("u < v").distinct()
        current = written(small, f"{folder}/round-{k}")
        discard(spark, f"{folder}/round-{k - 1}")
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == state:
            break
        state, k = now, k + 1
    labels = current.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
