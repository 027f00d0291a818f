"""Exact deduplication over an extendible-hash index on shared files.

1. Texts are normalised (white-space runs become one space), keyed by the top
   `key_bits` bits of XXH64 and written with a row number to the shared folder.
2. The directory starts with one bucket and doubles whenever a bucket over
   `bucket_texts` keys has the directory's depth; it is built from a histogram of the prefixes of
   distinct keys, never from keys. Its size is bounded by 2 ** MAX_DEPTH, so it may be broadcast.
3. The directory deals every row to its bucket's owner task. An owner holds its buckets' whole key
   ranges: it groups their rows by the bytes of the text, so that colliding texts of a
   key stay apart, orders them as the key's chain, and writes its buckets as a file of the index. Rows of keys over a
   thousandth of all rows (a thousand keys at most, by counting) are combined by bytes in the scan tasks before
   they are dealt, so a group that holds a third of all rows arrives as one row.
4. Documents probe the index through the directory: by bucket, key and SHA-256. Groups over a thousandth of all
   rows are probed by broadcast, others by a join.

All steps are DataFrame operations. Defined cases: null text is the empty text;
of each group exactly one row stays, the one with the smallest doc_id (null last; of rows that share it, the first
written); keep_id is null where all doc_ids of a group are; an empty table gives no rows; other input columns are
ignored. The table with the texts is deleted from the shared folder once the result is written there.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointloom.llm.shared import SPACE, discard, is_hot, join_groups, row_rank, shared_dir, text_column, written

MAX_DEPTH = 18
BUCKET_TEXTS = 1 << 8


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space."""
    return F.regexp_replace(text, f"{SPACE}+", " ")


def build_directory(histogram: dict[int, int], bits: int, capacity: int) -> tuple[int, list[int], list[tuple[int, int, int]]]:
    """(global depth, bucket number by prefix, buckets as (prefix, local depth, texts)).

    `histogram` counts texts by the top `bits` bits of their keys. Overfull
    buckets split by their next bit; a split at global depth doubles the directory first.
    """
    below = [[0] * (1 << d) for d in range(bits + 1)]
    for prefix, n in histogram.items():
        for d in range(bits + 1):
            below[d][prefix >> (bits - d)] += n
    depth, directory, buckets = 0, [0], [(0, 0, below[0][0])]
    waiting = [0]
    while waiting:
        b = waiting.pop()
        prefix, local, n = buckets[b]
        if n <= capacity or local == bits:
            continue
        if local == depth:
            depth, directory = depth + 1, [x for x in directory for _ in (0, 1)]
        low, high = prefix << 1, prefix << 1 | 1
        buckets[b] = (low, local + 1, below[local + 1][low])
        buckets.append((high, local + 1, below[local + 1][high]))
        span = 1 << (depth - local - 1)
        directory[high * span : (high + 1) * span] = [len(buckets) - 1] * span
        waiting += [b, len(buckets) - 1]
    return depth, directory, buckets


def tagged_rows(docs: DataFrame, folder: str, key_bits: int = 64, row: str | None = None) -> DataFrame:
    """row, doc_id, rank, key, sha256 and body of every row; rows are numbered unless a column `row` numbers them."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    texts = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), normalised(text_column().cast("string")).alias("body"))
    key = F.shiftrightunsigned(F.xxhash64("body"), 64 - key_bits)
    return written(texts.select("row", "doc_id", row_rank(F.col("doc_id"), F.col("row")).alias("rank"), key.alias("key"), F.sha2("body", 256).alias("sha256"), "body"), f"{folder}/rows")


def build_index(rows: DataFrame, folder: str, key_bits: int = 64, bucket_texts: int = BUCKET_TEXTS) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(index, a function that adds each key's bucket). The index: bucket, key, chain, sha256, rank and keep_id of the row that stays, group_size."""
    spark = rows.sparkSession
    keys = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("times")), f"{folder}/keys")
    total = keys.count()
    capacity = max(bucket_texts, total >> (MAX_DEPTH - 2))
    bits = min(MAX_DEPTH, key_bits, 3 + max(0, math.ceil(math.log2(max(1, total) / capacity))))
    prefix = F.shiftrightunsigned("key", key_bits - bits).cast("int")
    histogram = {r[0]: r[1] for r in keys.groupBy(prefix.alias("prefix")).count().collect()}  # 2 ** MAX_DEPTH rows at most
    depth, directory, _ = build_directory(histogram, bits, capacity)
    slots = F.broadcast(spark.createDataFrame(list(enumerate(directory)), "slot int, bucket int"))

    def in_buckets(df: DataFrame) -> DataFrame:
        slot = F.shiftrightunsigned("key", key_bits - depth).cast("int") if depth else F.lit(0)
        return df.withColumn("slot", slot).join(slots, "slot").drop("slot")

    hot = is_hot(keys, ["key"], "times")
    cold = rows if hot is None else rows.filter(~hot)
    dealt = cold.select("key", "body", "rank", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    if hot is not None:
        dealt = dealt.unionByName(rows.filter(hot).groupBy("key", "body").agg(F.min("rank").alias("rank"), F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    owned = in_buckets(dealt).repartition("bucket")
    chained = owned.groupBy("bucket", "key", "body").agg(F.min("rank").alias("rank"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    slim = chained.select("bucket", "key", F.sha2("body", 256).alias("sha256"), "rank", "keep_id", "group_size")
    index = slim.withColumn("chain", F.row_number().over(W.partitionBy("bucket", "key").orderBy("sha256")))
    return written(index, f"{folder}/index"), in_buckets


def probe(entries: DataFrame, index: DataFrame) -> DataFrame:
    """All entries (with their bucket) with the rank and doc_id of the row that stays and the size of their group."""
    groups = index.select("bucket", "key", "sha256", F.col("rank").alias("keep_rank"), "keep_id", "group_size")
    return join_groups(entries, groups, ["bucket", "key", "sha256"], "group_size")


def exact_duplicates(docs: DataFrame, folder: str | None = None, key_bits: int = 64, bucket_texts: int = BUCKET_TEXTS, row: str | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text), and row if that column is named."""
    folder = folder or shared_dir(docs.sparkSession, "exact-dedup")
    rows = tagged_rows(docs, folder, key_bits, row)
    index, in_buckets = build_index(rows, folder, key_bits, bucket_texts)
    found = probe(in_buckets(rows.select("row", "doc_id", "rank", "key", "sha256")), index)
    columns = ["doc_id", "keep_id", "group_size", (F.col("rank") == F.col("keep_rank")).alias("kept"), F.col("sha256").alias("text_sha256")]
    result = written(found.select(*columns, *(["row"] if row else [])), f"{folder}/result")
    discard(docs.sparkSession, f"{folder}/rows", f"{folder}/keys")
    return result


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g USING (body)
"""
