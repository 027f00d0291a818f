"""The corpus pipeline: documents pass five stages, each written as Parquet and read again.

Every stage works on all rows its predecessor kept. The first four return the
columns of their input, whatever their names; packing, the last, returns the pieces of token windows.
Decisions are taken for rows, not for doc_ids: stages number the rows of their input in the shared folder, so
repeated, equal and null doc_ids are each decided by their own text.

Defined cases: null, empty and blank texts are not toxic, are equal to texts of the same normalised form, are no near-duplicates, and
have size 0 in the mix, which takes no word of them but may keep them; a null source is a source of its own; without labels
the fixed grammar decides; an empty table stays empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from pointloom.llm.shared import ranked_row, row_rank, shared_dir, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the grammar does not reject; labels are learned from where they exist."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """`row` (all columns of docs as a struct) and `at`, its number, written so that the number stays with the row."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at"))
    return written(rows, shared_dir(docs.sparkSession, name))


def _named(rows: DataFrame, *columns: str) -> DataFrame:
    """at and some columns of the rows."""
    return rows.select("at", *[F.col(f"row.`{c}`").alias(c) for c in columns])


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the smallest doc_id."""
    rows = _numbered(docs, "exact-rows")
    kept = exact_dedup.exact_duplicates(_named(rows, "doc_id", "text"), row="at").filter("kept").select(F.col("row").alias("at"))
    return _unpacked(rows.join(kept, "at", "left_semi"), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id."""
    rows = _numbered(docs, "near-rows")
    groups = near_dedup.near_duplicates(_named(rows, "doc_id", "text"), row="at").select(F.col("row").alias("at"), "component")
    ranked = _named(rows, "doc_id").select("at", row_rank(F.col("doc_id").cast("long"), F.col("at")).alias("rank"))
    kept = groups.join(ranked, "at").groupBy("component").agg(F.min("rank").alias("rank")).select(ranked_row(F.col("rank")).alias("at"))
    return _unpacked(rows.join(kept, "at", "left_semi"), docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them."""
    rows = _numbered(docs, "mixing-rows")
    copies = mixing.mix(_named(rows, "doc_id", "text", "source"), row="at").filter("copies > 0").select(F.col("row").alias("at"), "copies")
    taken = rows.join(copies, "at").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return _unpacked(taken, docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows over all documents of the mix."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the learned grammar, the tokenizer or the packing; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of sf_dir."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
