"""Small helpers of the training-data operators; shared folders are those of the engine."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.operators.stage import discard, free_shuffles, is_hot, join_groups, shared_dir, written

__all__ = ["NOT_SPACE", "SPACE", "discard", "free_shuffles", "is_hot", "join_groups", "ranked_row", "row_rank", "shared_dir", "small_batches", "text_column", "written"]

#: ASCII white space, as the contracts of these operators name it.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def text_column(name: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def _ranks() -> Column:
    """2 ** 63, above all row numbers."""
    return F.lit(str(1 << 63)).cast("decimal(19,0)")


def row_rank(doc_id: Column, row: Column) -> Column:
    """A number that orders rows by doc_id (null last) and then by row, and tells them apart; `ranked_row` gives the row back."""
    ranks = _ranks()
    number = F.coalesce(doc_id.cast("decimal(19,0)"), ranks)
    return (number * ranks).cast("decimal(38,0)") + row.cast("decimal(19,0)")


def ranked_row(rank: Column) -> Column:
    """The row number in a rank."""
    return F.pmod(rank, _ranks()).cast("long")


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about max_bytes of the column (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(column)
        ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(col), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
        first = 0
        while first < n:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(ends.searchsorted(base + max_bytes, "right")))
            yield batch.slice(first, last - first)
            first = last
