r"""Ranked lexical search over a two-level quantised index.

Building reads all texts twice: once to count terms, once to write the index in blocks of at most BLOCK_DOCS documents
and about BLOCK_BYTES of text. For each term of a block the index holds the positions of its documents, and

* level one, a byte a posting: its impact (1000000000 * tf) div (1000 * tf + 20 * m), which is under 1000000, in steps of
  STEP and rounded upwards, so that byte * STEP bounds the impact from above and (byte - 1) * STEP + 1 from below;
* level two: tf as it is; doc_ids and m stand in one row a block.

Levels are columns of one Parquet table, so a search reads level one of the query terms, and level two only where it must:

1. In each block and chunk of items, upper and lower bounds of all scores are summed from bytes and weights. The
   block's k-th largest lower bound is at most that of all documents, so documents whose upper bound lies under it are out;
   those with equal bounds are one row, however many they are.
2. The k-th largest lower bound over all blocks decides: every document whose upper bound reaches it, and no other, is scored
   exactly from level two, in its block. A block returns its k best an item, and the best k of all blocks are the result.

Nothing is capped: ties, copies and frequent terms only make more documents reach the bound, and they are scored inside
their block without a row each. Items are dealt in chunks of about CHUNK_ITEMS and joined with the index by term;
whether a side is small enough to be broadcast is left to Spark, which knows the tables' sizes. No key is hot, because a frequent term
has one row a block.

Defined cases: null texts and texts without terms match nothing and do not count; a row is a document, so rows with equal
doc_ids are ranked one by one and a null doc_id comes after others of equal score; items that repeat are ranked one by one; an item
without known terms, or only with terms of weight 0, has no rows; a long text is a block of its own; empty tables give no rows;
other input columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointloom.llm.shared import discard, shared_dir, small_batches, written

TOP = 50
STEP = 3922  # 255 steps cover all impacts
BLOCK_DOCS, BLOCK_BYTES = 4096, 4 << 20
CHUNK_ITEMS = 256
LATE = np.iinfo(np.int64).max  # in place of a null doc_id, for ordering

_INDEX = "block long, term string, n_docs int, docs binary, impacts binary, tfs binary, ids array<long>, ms array<long>"


@functools.cache
def _letters() -> bytes:
    """For each byte what it becomes in terms: ASCII letters in lower case, digits and all bytes beyond ASCII as they are, a space otherwise."""
    keep = lambda c: c >= 0x80 or chr(c).isalnum()
    return bytes(ord(chr(c).lower()) if c < 0x80 and keep(c) else c if keep(c) else 0x20 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_letters()).split() if text else []


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


@dataclass(frozen=True)
class Index:
    """A written index: its table, the documents with terms (N) and all their terms (L)."""

    table: DataFrame
    documents: int
    terms: int
    folder: str


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def corpus_counts(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            n = [len(terms(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], names=["documents", "terms"])

    found = _texts(docs).select("text").mapInArrow(count, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


class _Numbers(dict):
    """A number for each new term."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def _pieces(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The runs of an array, which begin at starts, as binary values."""
    offsets = np.append(starts, len(values)).astype(np.int64) * values.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _block(number: int, ids: list[int | None], words: list[list[bytes]], documents: int, total: int) -> pa.RecordBatch:
    """The rows of one block: one for its documents, and one a term."""
    vocabulary = _Numbers()
    sizes = np.array([len(w) for w in words], np.int64)
    of = np.fromiter((vocabulary[t] for w in words for t in w), np.int64, int(sizes.sum()))
    pairs, tf = np.unique(of << 16 | np.repeat(np.arange(len(words)), sizes), return_counts=True)
    doc, term = pairs & 0xFFFF, pairs >> 16
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    ms = np.array([50 + 50 * n * documents // total for n in sizes.tolist()], np.int64)
    impacts = -(-impact(tf, ms[doc]) // STEP)
    n = len(starts)
    none = pa.array([None], pa.binary())
    columns = [
        pa.array([number] * (n + 1), pa.int64()),
        pa.array([None, *(t.decode() for t in vocabulary)], pa.string()),
        pa.array([len(ids), *np.diff(np.append(starts, len(tf))).tolist()], pa.int32()),
        *(pa.concat_arrays([none, _pieces(v, starts)]) for v in (doc.astype("<u2"), impacts.astype(np.uint8), tf.astype("<u4"))),
        *(pa.array([v, *[None] * n], pa.list_(pa.int64())) for v in (ids, ms.tolist())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["block", "term", "n_docs", "docs", "impacts", "tfs", "ids", "ms"])


def build_index(docs: DataFrame, folder: str | None = None) -> Index:
    """Count and write the index of all rows of docs."""
    folder = folder or shared_dir(docs.sparkSession, "lexical-index")
    documents, total = corpus_counts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, words, size = [], [], 0
        for batch in small_batches(batches, max_bytes=1 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = terms(text)
                if not found:
                    continue
                if ids and (len(ids) == BLOCK_DOCS or size + len(text) > BLOCK_BYTES):
                    yield _block(number, ids, words, documents, total)
                    number, ids, words, size = number + 1, [], [], 0
                ids.append(doc_id)
                words.append(found)
                size += len(text)
        if ids:
            yield _block(number, ids, words, documents, total)

    return Index(written(_texts(docs).mapInArrow(run, _INDEX), f"{folder}/index", compression="zstd"), documents, total, folder)


def query_terms(index: Index, items: DataFrame, folder: str) -> DataFrame:
    """chunk, term, items (their numbers) and weight of every term of the items that the corpus knows; item numbers and ids are in `folder`/items."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [[t.decode() for t in dict.fromkeys(terms(t))] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(found, pa.list_(pa.string()))], names=["item", "item_id", "terms"])

    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    named = written(numbered.mapInArrow(split, "item long, item_id long, terms array<string>"), f"{folder}/items")
    chunks = max(1, -(-named.count() // CHUNK_ITEMS))
    asked = named.select("item", F.explode("terms").alias("term"))
    wanted = asked.select("term").distinct()
    df = index.table.select("term", "n_docs").join(wanted, "term").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.documents) + 2) / (2 * F.col("df") + 1)))
    weights = df.select("term", weight.cast("long").alias("weight")).filter("weight > 0")
    by_chunk = asked.groupBy(F.pmod(F.xxhash64("item"), F.lit(chunks)).alias("chunk"), "term").agg(F.collect_list("item").alias("items"))
    return written(by_chunk.join(weights, "term"), f"{folder}/query-terms")


def _sums(table: pa.Table, columns: list[str], n_docs: int, value) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Items of a (chunk, block), and for each its documents' summed value and weight; rows are terms with their items, weight and documents."""
    lists = table.column("items").to_pylist()
    names = sorted({i for items in lists for i in items})
    at = {i: k for k, i in enumerate(names)}
    total, present = np.zeros((len(names), n_docs), np.int64), np.zeros((len(names), n_docs), np.int64)
    for items, weight, docs, *rest in zip(lists, *(table.column(c).to_pylist() for c in ["weight", "docs", *columns]), strict=True):
        docs = np.frombuffer(docs, "<u2")
        cells = np.ix_([at[i] for i in items], docs)
        total[cells] += weight * value(docs, *rest)
        present[cells] += weight
    return names, total, present


def _bounds(table: pa.Table, k: int) -> pa.Table:
    """item, upper, lower, docs of the documents of one block whose upper bound reaches the block's k-th lower bound; equal bounds are one row."""
    docs = [np.frombuffer(d, "<u2") for d in table.column("docs").to_pylist()]
    names, total, present = _sums(table, ["impacts"], 1 + max(int(d[-1]) for d in docs), lambda _, q: np.frombuffer(q, np.uint8).astype(np.int64))
    upper, out = STEP * total, []
    lower = upper - (STEP - 1) * present
    for i, item in enumerate(names):
        found = np.flatnonzero(present[i])
        if len(found) > k:
            low = lower[i, found]
            found = found[upper[i, found] >= np.partition(low, len(low) - k)[len(low) - k]]
        order = found[np.lexsort((found, lower[i, found], upper[i, found]))]
        new = np.flatnonzero((np.diff(upper[i, order], prepend=-1) != 0) | (np.diff(lower[i, order], prepend=-1) != 0))
        for part in np.split(order, new[1:]):
            out.append((item, int(upper[i, part[0]]), int(lower[i, part[0]]), len(part), part.astype("<u2").tobytes()))
    chunk, block = (table.column(c)[0].as_py() for c in ("chunk", "block"))
    cols = list(zip(*out, strict=True)) or [()] * 5
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array([chunk] * len(out), pa.int64()), pa.array([block] * len(out), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["chunk", "block", "item", "upper", "lower", "n_docs", "docs"])


def _exact(wanted: pa.Table, found: pa.Table, k: int) -> pa.Table:
    """item, doc_id, score: the k best of a block's wanted documents for each item, scored from level two."""
    scores: list[tuple[int, int | None, int]] = []
    header = found.filter(pa.compute.is_null(found.column("term")))
    if wanted.num_rows and header.num_rows:
        ids = header.column("ids")[0].values
        order = ids.fill_null(int(LATE)).to_numpy(zero_copy_only=False)
        ids, ms = ids.to_pylist(), np.array(header.column("ms")[0].as_py(), np.int64)
        rows = found.filter(pa.compute.is_valid(found.column("term")))
        names, total, _ = _sums(rows, ["tfs"], len(ids), lambda docs, tf: impact(np.frombuffer(tf, "<u4").astype(np.int64), ms[docs]))
        at = {item: i for i, item in enumerate(names)}
        docs_of: dict[int, list[np.ndarray]] = {}
        for item, docs in zip(wanted.column("item").to_pylist(), wanted.column("docs").to_pylist(), strict=True):
            docs_of.setdefault(item, []).append(np.frombuffer(docs, "<u2"))
        for item, parts in docs_of.items():
            docs = np.concatenate(parts).astype(np.int64)
            of = total[at[item], docs]
            for j in np.lexsort((order[docs], -of))[:k].tolist():
                if of[j] > 0:
                    scores.append((item, ids[docs[j]], int(of[j])))
    cols = list(zip(*scores, strict=True)) or [()] * 3
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["item", "doc_id", "score"])


def search(index: Index, items: DataFrame, k: int = TOP, folder: str | None = None) -> DataFrame:
    """Per item (item_id, text) its k best documents: item_id, rank, doc_id, score."""
    folder = folder or shared_dir(items.sparkSession, "lexical-search")
    asked = query_terms(index, items, folder)
    known = index.table.filter("term IS NOT NULL")
    level_one = known.select("block", "term", "docs", "impacts").join(asked, "term").drop("term")
    bounds = level_one.groupBy("chunk", "block").applyInArrow(lambda t: _bounds(t, k), "chunk long, block long, item long, upper long, lower long, n_docs long, docs binary")
    bounds = written(bounds, f"{folder}/bounds", compression="zstd")

    # The k-th lower bound: rows stand for n_docs documents, and k rows hold k documents at least.
    best = W.partitionBy("item").orderBy(F.col("lower").desc(), F.col("block"), F.col("upper").desc())
    first = bounds.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    before = first.withColumn("before", F.sum("n_docs").over(best.rowsBetween(W.unboundedPreceding, 0)) - F.col("n_docs"))
    limits = before.groupBy("item").agg(F.min(F.when(F.col("before") < k, F.col("lower"))).alias("last"), F.sum("n_docs").alias("of"))
    limits = limits.select("item", F.when(F.col("of") >= k, F.col("last")).otherwise(0).alias("limit"))
    wanted = written(bounds.join(limits, "item").filter("upper >= limit").select("chunk", "block", "item", "docs"), f"{folder}/wanted", compression="zstd")

    reached = wanted.select("chunk", "block").distinct()
    level_two = known.select("block", "term", "docs", "tfs").join(asked, "term").join(reached, ["chunk", "block"], "left_semi").select("chunk", "block", "term", "docs", "tfs", "items", "weight", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("ms"))
    heads = index.table.filter("term IS NULL").select("block", "ids", "ms").join(reached, "block").select("chunk", "block", F.lit(None).cast("string").alias("term"), F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("tfs"), F.lit(None).cast("array<long>").alias("items"), F.lit(None).cast("long").alias("weight"), "ids", "ms")
    both = wanted.groupBy("chunk", "block").cogroup(level_two.unionByName(heads).groupBy("chunk", "block"))
    scored = both.applyInArrow(lambda a, b: _exact(a, b, k), "item long, doc_id long, score long")
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = items.sparkSession.read.parquet(f"{folder}/items").select("item", "item_id")
    result = written(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"), f"{folder}/result")
    discard(items.sparkSession, *[f"{folder}/{name}" for name in ("items", "query-terms", "bounds", "wanted")])
    return result


def drop_index(index: Index) -> None:
    """Delete the index from the shared folder."""
    discard(index.table.sparkSession, f"{index.folder}/index")


ORACLE_SQL = r"""
WITH q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
a AS (SELECT DISTINCT item_id, term FROM q),
w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
s AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY doc_id),
g AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS terms FROM s),
m AS (SELECT doc_id, 100 - 50 + (50 * n * (SELECT documents FROM g)) // (SELECT terms FROM g) AS m FROM s),
d AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * (SELECT documents FROM g) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM c GROUP BY term),
r AS (SELECT a.item_id, c.doc_id, CAST(sum(d.weight * ((1000000000 * c.tf) // (1000 * c.tf + 20 * m.m))) AS BIGINT) AS score
      FROM a JOIN c USING (term) JOIN d USING (term) JOIN m ON m.doc_id = c.doc_id GROUP BY a.item_id, c.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
