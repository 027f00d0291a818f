"""Repeated passages: sliding spans of consecutive sentences, hashed and joined globally.

A text is cut into sentences at end marks and line ends. A sentence over LONG words is cut further by winnowing:
of any WINDOW words in a row, the one whose hash with its GRAM - 1 predecessors is least ends a part, the last of equal ones.
So no part is longer than WINDOW words, whatever they are, and a passage is cut alike wherever it stands, but for its
first WINDOW + GRAM and last WINDOW words. Of all runs of at least RUN sentences and WORDS words, the shortest one from
each sentence on and the shortest one up to each sentence are hashed (96 bits over the words, whatever white space parts them):
whatever longer run repeats, these runs in it repeat too and cover it. Runs are
counted over all documents; of each repeated run the first row, by doc_id and number, keeps its first
occurrence, and every sentence that another occurrence covers is removed.

Rows are numbered and their runs written to the shared folder once, one row a text with an array for each of SLICES
equal ranges of the hash. Ranges are counted and joined one after the other, and each one's shuffles are freed before
the next, so the runs on disk at once are a SLICES-th of all, however many there are. Counting combines in
every task before the shuffle, and runs that many documents share are joined by broadcast of at most a thousand hot
runs a range, so a passage in a third of all documents makes no hot task.

Defined cases: null, empty and short texts have no runs; repeats inside a text are removed
behind their first occurrence; rows that share a doc_id, and rows without one, which come last, follow each other in the order of
their numbers, so that the first of them stays whole; an empty table gives no rows; other
input columns are ignored or, where rows are returned, kept. Offsets count code points of the text, end exclusive.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointloom.llm.shared import discard, free_shuffles, join_groups, shared_dir, small_batches, written
from pointloom.llm.shingles import _mix

RUN, WORDS = 3, 20
LONG, WINDOW, GRAM = 12, 12, 3  # words of a long sentence (WINDOW at least); one word in any WINDOW of it ends a part; words hashed for that
_END = re.compile(r"[.!?…][^\w\s]*$")
_LAST = (1 << 63) - 1
SLICES = 4  # ranges of run hashes, joined one after the other; a power of two
_RUN = ["run", "check", "first", "last", "again"]
_RUNS = "at long, doc_id long, " + ", ".join(f"runs{k} array<struct<run: long, check: int, first: int, last: int, again: boolean>>" for k in range(SLICES))
_MEMO_WORDS = 300_000
_SPACES = np.array([chr(i).isspace() for i in range(0x3001)])
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_GRAM_BASES = [np.uint64(pow(_BASES[0], k, 1 << 64)) for k in range(GRAM)]
_HIGH = np.uint64(0xFFFFFFFF00000000)  # of a window's key: hash above, index from the end below


class _Words(dict):
    """A word's hash, whose lowest bit tells whether the word ends a sentence, remembered."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word) & ~1 | (_END.search(word) is not None)
        return h


_words = _Words()


def _least(h: np.ndarray) -> np.ndarray:
    """In each WINDOW of at least WINDOW word hashes, the index of the last word whose hash with its predecessors is least."""
    n = len(h)
    gram = h.copy()
    for k in range(1, GRAM):
        gram[k:] += h[:-k] * _GRAM_BASES[k]
    low = _mix(gram) & _HIGH | np.arange(n, 0, -1, dtype=np.uint64)
    size = 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    return n - (low & ~_HIGH).astype(np.int64)


def sentences(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start and end of each word, word hashes, index of the first word of each sentence and the number of words)."""
    if len(_words) > _MEMO_WORDS:
        _words.clear()
    words = text.split()
    n = len(words)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if not n:
        return h, h, h, np.zeros(1, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _SPACES[np.minimum(codes, 0x3000)] & (codes <= 0x3000)
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    line = np.cumsum(codes == 10)[start]
    close = (h & np.uint64(1)) == 1
    close[:-1] |= line[1:] != line[:-1]
    close[-1] = True
    bounds = np.concatenate([[0], np.flatnonzero(close) + 1])
    long = np.repeat(np.diff(bounds) > LONG, np.diff(bounds))
    if long.any():
        cut = np.zeros(n, bool)
        cut[_least(h)] = True
        bounds = np.union1d(bounds, np.flatnonzero(cut & long) + 1)
    return start, end, h, bounds


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2 ** 64, and their inverses."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]


_TABLE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def runs(text: str, least_run: int = RUN, least_words: int = WORDS) -> tuple[np.ndarray, ...]:
    """(hash, second hash, start, end) of the shortest long-enough runs from each sentence on and up to each sentence."""
    start, end, h, bounds = sentences(text)
    n = len(bounds) - 1
    each = np.arange(n + 1)
    last = np.maximum(np.searchsorted(bounds, bounds + least_words), each + least_run)  # the bound that ends the run from each sentence
    first = np.minimum(np.searchsorted(bounds, bounds - least_words, "right") - 1, each - least_run)  # that starts the run up to each bound
    onward, upward = np.flatnonzero(last <= n), np.flatnonzero(first >= 0)
    pairs = np.unique(np.concatenate([onward * (n + 1) + last[onward], first[upward] * (n + 1) + upward]))
    first, stop = bounds[pairs // (n + 1)], bounds[pairs % (n + 1)]
    out = []
    for base in _BASES:
        if base not in _TABLE or len(_TABLE[base][0]) < len(h):
            _TABLE[base] = _powers(base, max(len(h), 1 << 15))
        up, down = _TABLE[base]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(h ^ np.uint64(base)) * up[: len(h)], dtype=np.uint64)])
        out.append(_mix((sums[stop] - sums[first]) * down[first] + (stop - first).astype(np.uint64)))
    return out[0], out[1], start[first].astype(np.int32), end[stop - 1].astype(np.int32)


def run_table(rows: DataFrame) -> DataFrame:
    """at, doc_id and the runs of each row (at, doc_id, text) by slice; `again` marks repeats inside the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, max_bytes=1 << 20):
            parts = []
            for text in batch.column("text").to_pylist():
                a, b, first, last = runs(text or "")
                again = np.ones(len(a), bool)
                again[np.unique(a, return_index=True)[1]] = False
                parts.append((a, (b >> np.uint64(33)).astype(np.int32), first, last, again))
            n = len(parts)
            row = np.repeat(np.arange(n), [len(p[0]) for p in parts])
            a, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
            slices = a // np.uint64((1 << 64) // SLICES)
            lists = []
            for k in range(SLICES):
                of = slices == k
                values = pa.StructArray.from_arrays([pa.array(c[of]) for c in (a.view(np.int64), *rest)], _RUN)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row[of], minlength=n))]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), values))
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("doc_id"), *lists], names=["at", "doc_id", *[f"runs{k}" for k in range(SLICES)]])

    return rows.select("at", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _RUNS)


def _with_first(found: DataFrame, groups: DataFrame, hot_runs: int = 1000) -> DataFrame:
    """The runs of repeated groups with first_doc_id, in one pass: rows of hot groups (over 1 / hot_runs of all) get it by broadcast and are dealt at random."""
    most = max(1, (groups.agg(F.sum("times")).first()[0] or 0) // hot_runs)
    hot = groups.filter(F.col("times") > most).select("run", "check", F.col("first_doc_id").alias("hot_first"))
    cold = groups.filter(F.col("times") <= most).select(F.col("run").alias("cold_run"), F.col("check").alias("cold_check"), F.col("first_doc_id").alias("cold_first"))
    marked = found.join(F.broadcast(hot), ["run", "check"], "left").withColumn("run", F.when(F.col("hot_first").isNull(), F.col("run")).otherwise(F.xxhash64("at", "first")))
    met = marked.join(cold, (F.col("run") == F.col("cold_run")) & (F.col("check") == F.col("cold_check")), "left")
    return met.withColumn("first_doc_id", F.coalesce("hot_first", "cold_first")).filter("first_doc_id IS NOT NULL")


def _repeated(found: DataFrame) -> DataFrame:
    """The runs that occur more than once: run, check, first_doc_id, times."""
    return found.groupBy("run", "check").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("times")).filter("times > 1")


def _later_rows(found: DataFrame, groups: DataFrame, folder: str) -> DataFrame:
    """Of the runs that rows of the smallest doc_id of a group share, those of all rows but the first: where doc_ids repeat or are null, rows come in the order of their numbers."""
    key = ["run", "check"]
    level = join_groups(found.filter("NOT again"), groups, key, "times").filter("doc_id = first_doc_id").drop("times")
    level = written(level, f"{folder}/level", compression="zstd")
    firsts = level.groupBy(*key).agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    return join_groups(level, written(firsts, f"{folder}/firsts"), key, "times").filter("at > first_at")


def _covered(rows: DataFrame, folder: str) -> DataFrame:
    """The runs to remove, of all slices: at, doc_id, first, last, first_doc_id; the table of all runs is deleted."""
    spark, out = rows.sparkSession, []
    tables = written(run_table(rows), f"{folder}/runs", compression="zstd")
    shared_ids = not tables.groupBy("doc_id").count().filter("count > 1").isEmpty()
    columns = ["at", "doc_id", "first", "last", "first_doc_id"]
    for k in range(SLICES):
        found = tables.select("at", "doc_id", F.explode(f"runs{k}").alias("r")).select("at", "doc_id", "r.*")
        groups = written(_repeated(found), f"{folder}/repeated-{k}")
        free_shuffles(spark)  # those of the counting, before the runs are dealt again
        removed = _with_first(found, groups).filter("again OR doc_id > first_doc_id").select(*columns)
        if shared_ids:
            removed = removed.unionByName(_later_rows(found, groups, folder).select(*columns))
        out.append(written(removed, f"{folder}/covered-{k}", compression="zstd"))
        discard(spark, f"{folder}/repeated-{k}", f"{folder}/level", f"{folder}/firsts")
        del found, groups, removed
        free_shuffles(spark)
    discard(spark, f"{folder}/runs")
    return functools.reduce(DataFrame.union, out)


def _passages(rows: DataFrame, folder: str) -> DataFrame:
    """Per passage to remove from a row (at, doc_id, text): at, doc_id, start, end, first_doc_id."""
    covered = _covered(rows, folder)
    order = W.partitionBy("at").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = covered.withColumn("opens", F.coalesce((F.col("first") > reached).cast("int"), F.lit(1)))
    numbered = starts.withColumn("passage", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = numbered.groupBy("at", "passage").agg(F.min("doc_id").alias("doc_id"), F.min("first").alias("start"), F.max("last").alias("end"), F.min("first_doc_id").alias("first_doc_id"))
    named = lambda c: F.when(F.col(c) != _LAST, F.col(c)).alias(c)
    return merged.select("at", named("doc_id"), "start", "end", named("first_doc_id"))


def _numbered(docs: DataFrame, folder: str) -> DataFrame:
    """`row` (all columns of docs as a struct) and `at`, its number, written so that the number stays with the row."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at"))
    return written(rows, f"{folder}/rows", compression="zstd")


def _cuts(rows: DataFrame, folder: str) -> DataFrame:
    """at and the sorted cuts of the rows with repeated passages; the tables of runs are deleted."""
    passages = _passages(rows.select("at", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")), folder)
    cuts = passages.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("start", "end", "first_doc_id"))).alias("cuts"))
    cuts = written(cuts, f"{folder}/cuts")
    discard(rows.sparkSession, *[f"{folder}/covered-{k}" for k in range(SLICES)])
    return cuts


def _cut(rows: DataFrame, folder: str) -> DataFrame:
    """row, and for the rows with repeated passages also cuts (start, end, first_doc_id) and clean: the text without them, each replaced by one line end."""
    cuts = _cuts(rows, folder)
    free_shuffles(rows.sparkSession)
    text = F.col("row.text").cast("string")
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["end"]))
    ends = F.concat(F.transform("cuts", lambda c: c["start"]), F.array(F.length(text)))
    clean = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a)), "\n")
    return rows.join(cuts, "at", "left").select("row", "cuts", F.when(F.col("cuts").isNotNull(), clean).alias("clean"))


def repeated_passages(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Per passage to remove: doc_id, start, end (code points), first_doc_id (where it stays)."""
    folder = folder or shared_dir(docs.sparkSession, "sentence-spans")
    rows = _numbered(docs.select("doc_id", "text"), folder).select("at", "row.*")
    return _passages(rows, folder).drop("at")


def remove_repeats(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """docs, columns unchanged, without their repeated passages (each leaves one line end)."""
    folder = folder or shared_dir(docs.sparkSession, "sentence-spans")
    found = _cut(_numbered(docs, folder), folder)
    return found.select(*[F.coalesce(F.col("clean"), F.col("row.text").cast("string")).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def changed_documents(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Per row that loses passages: doc_id, cuts (start, end, first_doc_id), n_chars of what is left and its clean_sha256."""
    folder = folder or shared_dir(docs.sparkSession, "sentence-spans")
    found = _cut(_numbered(docs.select("doc_id", "text"), folder), folder).filter("cuts IS NOT NULL")
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "cuts", F.length("clean").cast("long").alias("n_chars"), F.sha2("clean", 256).alias("clean_sha256"))
