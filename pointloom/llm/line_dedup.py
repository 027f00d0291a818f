r"""Lines that many documents share stay in one document only.

1. Texts are split at \n and exploded, one row a line. A line's key is the line without ASCII white space at its
   ends, A-Z lower-cased; keys of at least MIN_CHARS code points are hashed to two 64-bit numbers, so that no two keys
   meet by chance, and written with their row and position.
2. Rows of a hash are counted; only hashes with at least MIN_DOCS lines can be in so many documents. Their lines alone
   are counted by distinct documents, and those of too frequent keys are dropped but in the largest doc_id.
3. The positions to drop are gathered by row, and the text is put together again from the runs of lines between them.

Both counts combine in the scan tasks before they are dealt, and the lines of keys that hold over a thousandth of all
are met by broadcast of one row a key (`join_groups`), so a line that most documents hold makes no hot task. All steps
are DataFrame operations; the only group is one document.

Defined cases: null and empty texts are one empty line and stay so; rows that share a doc_id are one document when
documents are counted, rows without doc_id are together one document below all others, and each row keeps or loses its
own lines (so repeated rows of the largest doc_id all stay whole); a line that occurs several times in one document
counts once and stays or goes as a whole; a very long text is one group of lines; an empty table gives no rows; other
input columns are ignored by `line_dedup` and kept by `drop_repeated_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.shared import discard, join_groups, shared_dir, written

MIN_CHARS, MIN_DOCS = 20, 3
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased and all else as it is."""
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _numbered(docs: DataFrame, folder: str) -> DataFrame:
    """`at`, `text` and `row` (all other columns of docs), written so that the number stays with the row."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return written(docs.select(F.monotonically_increasing_id().alias("at"), F.col("text").cast("string").alias("text"), row.alias("row")), f"{folder}/rows", compression="zstd")


def _lines() -> Column:
    """The lines of a text; null is one empty line."""
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def line_hashes(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """at, doc, pos, h1, h2 of every line whose key has at least min_chars code points."""
    doc = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_NO_ID)).alias("doc")
    lines = rows.select("at", doc, F.posexplode(_lines()).alias("pos", "line"))
    keys = lines.select("at", "doc", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keys.select("at", "doc", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(rows: DataFrame, folder: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """at and drops, the sorted positions of the lines that the row loses."""
    key = ["h1", "h2"]
    hashes = written(line_hashes(rows, min_chars), f"{folder}/hashes", compression="zstd")
    many = hashes.groupBy(*key).agg(F.count(F.lit(1)).alias("times"), F.max("doc").alias("stays")).filter(F.col("times") >= min_docs)
    candidates = written(join_groups(hashes, written(many, f"{folder}/many"), key, "times"), f"{folder}/candidates", compression="zstd")
    frequent = candidates.groupBy(*key).agg(F.count_distinct("doc").alias("docs"), F.first("times").alias("times")).filter(F.col("docs") >= min_docs)
    frequent = written(frequent.select(*key, "times"), f"{folder}/frequent")
    lost = join_groups(candidates.filter("doc < stays").drop("times"), frequent, key, "times")
    return lost.groupBy("at").agg(F.sort_array(F.collect_list("pos")).alias("drops"))


def _kept(docs: DataFrame, folder: str, min_chars: int, min_docs: int) -> DataFrame:
    """row, null (no text), lines, n_dropped and kept: the text that is left."""
    rows = _numbered(docs, folder)
    drops = written(dropped_lines(rows, folder, min_chars, min_docs), f"{folder}/drops")
    discard(docs.sparkSession, *[f"{folder}/{name}" for name in ("hashes", "many", "candidates", "frequent")])
    n = F.size("lines")
    # The runs of lines between two dropped ones; each line is copied once.
    starts = F.concat(F.array(F.lit(0)), F.transform("drops", lambda d: d + 1))
    ends = F.concat("drops", F.array(n))
    runs = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("lines", a + 1, b - a)))
    # A row that loses all its lines joins none, which is the empty text.
    kept = F.array_join(F.when(F.col("drops").isNull(), F.col("lines")).otherwise(runs), "\n")
    # The table of drops grows with the input: both sides are sorted and merged at every size.
    met = rows.select("at", "row", F.col("text").isNull().alias("null"), _lines().alias("lines")).join(drops.hint("merge"), "at", "left")
    return met.select("row", "null", "lines", F.coalesce(F.size("drops"), F.lit(0)).alias("n_dropped"), kept.alias("kept"))


def _cleared(df: DataFrame, folder: str) -> DataFrame:
    """df, written to the folder, which loses all other tables."""
    result = written(df, f"{folder}/result", compression="zstd")
    discard(df.sparkSession, f"{folder}/rows", f"{folder}/drops")
    return result


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, folder: str | None = None) -> DataFrame:
    """Per row: doc_id, n_lines (before dropping), n_dropped, kept_sha256 of the text that is left."""
    folder = folder or shared_dir(docs.sparkSession, "line-dedup")
    found = _kept(docs.select("doc_id", "text"), folder, min_chars, min_docs)
    columns = [F.col("row.doc_id").cast("long").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256")]
    return _cleared(found.select(*columns), folder)


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, folder: str | None = None) -> DataFrame:
    """docs, columns unchanged, without the lines that other documents hold; texts that lose none stay as they are, null included."""
    folder = folder or shared_dir(docs.sparkSession, "line-dedup")
    found = _kept(docs, folder, min_chars, min_docs)
    text = F.when(~F.col("null"), F.col("kept"))
    return _cleared(found.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]), folder)


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id < f.stays AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
