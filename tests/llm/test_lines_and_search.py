"""Repeated lines and ranked search against brute force."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from pointloom.llm import lexical_search, line_dedup
from tests.conftest import SF
from tests.llm.cases import LONG, awkward, empty

SPACE = " \t\n\x0b\x0c\r"


def _lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def _lines(rows, min_chars=20, min_docs=3):
    """What is left of each row's text, by plain loops; rows are (doc_id, text)."""
    least = -(1 << 63)
    docs = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            docs[_lower(line.strip(SPACE))].add(least if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        me = least if doc_id is None else doc_id
        kept = [x for x in lines if not (len(k := _lower(x.strip(SPACE))) >= min_chars and len(docs[k]) >= min_docs and me < max(docs[k]))]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def _line_rows(spark):
    line = "A line that very many documents hold, word for word."
    rows = [(i, f"own {i}\n  {line.upper() if i % 2 else line}\t\nend {i}\n{line}") for i in range(30)]
    rows += [(40, "ÀÉ twenty code points É"), (41, "ÀÉ twenty code points É"), (42, "Àé twenty code points é"), (43, "\n".join(["ÀÉ Twenty code points É"] * 3))]
    rows += [(50, "nineteen characters"), (51, "nineteen characters"), (52, "nineteen characters"), (60, "only two of them hold this one"), (61, "only two of them hold this one")]
    rows += [(70, "the same row three times over"), (70, "the same row three times over"), (70, "the same row three times over")]
    rows += [(None, "nameless rows are one document"), (None, "nameless rows are one document"), (80, "nameless rows are one document"), (81, "nameless rows are one document")]
    rows += [(90, "\n\n"), (91, ""), (92, None), (93, line), (94, f"{LONG}\n{line}\n" + "\n".join(f"line number {i % 700} of a long text" for i in range(5000))), (95, "\n".join(f"line number {i} of a long text" for i in range(700)))]
    return rows + [(96, f"line number 1 of a long text\r\n{line}\r\n")]


def test_lines_equal_brute_force(spark):
    rows = _line_rows(spark)
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == _lines(rows)


@pytest.mark.parametrize(("min_chars", "min_docs"), [(0, 1), (1, 2), (5, 4)])
def test_lines_by_other_bounds(spark, min_chars, min_docs):
    rows = _line_rows(spark)[:60]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_chars, min_docs).collect()
    assert sorted(map(tuple, got), key=repr) == _lines(rows, min_chars, min_docs)


def test_lines_of_awkward_documents(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, line_dedup.line_dedup(docs).collect()), key=repr) == _lines(rows)
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and sorted(kept.collect(), key=repr) == sorted(docs.collect(), key=repr)
    assert line_dedup.line_dedup(empty(spark)).count() == 0 and line_dedup.drop_repeated_lines(empty(spark)).count() == 0


def test_lines_are_dropped_from_texts(spark):
    line = "a line that four documents hold"
    docs = spark.createDataFrame([(i, f"{i}\n{line}\n", "x") for i in range(4)], "doc_id long, text string, lines string")
    got = {r.doc_id: (r.text, r.lines) for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got == {0: ("0\n", "x"), 1: ("1\n", "x"), 2: ("2\n", "x"), 3: (f"3\n{line}\n", "x")}


def test_lines_of_a_hot_key_go_by_broadcast(spark):
    """A key in most rows holds over a thousandth of all lines; the plan must still give each row its own."""
    rows = [(i, f"the line of all documents of this table\nline {i} of its own, long enough") for i in range(3000)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == _lines(rows)


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", _lower(text or ""))


def _ranked(docs, items, k=50):
    """Rows of docs are (doc_id, text), of items (item_id, text)."""
    counts = [(d, Counter(_terms(t))) for d, t in docs]
    n_docs = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // total if total else 1
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(_terms(text)) if c[t])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def _found(spark, docs, items, k=50):
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    index = lexical_search.build_index(frames[0])
    got = sorted(map(tuple, lexical_search.search(index, frames[1], k).collect()), key=repr)
    lexical_search.drop_index(index)
    return got


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(120)] + ["Émile", "ЖУК", "漢字", "x9"]
    weight = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=weight / weight.sum()))
    docs = [(int(i), text(int(rng.integers(1, 60)))) for i in rng.permutation(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(130)]  # copies: more than k of them tie
    docs += [(None, docs[7][1]), (None, "w1"), (2000, None), (2001, "..."), (2002, ""), (5, docs[5][1]), (2003, "w3 " * 30_000), (2004, "W1-w2_w3/ÉMILE'émile")]
    items = [(i, text(12)) for i in range(20)] + [(50, docs[7][1]), (51, None), (52, "unknown words only"), (53, ""), (0, "w5 w5 W5"), (None, "w7 漢字"), (54, " ".join(words) + " LAST")]
    assert _found(spark, docs, items) == _ranked(docs, items)
    assert _found(spark, docs, items, k=3) == _ranked(docs, items, 3)


def test_search_of_small_blocks_and_chunks(spark, monkeypatch):
    """Several blocks a task and several chunks of items; the bounds must hold across them."""
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 17)
    monkeypatch.setattr(lexical_search, "CHUNK_ITEMS", 3)
    docs = [(i, f"common {'rare ' * (i % 9)} t{i % 13} t{i % 7} {'pad ' * (i % 30)}") for i in range(500)]
    items = [(i, f"common rare t{i} t{i + 1}") for i in range(11)]
    assert _found(spark, docs, items, k=20) == _ranked(docs, items, 20)


def test_search_of_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, "the cat and a word"), (2, "漢字とかな nul"), (3, "story")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lexical_search.search(lexical_search.build_index(docs), items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect()), key=repr) == _ranked(rows, [tuple(r) for r in items.collect()])
    assert lexical_search.search(lexical_search.build_index(empty(spark)), items).count() == 0
    assert lexical_search.search(lexical_search.build_index(docs), items.limit(0)).count() == 0


def test_bytes_bound_impacts():
    rng = np.random.default_rng(3)
    tf, m = rng.integers(1, 1 << 31, 20_000), rng.integers(50, 1 << 40, 20_000)
    tf[:5000], m[:5000] = rng.integers(1, 30, 5000), rng.integers(50, 400, 5000)
    exact = lexical_search.impact(tf, m)
    q = -(-exact // lexical_search.STEP)
    assert q.max() <= 255 and (q * lexical_search.STEP >= exact).all()
    assert ((q - 1) * lexical_search.STEP < np.maximum(exact, 1)).all()


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_lexical_search"])
def test_queries_equal_sql(spark, name):
    from pointloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    assert df.columns == [d[0] for d in cur.description]
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())
