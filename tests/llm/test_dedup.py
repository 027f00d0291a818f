"""Exact dedup, near dedup and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pytest

from pointloom.llm import exact_dedup, near_dedup, sentence_spans
from pointloom.llm.shingles import jaccard_linked, shingle_sets, signature
from tests.conftest import SF
from tests.llm.cases import awkward, empty


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize(("key_bits", "bucket_texts"), [(64, 1 << 14), (64, 8), (3, 4)])
def test_exact_groups(spark, key_bits, bucket_texts):
    """Few key bits make keys collide, so that chains must be told apart by their bytes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text").selectExpr("doc_id + 1000 AS doc_id", "text"))
    rows, groups = docs.collect(), defaultdict(list)
    for r in rows:
        groups[_norm(r.text)].append(r.doc_id)
    got = exact_dedup.exact_duplicates(docs, key_bits=key_bits, bucket_texts=bucket_texts).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for r in rows:
        ids = groups[_norm(r.text)]
        keep = min((i for i in ids if i is not None), default=None)
        want[r.doc_id].append((keep, len(ids), hashlib.sha256(_norm(r.text).encode()).hexdigest()))
    assert sum(r.kept for r in got) == len(groups)  # of repeated rows one stays
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.keep_id, r.group_size, r.text_sha256))
        assert not r.kept or r.doc_id == r.keep_id
    assert {k: sorted(v, key=repr) for k, v in have.items()} == {k: sorted(v, key=repr) for k, v in want.items()}


def test_exact_of_nothing(spark):
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_exact_plan_has_no_python(spark):
    plan = exact_dedup.exact_duplicates(awkward(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_directory_doubles_and_covers_every_prefix():
    rng = np.random.default_rng(1)
    histogram = {int(k): int(n) for k, n in zip(range(256), rng.integers(0, 40, 256), strict=True)} | {3: 900}
    depth, directory, buckets = exact_dedup.build_directory(histogram, 8, 200)
    assert len(directory) == 1 << depth and sum(b[2] for b in buckets) == sum(histogram.values())
    for slot, b in enumerate(directory):
        prefix, local, n = buckets[b]
        assert slot >> (depth - local) == prefix and (n <= 200 or local == 8)


def _components(ids, sets, percent=80):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            if jaccard_linked(sets[i], sets[j], percent):
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = shingle_sets([(r.text or "").encode() for r in rows], words)
    want = _components([r.doc_id for r in rows], sets)
    got = near_dedup.near_duplicates(docs, words).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {r.doc_id: len(s) for r, s in zip(rows, sets, strict=True)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_bucket_of_near_copies_and_stragglers(spark):
    """Copies with few changes link; copies with many share buckets with them but link only where exact sets say so."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(260):
        words = list(base)
        for i in rng.choice(120, int(rng.integers(0, 5 if k % 3 else 12)), replace=False):
            words[i] = f"x{k}-{i}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _components(list(range(260)), shingle_sets([t.encode() for t in texts], 2))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert sum(got[i] != want[i] for i in want) == 0


def _plain_sets(texts, words):
    """Word tuples by the definition, with nothing of the library's."""
    out = []
    for t in texts:
        seq = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(seq[i : i + words]) for i in range(len(seq) - words + 1)} if len(seq) >= words else {tuple(seq)} if seq else set())
    return out


def _plain_components(sets):
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def _expected(rows, words):
    """Per row (doc_id, n_shingles, component_id, kept); rows are (doc_id, text)."""
    sets = _plain_sets([t for _, t in rows], words)
    comp = _plain_components(sets)
    least, first = {}, {}
    for i, c in enumerate(comp):
        ids = [x for x in (least.get(c), rows[i][0]) if x is not None]
        least[c], first[c] = min(ids, default=None), min(first.get(c, i), i)
    return [(rows[i][0], len(s), least[c], rows[i][0] == least[c] if least[c] is not None else first[c] == i) for i, (s, c) in enumerate(zip(sets, comp, strict=True))]


def test_near_rows_without_ids_keep_their_links(spark):
    words = [f"w{i}" for i in range(60)]
    text, other = " ".join(words), " ".join(f"v{i}" for i in range(40))
    rows = [(None, text), (None, f"{text} z"), (7, f"{text} y"), (None, other), (None, f"{other} z"), (3, "alone here"), (3, f"{text} x"), (3, "alone here")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 2)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(_expected(rows, 2), key=repr)
    one = near_dedup.near_duplicates(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, doc_id long, text string"), 2, row="n")
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in sorted(one.collect(), key=lambda r: r.row)] == _expected(rows, 2)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_near_duplicates_by_the_definition_alone(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(map(tuple, near_dedup.near_duplicates(docs, 2).collect())) == sorted(_expected(rows, 2))


def test_blocks_are_dealt_by_weight(spark, monkeypatch):
    """Chains of near copies around one center, in many small blocks: links across components must all be found."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "HEAVY", 40)
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 6)
    rng = np.random.default_rng(11)
    base, rows = [f"w{i}" for i in range(90)], []
    for family in range(12):
        start = list(base)
        for i in rng.choice(90, int(rng.integers(3, 9)), replace=False):
            start[i] = f"f{family}-{i}"
        for k in range(12):
            words = list(start)
            for i in rng.choice(90, int(rng.integers(0, 3)), replace=False):
                words[i] = f"x{family}-{k}-{i}"
            rows.append((len(rows), " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted(map(tuple, got)) == sorted(_expected(rows, 2))


def test_near_awkward(spark):
    got = near_dedup.near_duplicates(awkward(spark), 2).collect()
    assert len(got) == 11
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1][0].component_id == 0 and by[5][0].n_shingles == 1 and len(by[7]) == 2
    for i in (2, 3, 4):
        assert by[i][0].n_shingles == 0 and by[i][0].component_id == i and by[i][0].kept
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_shingles_follow_their_definition():
    text = "The  cat\tSAT on the cat sat on \u00c9T\u00c9".encode()
    plain = ["the", "cat", "sat", "on", "the", "cat", "sat", "on", "\u00c9T\u00c9"]
    for words in (1, 2, 3, 5, 9, 12):
        want = {tuple(plain[i : i + words]) for i in range(max(1, len(plain) - words + 1))}
        assert len(shingle_sets([text], words)[0]) == len(want)
    a, b, c = shingle_sets([b"x y", b"X  Y", b"y x"], 2)
    assert (a == b).all() and (a != c).all() and len(shingle_sets([None, b"", b" \n"], 2)[2]) == 0


def test_posterior_bound_keeps_similar_pairs():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    a = np.unique(words[:900])
    b = np.unique(np.concatenate([words[:850], words[950:]]))
    x, y = (signature(s, 240).astype(np.uint8)[None] for s in (a, b))
    assert len(near_dedup.survivors(x, y)) == 1
    c = signature(np.unique(words[500:]), 240).astype(np.uint8)[None]
    assert len(near_dedup.survivors(x, c)) == 0
    assert near_dedup.min_matches(40) < near_dedup.min_matches(240) < 0.8 * 240


PASSAGE = ("the quick brown animal went over the hill and saw the river below. it was cold in the morning, so nobody walked there. "
           "later the sun came out and warmed the stones by the water. people of the village came down to fish and talk about the weather. "
           "they stayed until the evening and went home with full baskets.")  # fmt: skip


def test_repeated_passages(spark):
    docs = spark.createDataFrame(
        [
            (1, "own words of the first text here. " + PASSAGE + " and more of it"), (2, "Something else entirely stands before it " + PASSAGE + " Tail."), (3, "A clean text. It has nothing to do with others. Its sentences are its own, and they are long enough to be hashed, as any others are."),
            (4, PASSAGE + " " + PASSAGE), (5, None), (6, ""), (None, PASSAGE),
        ],
        "doc_id long, text string",
    )
    found = defaultdict(list)
    for r in sentence_spans.repeated_passages(docs).collect():
        found[r.doc_id].append(r)
    assert set(found) == {2, 4, None} and all(r.first_doc_id == 1 for r in found[2])
    text = {r.doc_id: r.text for r in docs.collect()}
    inside = "".join(text[2][r.start : r.end] for r in found[2])
    assert inside in PASSAGE and len(inside) > 0.6 * len(PASSAGE)
    left = {r.doc_id: r.text for r in sentence_spans.remove_repeats(docs).collect()}
    assert left[1] == text[1] and left[3] == text[3] and left[5] is None and "warmed the stones" not in left[2] and left[2].startswith("Something else")
    assert sentence_spans.repeated_passages(empty(spark)).count() == 0
    assert sentence_spans.remove_repeats(awkward(spark)).columns == awkward(spark).columns


def test_runs_equal_a_plain_version():
    text = PASSAGE + "\n" + PASSAGE.upper() + " ! ?? tail"
    start, end, h, bounds = sentence_spans.sentences(text)
    words = text.split()
    assert [text[a:b] for a, b in zip(start, end, strict=True)] == words
    a, b, first, last = sentence_spans.runs(text)
    spans = {}
    for x, y, i, j in zip(a.tolist(), b.tolist(), first.tolist(), last.tolist(), strict=True):
        spans.setdefault((x, y), " ".join(text[i:j].split()))
        assert spans[x, y] == " ".join(text[i:j].split()) and len(text[i:j].split()) >= sentence_spans.WORDS
    assert len(spans) == len(set(spans.values()))


def _covered_sentences(docs, marked):
    """By brute force over every run: the (document, first word) of all sentences that a non-first repeated run covers.

    Runs are the same if their sentences are (marked) or if only their words are.
    """
    first, cut = {}, {}
    for doc, text in docs:
        _, _, _, bounds = sentence_spans.sentences(text or "")
        cut[doc] = (text or "").split(), bounds.tolist()
    todo = []
    for doc in sorted(cut):
        words, bounds = cut[doc]
        n = len(bounds) - 1
        for i in range(n):
            for j in range(i + sentence_spans.RUN, n + 1):
                if bounds[j] - bounds[i] >= sentence_spans.WORDS:
                    parts = [" ".join(words[a:b]) for a, b in itertools.pairwise(bounds[i : j + 1])]
                    key = hashlib.md5(("\n" if marked else " ").join(parts).encode("utf-8", "surrogatepass")).digest()
                    if first.setdefault(key, (doc, i)) != (doc, i):
                        todo.append((doc, i, j))
    return {(doc, s) for doc, i, j in todo for s in cut[doc][1][i:j]}


def _removed_sentences(docs, passages):
    gone = defaultdict(list)
    for p in passages:
        gone[p.doc_id].append((p.start, p.end))
    out = set()
    for doc, text in docs:
        start, end, _, bounds = sentence_spans.sentences(text or "")
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out |= {(doc, a) for x, y in gone[doc] if x <= start[a] and end[b - 1] <= y}
    return out


def test_removed_sentences_equal_brute_force(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 4000]
    tail = "Aa bb cc dd ee ff gg hh ii jj kk ll. Mm nn oo pp qq rr ss tt uu vv ww xx. Ab ac ad ae af ag ah ai aj ak al am. Ya yb. Za zb."
    docs = table + [(9001, f"Own start here. {tail} One end."), (9002, f"Another start. {tail} Other words at the end."), (9003, f"{tail} {tail}")]
    found = sentence_spans.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    least, most = _covered_sentences(docs, True), _covered_sentences(docs, False)
    got = _removed_sentences(docs, found)
    assert least <= got <= most and len(least) > 100
    assert "Ya yb. Za zb." in next(docs[-2][1][p.start : p.end] for p in found if p.doc_id == 9002)


def test_rows_of_one_doc_id_are_cut_by_themselves(spark):
    docs = spark.createDataFrame([(1, PASSAGE), (2, "a short text"), (2, "Something before. " + PASSAGE), (2, PASSAGE + " And behind it.")], "doc_id long, text string")
    left = sorted(r.text for r in sentence_spans.remove_repeats(docs).collect() if r.doc_id == 2)
    assert left[0].strip() == "And behind it." or left[0].strip().startswith("a short") or any(t.startswith("Something before.") for t in left)
    assert sum("warmed the stones" in t for t in left) == 0 and "a short text" in left
    rows = sentence_spans.changed_documents(docs).collect()
    assert [r.doc_id for r in rows] == [2, 2] and sorted(r.clean_sha256 for r in rows) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in left if t != "a short text")


@pytest.mark.parametrize("doc_id", [5, None])
def test_rows_that_share_an_id_keep_one_copy(spark, doc_id):
    rows = [(doc_id, PASSAGE), (doc_id, PASSAGE), (doc_id, "In front. " + PASSAGE), (9 if doc_id is None else 3, "no passage here")]
    left = [r.text for r in sentence_spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()]
    assert sum("warmed the stones" in t for t in left) == 1 and PASSAGE in left and "no passage here" in left


@pytest.mark.parametrize("kind", ["bars", "one word", "two words", "plain"])
def test_passages_share_runs_whatever_their_words_are(kind):
    words = {
        "bars": " ".join(f"{'|' if i % 2 else f'cell{i}'}" for i in range(160)).split(),
        "one word": ["same"] * 160,
        "two words": ["|", "same"] * 80,
        "plain": [f"word{i * i % 71}" for i in range(160)],
    }[kind]
    passage = " ".join(words)
    texts = [" ".join(f"own{k}x{i}" for i in range(k)) + " " + passage + " " + " ".join(f"end{k}y{i}" for i in range(9)) for k in (3, 8, 17, 29)]
    found = []
    for text in texts:
        a, b, first, last = sentence_spans.runs(text)
        found.append(dict(zip(zip(a.tolist(), b.tolist(), strict=True), zip(first.tolist(), last.tolist(), strict=True), strict=True)))
    shared = set(found[0]).intersection(*found[1:])
    assert shared
    for text, runs in zip(texts, found, strict=True):
        a, b, first, last = sentence_spans.runs(text)
        hit = [(i, j) for x, y, i, j in zip(a.tolist(), b.tolist(), first.tolist(), last.tolist(), strict=True) if (x, y) in shared]
        covered = set().union(*(range(i, j) for i, j in hit))
        assert len(covered) > 0.7 * len(passage) and len(runs) > 0
