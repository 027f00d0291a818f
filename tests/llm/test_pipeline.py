"""The corpus pipeline stage by stage, and the queries' names."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter

import __spark_entry__
import corpus_pipeline
from pointloom.llm import near_dedup, toxicity
from pointloom.llm.shingles import jaccard_linked, shingle_sets
from pointloom.llm.tokens import MemoEncoder, public_path
from tests.conftest import SF
from tests.llm.cases import awkward, empty, water_fill


def test_queries_are_registered_once_each():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 13)) and "pipeline" in __spark_entry__.queries()


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, last = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        now = docs.count()
        assert now < last if name in ("exact_dedup", "near_dedup") else now > 0
        last = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_take_awkward_documents(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward(spark), SF).count() > 0
        assert stage(spark, empty(spark), SF).count() == 0


def test_dedup_stages_decide_rows(spark):
    """Repeated and null doc_ids: exactly one row of each distinct text stays."""
    rows = [(1, "a b c"), (2, "a b c"), (2, "zzz"), (7, "q q"), (7, "q q"), (None, "a b c"), (None, "only")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, `row` string, at long")
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, "a b c"), (2, "zzz"), (7, "q q"), (None, "only")], key=repr)


def test_near_stage_drops_what_the_query_drops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in near_dedup.near_duplicates(docs).collect() if r.kept}
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect()} == kept and len(kept) < docs.count()


def test_run_equals_a_plain_version(spark):
    """Every stage again in plain Python: which documents the packed pieces hold, and how often."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(r.text) < 0.5]

    seen: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    rows = [r for r in rows if r.doc_id in set(seen.values())]

    sets = shingle_sets([(r.text or "").encode() for r in rows], 2)
    root = {r.doc_id: r.doc_id for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in itertools.combinations(range(len(rows)), 2):
        if jaccard_linked(sets[i], sets[j], 80):
            a, b = find(rows[i].doc_id), find(rows[j].doc_id)
            root[max(a, b)] = min(a, b)
    rows = [r for r in rows if find(r.doc_id) == r.doc_id]

    words = {r.doc_id: len((r.text or "").encode().split()) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r.source] += words[r.doc_id]
    target, copies = water_fill(dict(sizes)), Counter()
    for source, size in sizes.items():
        passes = int(target[source] // size) if size else 0
        budget, at = target[source] - passes * size, 0
        own = sorted((int(hashlib.md5(f"{r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16), r.doc_id) for r in rows if r.source == source)
        for _, doc in own:
            n = words[doc]
            more = budget > 0 and (at + n < budget or (at < budget and at + n - budget < budget - at))
            copies[doc] += passes + more
            at += n

    pieces = corpus_pipeline.run(spark, SF).collect()
    held = Counter()
    for p in pieces:
        held[p.doc_id] += p.length
    encode = MemoEncoder(public_path("byte_bpe_50k.json")).whole
    want = {r.doc_id: copies[r.doc_id] * (len(encode(r.text or "")) + 1) for r in rows if copies[r.doc_id]}
    assert dict(held) == want
