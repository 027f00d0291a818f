"""Packing and token files: exact round trips."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyarrow import fs

from pointloom.llm import packing, token_files
from pointloom.llm.tokens import MemoEncoder, public_path
from tests.conftest import SF
from tests.llm.cases import awkward, empty


def _check_pieces(rows, window=packing.WINDOW):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id, r.doc_tokens].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window and (at == window or at & (at - 1) == 0)
    return by_doc


def test_pieces_hold_each_id_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    by_doc = _check_pieces(rows)
    whole = MemoEncoder(public_path("byte_bpe_50k.json")).whole
    for d in docs.collect():
        ids = np.append(whole(d.text or ""), np.uint32(1)).astype("<u4")
        at = 0
        for r in sorted(by_doc[d.doc_id, len(ids)], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_takes_awkward_documents(spark):
    docs = awkward(spark)
    rows = packing.pack_documents(docs).collect()
    _check_pieces(rows)
    assert sum(r.length for r in rows if r.doc_id == 2) == 1 and sum(r.length for r in rows if r.doc_id == 3) == 1
    assert sum(r.length for r in rows if r.doc_id == 7) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 7)
    assert packing.pack_documents(empty(spark)).count() == 0


def test_levels_are_chosen_by_least_sum_of_squares():
    rng, out = np.random.default_rng(1), []
    s = packing.Stream(16, lambda *a: out.append(a))
    for i in range(300):
        size = int(rng.integers(1, 16))
        counts = [len(s.open[h]) if h else 0 for h in range(16)]

        def after(h, counts=counts, size=size):
            c = list(counts)
            if h:
                c[h] -= 1
            if h + size < 16:
                c[h + size] += 1
            return sum(x * x for x in c)

        options = [h for h in range(17 - size) if h == 0 or counts[h]]
        assert after(s.level_for(size)) == min(map(after, options))
        s.add((i, size), np.arange(size, dtype=np.uint32))
    s.finish()
    used = defaultdict(int)
    for _, _, ids, sequence, _ in out:
        used[sequence] += len(ids)
    assert all(u == 16 or u & (u - 1) == 0 for u in used.values())


@pytest.mark.parametrize("frame_ids", [7, 1 << 17])
def test_token_files_round_trip(spark, frame_ids):
    docs = awkward(spark)
    manifest = token_files.write_token_files(docs, frame_ids=frame_ids)
    rows = token_files.read_token_files(manifest).collect()
    whole = MemoEncoder(public_path("word_bpe_49k.json")).whole
    texts = sorted(((d.doc_id is not None, d.doc_id or 0, d.text or "") for d in docs.collect()), key=lambda d: d[:2])
    got = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d[1] if d[0] else None for d in texts]
    at = 0
    for (_, _, text), r in zip(texts, got, strict=True):
        ids = np.append(whole(text), np.uint32(2)).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = manifest.first().path
    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_file(place) as source:
        file = token_files.TokenFile(source)
        each = list(file.each())
        assert all(np.array_equal(file.ids(i), e) for i, e in enumerate(each))
        first = file.frame(0)
    data = bytearray(open(place, "rb").read())
    assert zstandard.ZstdDecompressor().decompressobj().decompress(bytes(data[: int(file.at[1])])) == first.tobytes()
    data[5] ^= 0xFF
    open(place + ".bad", "wb").write(data)
    with system.open_input_file(place + ".bad") as source, pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.TokenFile(source).each())


def test_many_files_and_ties(spark):
    """A whole table in many files, with equal and null doc_ids: one gapless run of ids in ascending order, the same on a rerun."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.filter("doc_id < 60").selectExpr("CASE WHEN doc_id % 2 = 0 THEN 7 END AS doc_id", "text"))
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifests = [token_files.write_token_files(d, frame_ids=1000) for d in (docs, docs.repartition(5))]
        runs = [sorted(token_files.read_token_files(m).collect(), key=lambda r: r.start) for m in manifests]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert manifests[0].count() > 1 and runs[0] == runs[1]
    ids = [-1 if r.doc_id is None else r.doc_id for r in runs[0]]
    assert ids == sorted(ids) and ids.count(-1) == 30 and ids.count(7) == 31
    assert [r.start for r in runs[0]] == [0, *np.cumsum([r.n_tokens for r in runs[0]])[:-1].tolist()]
    whole = MemoEncoder(public_path("word_bpe_49k.json")).whole
    want = sorted((-1 if d.doc_id is None else d.doc_id, len(ids) + 1, zlib.crc32(np.append(ids, np.uint32(2)).astype("<u4").tobytes())) for d in docs.collect() for ids in [whole(d.text or "")])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in runs[0]) == want


def test_token_files_of_nothing(spark):
    manifest = token_files.write_token_files(empty(spark))
    assert manifest.count() == 0 and token_files.read_token_files(manifest).count() == 0
