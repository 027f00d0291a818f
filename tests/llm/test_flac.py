"""FLAC: exact round trips, damage, and streams that other encoders would write."""

from __future__ import annotations

import hashlib
import os
import random
import struct
import zlib
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from pointloom.llm import flac
from pointloom.llm.shared import shared_dir
from tests.conftest import SF
from tests.llm.cases import awkward, empty


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=3000), max_size=4))
def test_round_trip(data):
    payloads = [flac.payload(d) for d in data]
    assert [p for p, _ in flac.decode(flac.encode(payloads))] == payloads


def test_odd_payloads_and_offsets():
    payloads = [flac.payload(d) for d in (b"", b"a", b"x" * 64, os.urandom(5000), bytes(range(256)) * 20, b"\x00\xff" * 3000, b"text " * 30_000)]
    for p, (pcm, offsets) in zip(payloads, flac.decode(flac.encode(payloads)), strict=True):
        assert pcm == p and offsets == [(k, min(flac.BLOCK, len(p) - k)) for k in range(0, len(p), flac.BLOCK)]


def test_damage_is_found():
    media = flac.encode([flac.payload(b"some text to damage " * 300)])[0]
    rng = random.Random(1)
    start = flac._frame_starts(media)[2][0]
    for _ in range(30):
        bad = bytearray(media)
        bad[rng.randrange(start, len(bad))] ^= 1 << rng.randrange(8)
        with pytest.raises((ValueError, IndexError)):
            assert flac.decode([bytes(bad)])[0][0] == b"never"


def test_frames_are_found_without_a_seek_table():
    p = flac.payload(b"look for the frames " * 500)
    media = flac.encode([p])[0]
    n = int.from_bytes(media[43:46], "big")
    assert flac.decode([b"fLaC\x80" + media[5:42] + media[46 + n :]])[0][0] == p


def test_frame_numbers_are_utf8():
    for n in (0, 5, 127, 128, 2047, 2048, 65535, 65536, 0x10FFFF):
        assert flac._frame_number(n) == (chr(n).encode() if not 0xD800 <= n <= 0xDFFF else flac._frame_number(n))
    assert len(flac._frame_number(70_000_000)) == 6


class _Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def rice(self, value, k):
        u = (value << 1) ^ (value >> 31)
        self.bits += [0] * (u >> k) + [1]
        self.put(u & ((1 << k) - 1), k)

    def bytes(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))


def _file(samples, write_subframe):
    w = _Writer()
    head = b"\xff\xf8" + bytes([7 << 4 | 4, 2, 0]) + struct.pack(">H", len(samples) - 1)
    raw = np.frombuffer(head, np.uint8)
    crc8 = int(flac._crcs(raw, np.array([0]), np.array([len(head)]), 8)[0])
    for b in head + bytes([crc8]):
        w.put(b, 8)
    write_subframe(w)
    body = w.bytes()
    crc = int(flac._crcs(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]), 16)[0])
    md5 = hashlib.md5(bytes(s & 255 for s in samples)).digest()
    info = struct.pack(">HH", len(samples), len(samples)) + bytes(6) + struct.pack(">Q", 8000 << 44 | 7 << 36 | len(samples)) + md5
    return b"fLaC\x80\x00\x00\x22" + info + body + struct.pack(">H", crc)


def test_other_subframes_and_partitions():
    """LPC of order 2 in two partitions, one escaped; long quotients; verbatim; constant."""
    rng = np.random.default_rng(6)
    samples = [int(x) for x in rng.integers(-100, 100, 64)]

    def lpc(w):
        w.put((32 + 1) << 1, 8)
        for s in samples[:2]:
            w.put(s & 255, 8)
        w.put(4 - 1, 4), w.put(1, 5), w.put(3, 4), w.put(-2 & 15, 4), w.put(0, 2), w.put(1, 4)
        residual = [samples[i] - ((3 * samples[i - 1] - 2 * samples[i - 2]) >> 1) for i in range(2, 64)]
        w.put(0, 4)
        for r in residual[:30]:
            w.rice(r, 0)
        w.put(15, 4), w.put(11, 5)
        for r in residual[30:]:
            w.put(r & 2047, 11)

    def verbatim(w):
        w.put(2, 8)
        for s in samples:
            w.put(s & 255, 8)

    def constant(w):
        w.put(0, 8), w.put(7, 8)

    want = bytes(s + 128 for s in samples)
    assert flac.decode([_file(samples, lpc)])[0][0] == want
    assert flac.decode([_file(samples, verbatim)])[0][0] == want
    assert flac.decode([_file([7] * 64, constant)])[0][0] == bytes([135] * 64)


def test_crc_tables_match_plain_crcs():
    data = b"123456789"
    raw = np.frombuffer(data, np.uint8)
    assert int(flac._crcs(raw, np.array([0]), np.array([9]), 8)[0]) == 0xF4 and int(flac._crcs(raw, np.array([0]), np.array([9]), 16)[0]) == 0xFEE8


def test_media_query_values(spark):
    docs = awkward(spark)
    texts = sorted((d.text or "") for d in docs.collect())
    rows = flac.media_features(flac.encode_media(docs)).collect()
    want = sorted((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for p in (flac.payload(t.encode()) for t in texts))
    assert sorted((r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    twice = [r for r in rows if r.doc_id == 7]
    assert len(twice) == 2 and twice[0] == twice[1]
    blocks = flac.pcm_blocks(flac.encode_media(docs.filter("doc_id = 6"))).orderBy("block").collect()
    assert b"".join(b.pcm for b in blocks) == flac.payload(docs.filter("doc_id = 6").first().text.encode()) and blocks[3].sample_offset == 3 * flac.BLOCK
    assert flac.media_features(flac.encode_media(empty(spark))).count() == 0


def test_stored_media_of_a_whole_table(spark):
    """Written, read back, cut into blocks and read back again: the values of every document; nothing but features is left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in flac.stored_features(docs, slices=3).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        p, r = flac.payload(text), rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        media = flac.encode([p])[0]
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), flac.feature(p))
    folder = shared_dir(spark, "media-test")
    rows = flac.stored_features(awkward(spark), folder).collect()
    assert len(rows) == 11 and {p.name.split("-")[0] for p in Path(urlparse(folder).path).iterdir()} == {"features"}
    assert flac.stored_features(empty(spark)).count() == 0


def test_blocks_out_of_place_are_refused(spark):
    media = flac.pcm_table(flac.encode_media(awkward(spark).filter("doc_id = 6")))
    shifted = media.withColumn("blocks", F.expr("slice(blocks, 2, 5)"))
    with pytest.raises(Exception, match="does not start"):
        flac.block_features(shifted).collect()
