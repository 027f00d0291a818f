"""Token ids in seekable zstandard files.

A file holds the ids of a range of documents in ascending doc_id order, as
little-endian unsigned 32-bit integers in independent zstandard frames of
`frame_ids` ids each. Two skippable frames follow: the list of documents
(doc_id, count of ids; itself compressed) and the public seek table with the
sizes and a checksum (low half of XXH64) of every frame. Any zstandard decoder reads
the ids; a reader that wants some documents decompresses only their frames.

Writers put each file under a name of its own in the shared folder and return a
manifest row; a manifest only lists files of tasks that succeeded, so retried
tasks leave nothing that is read.

Defined cases: null and empty texts hold the end id alone; a null doc_id comes
first; rows of one doc_id (or of none) stand next to each other, each with its own ids, ordered by hash and bytes of their text, so reruns
agree, and are split between files like any other rows; an empty table gives an empty manifest and no rows; other input columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointloom.llm.shared import shared_dir, small_batches, written
from pointloom.llm.tokens import encoder, public_path

FRAME_IDS = 1 << 17
#: Fixed values of the public seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_NO_DOC = np.iinfo(np.int64).min  # stands for a null doc_id
MANIFEST = "part int, path string, documents long, ids long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


class TokenWriter:
    """Writes one file to a binary stream."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 1):
        self.out, self.frame_ids, self.zip = out, frame_ids, zstandard.ZstdCompressor(level=level)
        self.docs: list[int] = []
        self.counts: list[int] = []
        self.frames: list[tuple[int, int, int]] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(_NO_DOC if doc_id is None else doc_id)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.frame_ids:
            all_ids = np.concatenate(self.waiting)
            whole = len(all_ids) // self.frame_ids * self.frame_ids
            for k in range(0, whole, self.frame_ids):
                self._frame(all_ids[k : k + self.frame_ids])
            self.waiting, self.n_waiting = [all_ids[whole:]], len(all_ids) - whole

    def _frame(self, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        packed = self.zip.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.n_waiting:
            self._frame(np.concatenate(self.waiting))
        listed = self.zip.compress(np.array([self.docs, self.counts], "<i8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(listed)) + listed)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class TokenFile:
    """Reads a file: `docs`, `counts`, and the ids of any document."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_FOOTER or not flags & 0x80:
            raise ValueError("not a seekable file with checksums")
        table = self._read(size - 17 - 12 * n, 8 + 12 * n)
        if struct.unpack_from("<II", table) != (SKIPPABLE_SEEK, 12 * n + 9):
            raise ValueError("broken seek table")
        self.frames = np.frombuffer(table, "<u4", 3 * n, 8).reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.first = np.concatenate([[0], np.cumsum(self.frames[:, 1])]) // 4
        magic, length = struct.unpack("<II", self._read(int(self.at[-1]), 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no list of documents")
        self.docs, self.counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._read(int(self.at[-1]) + 8, length)), "<i8").reshape(2, -1)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError("file ends early")
        return data

    def frame(self, k: int) -> np.ndarray:
        """The ids of frame k, checked."""
        packed, size, check = self.frames[k]
        raw = zstandard.ZstdDecompressor().decompress(self._read(int(self.at[k]), int(packed)), max_output_size=int(size))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document, from its frames alone."""
        a, b = self.starts[i], self.starts[i + 1]
        if a == b:
            return np.zeros(0, "<u4")
        first, last = np.searchsorted(self.first, a, "right") - 1, np.searchsorted(self.first, b, "left")
        return np.concatenate([self.frame(k) for k in range(first, last)])[a - self.first[first] : b - self.first[first]]

    def each(self) -> Iterator[np.ndarray]:
        """The ids of all documents in order; every frame is decompressed once."""
        rest, k = np.zeros(0, "<u4"), 0
        for n in self.counts.tolist():
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.frame(k))
                have, k = have + len(parts[-1]), k + 1
            rest = np.concatenate(parts) if len(parts) > 1 else rest
            yield rest[:n]
            rest = rest[n:]


def write_token_files(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, folder: str | None = None, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Write all documents (doc_id, text) in ascending doc_id order; returns the manifest, one row a file."""
    path, spark = tokenizer_path or public_path("word_bpe_49k.json"), docs.sparkSession
    folder = folder or shared_dir(spark, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, name = encoder(path).encode, None, f"{folder}/ids-{uuid.uuid4().hex}.zst"
        for batch in small_batches(batches):
            if out is None:
                system, place = fs.FileSystem.from_uri(folder)
                system.create_dir(place, recursive=True)
                out = system.open_output_stream(f"{place}/{name.rpartition('/')[2]}", compression=None)
                writer, total = TokenWriter(out, frame_ids), 0
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                writer.add(doc_id, np.append(ids, np.uint32(end_id)))
                total += len(ids) + 1
        if out is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([len(writer.docs)], pa.int64()), pa.array([total], pa.int64())], names=["part", "path", "documents", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return written(ordered.mapInArrow(run, MANIFEST), f"{folder}/manifest")


def read_token_files(manifest: DataFrame, batch_docs: int = 10_000) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens and the ids' CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                system, place = fs.FileSystem.from_uri(name)
                with system.open_input_file(place) as source:
                    file = TokenFile(source)
                    crcs = (zlib.crc32(ids.tobytes()) for ids in file.each())
                    for k in range(0, len(file.docs), batch_docs):
                        d, n = file.docs[k : k + batch_docs], file.counts[k : k + batch_docs]
                        found = [next(crcs) for _ in range(len(d))]
                        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64(), mask=d == _NO_DOC), pa.array(file.starts[k : k + len(d)] + base), pa.array(n), pa.array(found, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row a file, so the running sum over all of them is small.
    based = manifest.withColumn("base", F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("ids"))
    return based.select("path", "base").repartition(max(1, manifest.count())).mapInArrow(run, RESULT)
