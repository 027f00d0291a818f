"""Sum-of-squares packing of token streams into windows.

Every scan partition is one online stream with a level array: `count[h]` is the
number of its open windows filled up to level h. Whole windows are cut off a
document's front; the rest of r tokens goes to the level h (0: a new window)
that makes the sum of squared counts least, that is, that minimises
count[h + r] - count[h]. Ties take the fuller level. At the stream's end the
open windows are merged, emptiest into fullest, by cutting; the one window that
stays partial is cut into sequences of powers of two, which need no padding.
No row moves between partitions, so no key can be hot, and what a task holds is
its open windows, not its input.

Defined cases: null and empty texts are one end token; repeated rows and equal
doc_ids are packed like any other rows; a null doc_id stays null; an empty table
gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.shared import small_batches
from pointloom.llm.tokens import encoder, public_path

WINDOW = 2048
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = ", ".join(f"`{c}` long" for c in COLUMNS)
_PARTITION_BITS = 40  # a sequence_id is the stream's number and the sequence's number in it


class Stream:
    """One online packing stream; `emit` gets (document, start, ids, sequence, offset)."""

    def __init__(self, window: int, emit: Callable[[tuple, int, np.ndarray, int, int], None]):
        self.window, self.emit, self.sequences = window, emit, 0
        # As the change of the sum of squares needs them: half a window open at level 0, minus half at the full level.
        self.count = np.zeros(window + 1)
        self.count[0], self.count[window] = 0.5, -0.5
        self.free = np.ones(window + 1, bool)  # levels without an open window; level 0 always has one
        self.free[0] = False
        self.open: list[list[list]] = [[] for _ in range(window)]

    def _next(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def _close(self, pieces: list[tuple]) -> None:
        sequence, offset = self._next(), 0
        for document, start, ids in pieces:
            self.emit(document, start, ids, sequence, offset)
            offset += len(ids)

    def _count(self, level: int, by: int) -> None:
        if 0 < level < self.window:
            self.count[level] += by
            self.free[level] = self.count[level] == 0

    def level_for(self, size: int) -> int:
        """The fill level at which a rest of this size makes the sum of squares least."""
        top = self.window - size
        change = self.count[size:] - self.count[: top + 1]
        change[self.free[: top + 1]] = np.inf
        return top - int(change[::-1].argmin())

    def add(self, document: tuple, ids: np.ndarray) -> None:
        start, n = 0, len(ids)
        while n - start >= self.window:
            self._close([(document, start, ids[start : start + self.window])])
            start += self.window
        size = n - start
        if not size:
            return
        level = self.level_for(size)
        pieces = self.open[level].pop() if level else []
        pieces.append((document, start, ids[start:].copy()))
        self._count(level, -1)
        if level + size == self.window:
            self._close(pieces)
        else:
            self._count(level + size, 1)
            self.open[level + size].append(pieces)

    def finish(self) -> None:
        """Merge the open windows by cutting and end with sequences of powers of two."""
        rest = [(level, pieces) for level in range(self.window - 1, 0, -1) for pieces in self.open[level]]
        self.open = [[] for _ in range(self.window)]
        give: list[tuple] = []  # pieces of the emptiest window, last first
        first, last = 0, len(rest) - 1
        while first <= last:
            level, pieces = rest[first]
            if first == last and not give:
                give = pieces[::-1]
                break
            need = self.window - level
            while need and (give or last > first):
                if not give:
                    give, last = rest[last][1][::-1], last - 1
                document, start, ids = give.pop()
                if len(ids) > need:
                    give.append((document, start + need, ids[need:]))
                    ids = ids[:need]
                pieces.append((document, start, ids))
                need -= len(ids)
            if need:
                give = pieces[::-1]
                break
            self._close(pieces)
            first += 1
        left = sum(len(p[2]) for p in give)
        while left:
            need = size = min(self.window, 1 << (left.bit_length() - 1))
            pieces = []
            while need:
                document, start, ids = give.pop()
                if len(ids) > need:
                    give.append((document, start + need, ids[need:]))
                    ids = ids[:need]
                pieces.append((document, start, ids))
                need -= len(ids)
            self._close(pieces)
            left -= size


def pack_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, window: int, stream_id: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the documents of one stream."""
    encode = encoder(path).encode
    rows: list[tuple] = []

    def emit(document: tuple, start: int, ids: np.ndarray, sequence: int, offset: int) -> None:
        rows.append((document[0], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), document[1], (stream_id << _PARTITION_BITS) | sequence, offset))

    def taken() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(COLUMNS)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COLUMNS))

    stream = Stream(window, emit)
    for batch in small_batches(batches):
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
            ids = np.append(ids, np.uint32(end_id))
            stream.add((doc_id, len(ids)), ids)
        yield taken()
    stream.finish()
    yield taken()


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of at most `window` ids."""
    path = tokenizer_path or public_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        return pack_batches(batches, path, end_id, window, context.partitionId() if context else 0)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
