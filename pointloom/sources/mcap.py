"""A Spark data source for PointCloud2 messages in MCAP files, for batches and streams.

    spark.dataSource.register(McapSource)
    spark.read.format("mcap_points").option("topic", "/points").load(path)
    spark.readStream.format("mcap_points").load(folder)

gives one row a message: frame_id, ts, ts_ns, points (array of x, y, z, intensity), error, topic. A
directory stands for its *.mcap files in sorted order. With an absent topic any topic of the type is read. Messages that
cannot be decoded, and chunks that do not match their checksum, become rows with their error (mode PERMISSIVE), are dropped (DROPMALFORMED) or fail (FAILFAST).

Files are planned by their chunk index, which stands at their end: a partition is a run of consecutive chunks of at most
`split_bytes`, and a task reads and holds one chunk at a time. Chunks that hold no wanted topic, or lie outside
`start_ns` to `end_ns`, are not read. With the option `pushdown` (and spark.sql.python.filterPushdown.enabled) filters on ts_ns and topic do the same. A file
without an index, such as a recording that has not ended, is one partition, for whose plan only the headers of its records are read.

A stream's offset holds, for each file of the folder, how many chunks have been taken; a growing file
is taken as far as its chunks are whole, and files that have left the folder leave the offset. So a restart from the checkpoint
neither loses nor repeats frames. Messages outside chunks are a file's last unit, which a stream takes when the file has
ended. A stream takes a named topic as it is, without the fallback, since it can't know what is still to come; its frame_id is a hash of the
file's name and the frame's place in it, as files have no lasting number.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import BinaryIO

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "frame_id long, ts timestamp, ts_ns long, points array<struct<x:float,y:float,z:float,intensity:float>>, error string, topic string"
#: Fixed values of the public file format.
MAGIC = b"\x89MCAP0\r\n"
FOOTER, SCHEMA_RECORD, CHANNEL, MESSAGE, CHUNK, CHUNK_INDEX, DATA_END = 0x02, 0x03, 0x04, 0x05, 0x06, 0x08, 0x0F
HEAD, FOOTER_BYTES = 9, 20
TYPES = ("sensor_msgs/msg/PointCloud2", "sensor_msgs/PointCloud2")
DEFAULT_OFFSETS = {"x": 0, "y": 4, "z": 8, "intensity": 12}
DEFAULT_INTENSITY = 100.0
SPLIT_BYTES = 64 << 20
_LATEST = (1 << 63) - 1


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(opcode, content) of the records in data; a cut-off record ends it."""
    at = 0
    while at + HEAD <= len(data):
        op, n = struct.unpack_from("<BQ", data, at)
        at += HEAD
        if at + n > len(data):
            return
        yield op, data[at : at + n]
        at += n


def _text(data: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", data, at)[0]
    return data[at + 4 : at + 4 + n].decode(), at + 4 + n


def _inflate(name: str, data: bytes, size: int) -> bytes:
    if name == "":
        return data
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    if name == "lz4":
        import pyarrow as pa

        return pa.CompressedInputStream(io.BytesIO(data), "lz4").read()
    raise ValueError(f"unknown compression {name}")


@dataclass
class Channels:
    """The point-cloud channels of a file as far as they are known: number -> topic."""

    schemas: dict[int, str] = field(default_factory=dict)
    topics: dict[int, str] = field(default_factory=dict)

    def learn(self, op: int, body: bytes) -> None:
        if op == SCHEMA_RECORD:
            self.schemas[struct.unpack_from("<H", body)[0]] = _text(body, 2)[0]
        elif op == CHANNEL:
            number, schema = struct.unpack_from("<HH", body)
            if self.schemas.get(schema) in TYPES:
                self.topics[number] = _text(body, 4)[0]


@dataclass
class Piece:
    """A chunk, or a message outside chunks, of a file: where its record's content stands, its log times, and the channels it may hold (none: any)."""

    at: int
    size: int
    first_ns: int = 0
    last_ns: int = _LATEST
    channels: tuple[int, ...] = ()
    chunk: bool = True


@dataclass
class Layout:
    """What planning knows of a file. Without an index, channels must be learned from what stands before a piece."""

    chunks: list[Piece]
    loose: list[Piece]
    channels: Channels
    indexed: bool
    ended: bool


def _indexed(source: BinaryIO, size: int) -> Layout | None:
    """The layout by the chunk index behind the data; None if the file has none."""
    tail = HEAD + FOOTER_BYTES + len(MAGIC)
    if size < len(MAGIC) + tail:
        return None
    source.seek(size - tail)
    end = source.read(tail)
    op, n, summary = struct.unpack_from("<BQQ", end)
    if not end.endswith(MAGIC) or op != FOOTER or n != FOOTER_BYTES or not summary:
        return None
    source.seek(summary)
    channels, chunks = Channels(), []
    for op, body in records(source.read(size - tail - summary)):
        channels.learn(op, body)
        if op == CHUNK_INDEX:
            first, last, at, length, n = struct.unpack_from("<QQQQI", body)
            held = tuple(struct.unpack_from("<H", body, 36 + k)[0] for k in range(0, n, 10))
            chunks.append(Piece(at + HEAD, length - HEAD, first, last, held))
    return Layout(sorted(chunks, key=lambda c: c.at), [], channels, True, True) if chunks and channels.topics else None


def _walked(source: BinaryIO, size: int) -> Layout:
    """The layout by the headers of all records; schemas and channels outside chunks are read, bodies of chunks and messages are not."""
    out, at = Layout([], [], Channels(), False, False), len(MAGIC)
    while at + HEAD <= size:
        source.seek(at)
        op, n = struct.unpack("<BQ", source.read(HEAD))
        at += HEAD
        if op in (DATA_END, FOOTER):
            out.ended = True
            break
        if at + n > size:
            break
        if op == CHUNK:
            first, last = struct.unpack("<QQ", source.read(16))
            out.chunks.append(Piece(at, n, first, last if last else _LATEST))
        elif op == MESSAGE:
            number, _, ns = struct.unpack("<HIQ", source.read(14))
            out.loose.append(Piece(at, n, ns, ns, (number,), False))
        elif op in (SCHEMA_RECORD, CHANNEL):
            out.channels.learn(op, source.read(n))
        at += n
    return out


def layout(source: BinaryIO, size: int) -> Layout:
    """Where the chunks and loose messages of a file stand."""
    source.seek(0)
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not an MCAP file")
    return _indexed(source, size) or _walked(source, size)


def _records_of(source: BinaryIO, piece: Piece) -> Iterator[tuple[int, bytes]]:
    """The records of a piece, read and inflated now."""
    source.seek(piece.at)
    body = source.read(piece.size)
    if not piece.chunk:
        yield MESSAGE, body
        return
    _, _, size, crc = struct.unpack_from("<QQQI", body)
    name, at = _text(body, 28)
    n = struct.unpack_from("<Q", body, at)[0]
    data = _inflate(name, body[at + 8 : at + 8 + n], size)
    if crc and zlib.crc32(data) != crc:
        raise ValueError("a chunk does not match its checksum")
    yield from records(data)


class _Cdr:
    """A little-endian CDR reader; alignment counts from behind the four header bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 4

    def number(self, kind: str, size: int) -> int:
        self.at += -(self.at - 4) % size
        value = struct.unpack_from("<" + kind, self.data, self.at)[0]
        self.at += size
        return value

    def text(self) -> str:
        n = self.number("I", 4)
        self.at += n
        return self.data[self.at - n : self.at - 1].decode()

    def block(self) -> bytes:
        n = self.number("I", 4)
        self.at += n
        return self.data[self.at - n : self.at]


def _declared(cdr: _Cdr) -> dict[str, int]:
    """Offsets of a message's fields by name."""
    out = {}
    for _ in range(cdr.number("I", 4)):
        name = cdr.text()
        out[name] = cdr.number("I", 4)
        cdr.number("B", 1), cdr.number("I", 4)  # type and count: all that is used is a 32-bit float
    return out


def decode_cloud(message: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(n x 3 positions, n intensities) of a serialized message; rows with a non-finite position go."""
    cdr = _Cdr(message)
    cdr.number("i", 4), cdr.number("I", 4), cdr.text()  # stamp and frame
    count = cdr.number("I", 4) * cdr.number("I", 4)
    places = DEFAULT_OFFSETS | _declared(cdr)
    cdr.number("B", 1)
    item = cdr.number("I", 4)
    cdr.number("I", 4)
    data = cdr.block()
    names = [c for c in DEFAULT_OFFSETS if c != "intensity" or places[c] + 4 <= item]
    point = np.dtype({"names": names, "formats": ["<f4"] * len(names), "offsets": [places[c] for c in names], "itemsize": item})
    cloud = np.frombuffer(data, point, count or len(data) // item)
    xyz = np.stack([cloud[c] for c in "xyz"], axis=1)
    finite = np.isfinite(xyz).all(axis=1)
    intensity = cloud["intensity"] if "intensity" in names else np.full(len(cloud), DEFAULT_INTENSITY, np.float32)
    return xyz[finite], intensity[finite]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, str]]:
    """(name, path) of a file, or of the *.mcap files of a folder in sorted order."""
    from pyarrow import fs

    system, place = _filesystem(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path.rpartition("/")[2], path)]
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(place)) if f.path.endswith(".mcap"))
    return [(n, f"{path.rstrip('/')}/{n}") for n in names]


def _open(path: str):
    system, place = _filesystem(path)
    return system.open_input_file(place)


def _layout_of(path: str) -> Layout:
    with _open(path) as source:
        return layout(source, source.size())


def _layouts(files: list[tuple[str, str]]) -> list[Layout]:
    """Layouts of many files; what is read of each is small, so the waiting is done side by side."""
    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(_layout_of, [path for _, path in files]))


@dataclass
class Part(InputPartition):
    """Pieces of one file, with their numbers, and what must be read before them to know their channels."""

    file: int
    path: str
    pieces: list[tuple[int, Piece]]
    before: list[Piece]
    channels: Channels
    topics: frozenset[str] | None  # None: not known before reading

    @property
    def bytes(self) -> int:
        return sum(p.size for _, p in self.pieces)


class _Scan:
    """Options, planning and reading, the same for batches and streams."""

    exact = False  # whether a named topic has no fallback

    def __init__(self, options: dict):
        self.path, self.topic, self.mode = options["path"], options.get("topic"), options.get("mode", "PERMISSIVE").upper()
        self.first_ns, self.last_ns = int(options.get("start_ns", 0)), int(options.get("end_ns", _LATEST))
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.only: str | None = None  # a topic that a filter asks for

    def wanted(self, topics: Iterable[str]) -> frozenset[str]:
        """The topics to read of those in a file: the named one, any if it is absent; and of these the one a filter asks for."""
        there = frozenset(topics)
        chosen = there & {self.topic} if self.topic is not None and (self.exact or self.topic in there) else there
        return chosen & {self.only} if self.only is not None else chosen

    def plan(self, file: int, path: str, found: Layout, taken: int = 0, upto: int | None = None, loose: bool = True) -> list[Part]:
        """Partitions for the chunks from `taken` to `upto`, and the loose messages."""
        topics = self.wanted(found.channels.topics.values()) if found.indexed else None
        numbers = {n for n, t in found.channels.topics.items() if topics is None or t in topics}

        def needed(p: Piece) -> bool:
            return p.first_ns <= self.last_ns and p.last_ns >= self.first_ns and (not found.indexed or not p.channels or not numbers.isdisjoint(p.channels))

        chunks = list(enumerate(found.chunks, 1))[taken:upto]
        if not found.indexed:
            pieces = chunks + [(0, p) for p in found.loose] * loose
            return [Part(file, path, pieces, found.chunks[:taken], found.channels, None)] if pieces else []
        parts, size = [], 0
        for k, p in chunks:
            if needed(p):
                if not parts or size + p.size > self.split_bytes:
                    parts.append(Part(file, path, [], [], found.channels, topics))
                    size = 0
                parts[-1].pieces.append((k, p))
                size += p.size
        return parts

    def _topics(self, source: BinaryIO, part: Part) -> frozenset[str] | None:
        """The wanted topics of a file without an index; None stands for all. A fallback depends on the topics it has messages of, so these are read first."""
        for p in part.before:
            for op, body in _records_of(source, p):
                part.channels.learn(op, body)
        if self.topic is None:
            return None if self.only is None else frozenset([self.only])
        seen = {self.topic} if self.exact else set()
        for _, p in () if self.exact else part.pieces:
            try:
                for op, body in _records_of(source, p):
                    part.channels.learn(op, body)
                    if op == MESSAGE:
                        seen.add(part.channels.topics.get(struct.unpack_from("<H", body)[0]))
            except Exception:  # reading reports it
                continue
        return self.wanted(seen - {None})

    def place(self, part: Part, chunk: int, index: int) -> int:
        """frame_id: file, chunk (from 1 on) and message in it; messages outside chunks are counted behind the highest chunk."""
        return part.file << 40 | (chunk << 20 | index if chunk else 1 << 39 | index)

    def rows(self, part: Part) -> Iterator[tuple]:
        """The frames of a partition, a chunk at a time."""
        with _open(part.path) as source:
            topics = part.topics if part.topics is not None else self._topics(source, part)
            loose = 0
            for k, piece in part.pieces:
                i = loose if not k else 0
                try:
                    for op, body in _records_of(source, piece):
                        part.channels.learn(op, body)
                        if op == MESSAGE:
                            number, _, ns = struct.unpack_from("<HIQ", body)
                            topic = part.channels.topics.get(number)
                            if topic is not None and (topics is None or topic in topics) and self.first_ns <= ns <= self.last_ns:
                                yield from self._frame(self.place(part, k, i), ns, topic, body[22:])
                            i += topic is not None
                except Exception as e:
                    if self.mode == "FAILFAST":
                        raise
                    if self.mode == "PERMISSIVE":
                        yield self.place(part, k, i), None, None, None, f"{type(e).__name__}: {e}", None
                loose = loose if k else i
        if part.topics is None and not part.channels.topics and not self.exact:
            raise ValueError(f"no point-cloud topic in {part.path}")

    def _frame(self, frame: int, ns: int, topic: str, message: bytes) -> Iterator[tuple]:
        points, error = None, None
        try:
            xyz, intensity = decode_cloud(message)
            points = list(zip(*(c.tolist() for c in (*xyz.T, intensity)), strict=True))
        except Exception as e:
            if self.mode == "FAILFAST":
                raise
            if self.mode == "DROPMALFORMED":
                return
            error = f"{type(e).__name__}: {e}"
        yield frame, datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=ns // 1000), ns, points, error, topic


class McapReader(_Scan, DataSourceReader):
    """The batch scan: chunks of all files, split over partitions."""

    def partitions(self) -> list[Part]:
        files = _files(self.path)
        if not files:
            raise FileNotFoundError(f"no *.mcap in {self.path}")
        parts: list[Part] = []
        for i, ((_, path), found) in enumerate(zip(files, _layouts(files), strict=True)):
            if found.indexed and not found.channels.topics:
                raise ValueError(f"no point-cloud topic in {path}")
            parts += self.plan(i, path, found)
        return parts or [Part(0, files[0][1], [], [], Channels(), frozenset())]

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.rows(partition)


class PushingReader(McapReader):
    """The batch scan that also takes filters on ts_ns and topic; Spark checks them again."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("ts_ns",) and isinstance(value, int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.first_ns = max(self.first_ns, value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.last_ns = min(self.last_ns, value - isinstance(f, LessThan))
            elif column == ("topic",) and isinstance(f, EqualTo):
                self.only = value
            yield f


class McapStreamReader(_Scan, DataSourceStreamReader):
    """The stream over a folder. Offsets: name of a file -> [chunks taken, 1 if it has ended]."""

    exact = True

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _files(self.path)
        return {name: [len(found.chunks), int(found.ended)] for (name, _), found in zip(files, _layouts(files), strict=True)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        paths, parts = dict(_files(self.path)), []
        for name, (upto, ended) in sorted(end.items()):
            taken, had = start.get(name, [0, 0])
            if name in paths and (upto > taken or ended > had):
                parts += self.plan(0, paths[name], _layout_of(paths[name]), taken, upto, bool(ended and not had))
        return parts or [Part(0, "", [], [], Channels(), frozenset())]

    def place(self, part: Part, chunk: int, index: int) -> int:
        """frame_id: a hash of the file's name and the place in it."""
        where = f"{part.path.rpartition('/')[2]}:{super().place(part, chunk, index)}"
        return int.from_bytes(hashlib.blake2b(where.encode(), digest_size=8).digest(), "little") >> 1

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.rows(partition) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        """Offsets live in the checkpoint; nothing to do."""


class McapSource(DataSource):
    """The data source `mcap_points`."""

    @classmethod
    def name(cls) -> str:
        return "mcap_points"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (PushingReader if options.get("pushdown", "").lower() == "true" else McapReader)(options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return McapStreamReader(dict(self.options))
