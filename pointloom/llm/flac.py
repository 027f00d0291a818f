"""FLAC for 8-bit mono columns: encoding, checked decoding, and seekable PCM blocks.

Both directions work on many frames at once: step i handles sample i of every
frame of a batch, so Rice codes, whose ends are known only one after another,
still decode with NumPy operations. The decoder reads constant, verbatim, fixed and
LPC subframes, Rice partitions of both methods and escaped partitions; it
checks every frame's CRC-8 and CRC-16 and the stream's MD5 and raises ValueError on a
mismatch. Files carry a seek point for every frame.

Defined cases: null text or bytes count as empty; a payload is the bytes with
zeros up to a positive multiple of 64; equal payloads give equal files, so repeated rows give equal rows; a null
doc_id stays null; an empty table gives no rows; other input columns, whatever their names, are ignored. Long payloads are cut into frames, and frames are worked
off in groups of FRAMES, so memory does not follow a document's length much beyond its own bytes.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.shared import discard, shared_dir, small_batches, written

BLOCK = 1024  # samples of a frame
PAD = 64
RATE_CODE, RATE = 4, 8000  # fixed value of the format: code 4 is 8 kHz
FRAMES = 1024  # frames that are coded together
SLICES = 4
_MAX_ORDER = 2
_MAX_QUOTIENT = 15


@functools.cache
def _crc_table(bits: int, poly: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, table << 1 ^ poly, table << 1) & ((1 << bits) - 1)
    return table.astype(np.uint16)


def _crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """CRC-8 (polynomial 7) or CRC-16 (0x8005) of many ranges of data at once."""
    table = _crc_table(bits, 0x07 if bits == 8 else 0x8005)
    order = np.argsort(-sizes, kind="stable")
    at, n, out = starts[order], sizes[order], np.zeros(len(starts), np.uint16)
    live = len(at) - np.searchsorted(n[::-1], np.arange(int(n[0]) if len(n) else 0), "right")
    for i, k in enumerate(live.tolist()):
        crc, byte = out[:k], data[at[:k] + i]
        out[:k] = table[crc ^ byte] if bits == 8 else table[(crc >> 8) ^ byte] ^ (crc << 8)
    result = np.empty_like(out)
    result[order] = out
    return result


def _frame_number(n: int) -> bytes:
    """A frame's number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    more = next(c for c in range(1, 7) if n < 1 << (6 + 5 * c))
    lead = 0xFF00 >> (more + 1) & 0xFF | n >> 6 * more
    return bytes([lead, *(0x80 | n >> 6 * c & 0x3F for c in range(more - 1, -1, -1))])


def payload(data: bytes | None) -> bytes:
    """The bytes with zeros up to a positive multiple of PAD."""
    data = data or b""
    return data + bytes(-len(data) % PAD if data else PAD)


def _encode_frames(samples: np.ndarray, sizes: np.ndarray, numbers: list[int]) -> list[bytes]:
    """FLAC frames of consecutive runs of samples (int16 values of 8 bits)."""
    f, width = len(sizes), int(sizes.max())
    inside = np.arange(width) < sizes[:, None]
    x = np.zeros((f, width), np.int16)
    x[inside] = samples
    best, residual, order = None, x, np.zeros(f, np.int64)
    current = x
    for p in range(_MAX_ORDER + 1):
        if p:
            current = np.diff(current, axis=1, prepend=0)
        cost = np.where(inside, np.abs(current), 0)[:, p:].sum(axis=1, dtype=np.int64)
        if best is None:
            best = cost
        else:
            less = cost < best
            best = np.where(less, cost, best)
            residual = np.where(less[:, None], current, residual)
            order = np.where(less, p, order)
    coded = inside & (np.arange(width) >= order[:, None])
    folded = np.where(coded, (residual << 1) ^ (residual >> 15), 0).astype(np.int32)
    count = sizes - order
    top = folded.max(axis=1)
    least = np.maximum(0, np.ceil(np.log2((top + 1) / (_MAX_QUOTIENT + 1))).astype(np.int64))
    mean = folded.sum(axis=1) / np.maximum(count, 1)
    guess = np.maximum(least, np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64))
    rice, bits = guess, None
    for k in (guess, np.maximum(least, guess - 1)):
        total = (folded >> k[:, None]).sum(axis=1) + count * (k + 1)
        rice = k if bits is None else np.where(total < bits, k, rice)
        bits = total if bits is None else np.minimum(bits, total)

    heads = []
    for n, number in zip(sizes.tolist(), numbers, strict=True):
        coded_number = _frame_number(number)
        heads.append(b"\xff\xf8" + bytes([(10 if n == BLOCK else 7) << 4 | RATE_CODE, 1 << 1]) + coded_number + (b"" if n == BLOCK else struct.pack(">H", n - 1)))
    head_size = np.array([len(h) for h in heads])
    first_bit = 8 * (head_size + 2 + order) + 10
    frame_size = (first_bit + bits + 7) // 8 + 2
    starts = np.concatenate([[0], np.cumsum(frame_size)])

    k = rice[:, None]
    length = np.where(coded, (folded >> k) + 1 + k, 0)
    ends = (8 * starts[:-1] + first_bit)[:, None] + np.cumsum(length, axis=1)
    value = ((1 << k) | folded & ((1 << k) - 1))[coded].astype(np.int64)
    last = ends[coded] - 1
    value <<= 31 - (last & 31)
    words = int(starts[-1] + 7) // 4 + 1
    low = np.bincount(last >> 5, value & 0xFFFFFFFF, words + 1)
    high = np.bincount((last >> 5) + words * (last < 32), value >> 32, words + 1)  # goes one word before
    low[: words - 1] += high[1:words]
    out = low[:words].astype(np.uint64).astype(">u4").view(np.uint8)
    for i, h in enumerate(heads):
        out[starts[i] : starts[i] + len(h)] = np.frombuffer(h, np.uint8)
    at = starts[:-1]
    out[at + head_size] = _crcs(out, at, head_size, 8)
    at = at + head_size + 1
    out[at] = (8 | order) << 1
    for p in range(_MAX_ORDER):
        has = order > p
        out[at[has] + 1 + p] = x[has, p].astype(np.uint8)
    at = at + 1 + order
    out[at] |= (rice >> 2).astype(np.uint8)
    out[at + 1] |= ((rice & 3) << 6).astype(np.uint8)
    crc = _crcs(out, starts[:-1], frame_size - 2, 16)
    out[starts[1:] - 2], out[starts[1:] - 1] = crc >> 8, crc & 0xFF
    whole = out.tobytes()
    return [whole[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """One FLAC file for each payload; a byte b is the sample b - 128."""
    cuts = [(i, k, len(p)) for i, p in enumerate(payloads) for k in range(0, len(p), BLOCK)]
    cuts.sort(key=lambda c: min(BLOCK, c[2] - c[1]), reverse=True)  # frames of like size together
    frames: dict[tuple[int, int], bytes] = {}
    for g in range(0, len(cuts), FRAMES):
        group = cuts[g : g + FRAMES]
        data = b"".join(payloads[i][k : k + BLOCK] for i, k, _ in group)
        samples = np.frombuffer(data, np.uint8).astype(np.int16) - 128
        sizes = np.array([min(BLOCK, n - k) for _, k, n in group], np.int64)
        made = _encode_frames(samples, sizes, [k // BLOCK for _, k, _ in group])
        frames.update(((i, k), f) for (i, k, _), f in zip(group, made, strict=True))
    out = []
    for i, p in enumerate(payloads):
        own = [frames[i, k] for k in range(0, len(p), BLOCK)]
        md5 = hashlib.md5(p.translate(_FLIP)).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + bytes(6) + struct.pack(">Q", RATE << 44 | 7 << 36 | len(p)) + md5
        points, offset = [], 0
        for j, f in enumerate(own):
            points.append(struct.pack(">QQH", j * BLOCK, offset, min(BLOCK, len(p) - j * BLOCK)))
            offset += len(f)
        seek = b"".join(points)
        if len(seek) < 1 << 24:
            blocks = b"\x00\x00\x00\x22" + info + b"\x83" + len(seek).to_bytes(3, "big") + seek
        else:  # a block of metadata holds less than 16 MB
            blocks = b"\x80\x00\x00\x22" + info
        out.append(b"fLaC" + blocks + b"".join(own))
    return out


_FLIP = bytes(b ^ 0x80 for b in range(256))


class _Bits:
    """Bits of one frame, for what is not decoded in step with others."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - n) & ((1 << n) - 1)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value


class _Frame:
    """The header and subframe parameters of one frame."""

    __slots__ = ("size", "number", "head", "kind", "order", "warm", "coefficients", "shift", "method", "parts", "bit", "rest")

    def __init__(self, data: bytes, at: int):
        if data[at : at + 2] != b"\xff\xf8":
            raise ValueError("no frame of a fixed block size here")
        code, number, k = data[at + 2] >> 4, data[at + 4], at + 5
        if number >= 0xC0:
            more = 7 - (number ^ 0xFF).bit_length()
            number &= (1 << (6 - more)) - 1
            for b in data[k : k + more]:
                number = number << 6 | b & 0x3F
            k += more
        if code == 6:
            self.size, k = data[k] + 1, k + 1
        elif code == 7:
            self.size, k = int.from_bytes(data[k : k + 2], "big") + 1, k + 2
        else:
            self.size = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
        k += {12: 1, 13: 2, 14: 2}.get(data[at + 2] & 15, 0)
        if data[at + 3] & 0xF0 or data[at + 3] >> 1 & 7 not in (0, 1):
            raise ValueError("only mono streams of 8 bits are read")
        self.number, self.head = number, k - at
        kind = data[k + 1] >> 1
        if data[k + 1] & 1:
            raise ValueError("wasted bits are not read")
        bits = _Bits(data, 8 * (k + 2))
        self.coefficients, self.shift, self.order, self.method, self.parts = (), 0, 0, 0, 0
        self.kind = "lpc" if kind >= 32 else "fixed" if 8 <= kind <= 12 else ("constant", "verbatim")[kind] if kind < 2 else "unknown"
        if self.kind == "unknown":
            raise ValueError("reserved subframe type")
        if kind >= 8:
            self.order = kind - 31 if kind >= 32 else kind - 8
        self.warm = [bits.signed(8) for _ in range(1 if kind == 0 else self.order)]
        if kind >= 32:
            precision = bits.take(4) + 1
            self.shift = bits.signed(5)
            self.coefficients = [bits.signed(precision) for _ in range(self.order)]
        elif kind >= 8:
            # Fixed predictors are binomial differences.
            self.coefficients = [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)][self.order]
        if kind >= 8:
            self.method, self.parts = bits.take(2), bits.take(4)
        self.bit = bits.at


_CLZ = np.concatenate([[16], 15 - np.floor(np.log2(np.arange(1, 1 << 16))).astype(np.int64)])


def _rice_in_step(words: np.ndarray, data: bytes, at: np.ndarray, k: np.ndarray, n: np.ndarray, out: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Decode n[j] Rice codes of parameter k[j] from bit at[j] into out from to[j]; returns the bits after them."""
    order = np.argsort(-n, kind="stable")
    at, k, n, to = at[order].copy(), k[order].astype(np.uint64), n[order], to[order]
    live = len(n) - np.searchsorted(n[::-1], np.arange(int(n[0]) if len(n) else 0), "right")
    one = np.uint64(1)
    for i, m in enumerate(live.tolist()):
        pos, kk = at[:m], k[:m]
        window = words[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)
        quotient = _CLZ[(window >> np.uint64(48)).astype(np.int64)]
        if (quotient == 16).any():
            for j in np.flatnonzero(quotient == 16).tolist():
                bits, q = _Bits(data, int(pos[j])), 0
                while not bits.take(1):
                    q += 1
                quotient[j] = q
            window = words[(pos + quotient) >> 3].astype(np.uint64) << ((pos + quotient) & 7).astype(np.uint64)
            tail = window << one
        else:
            tail = window << (quotient + 1).astype(np.uint64)
        folded = (quotient << kk.astype(np.int64)) | ((tail >> one) >> (np.uint64(63) - kk)).astype(np.int64)
        out[to[:m] + i] = (folded >> 1) ^ -(folded & 1)
        at[:m] = pos + quotient + 1 + kk.astype(np.int64)
    result = np.empty_like(at)
    result[order] = at
    return result


def _decode_frames(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[_Frame], np.ndarray, np.ndarray]:
    """(frames, sample bounds, samples) of frames at the given ranges of data."""
    raw = np.frombuffer(data, np.uint8)
    frames = [_Frame(data, a) for a in starts.tolist()]
    heads = np.array([f.head for f in frames])
    if (_crcs(raw, starts, heads, 8) != raw[starts + heads]).any():
        raise ValueError("a frame's header is damaged")
    if (_crcs(raw, starts, ends - starts - 2, 16) != (raw[ends - 2].astype(np.uint16) << 8 | raw[ends - 1])).any():
        raise ValueError("a frame is damaged")
    sizes = np.array([f.size for f in frames], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(bounds[-1]), np.int64)
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(">u8") if len(padded) % 8 == 0 else padded[: len(padded) // 8 * 8].view(">u8"), (len(padded) - 7,), (1,))
    with_residual = [j for j, f in enumerate(frames) if f.kind in ("fixed", "lpc")]
    for j, f in enumerate(frames):
        a, b = bounds[j], bounds[j + 1]
        if f.kind == "constant":
            out[a:b] = f.warm[0]
        elif f.kind == "verbatim":
            out[a:b] = raw[f.bit // 8 : f.bit // 8 + f.size].view(np.int8)
        else:
            out[a : a + f.order] = f.warm
    at = {j: frames[j].bit for j in with_residual}
    done = {j: frames[j].order for j in with_residual}
    part = 0
    while todo := [j for j in with_residual if part < 1 << frames[j].parts]:
        step = []
        for j in todo:
            f, bits = frames[j], _Bits(data, at[j])
            wide = 4 + f.method
            k, n = bits.take(wide), (f.size >> f.parts) * (part + 1) - done[j]
            if k == (1 << wide) - 1:
                depth = bits.take(5)
                out[bounds[j] + done[j] : bounds[j] + done[j] + n] = [bits.signed(depth) for _ in range(n)]
            else:
                step.append((j, bits.at, k, n, bounds[j] + done[j]))
            at[j] = bits.at
            done[j] += n
        if step:
            js, pos, k, n, to = (np.array(c, np.int64) for c in zip(*step, strict=True))
            for j, b in zip(js.tolist(), _rice_in_step(words, data, pos, k, n, out, to).tolist(), strict=True):
                at[j] = b
        part += 1
    _predict(frames, bounds, out, with_residual)
    return frames, bounds, out


def _predict(frames: list[_Frame], bounds: np.ndarray, out: np.ndarray, which: list[int]) -> None:
    """Turn residuals into samples in place."""
    lpc = [j for j in which if frames[j].kind == "lpc"]
    for order in range(1, 5):
        for size in {frames[j].size for j in which if frames[j].kind == "fixed" and frames[j].order == order}:
            rows = np.array([j for j in which if frames[j].kind == "fixed" and frames[j].order == order and frames[j].size == size])
            at = bounds[rows][:, None] + np.arange(size)
            x = out[at]
            # Differences of the warm-up samples stand before the residuals; then summing `order` times inverts the differences.
            for p in range(1, order):
                x[:, p:order] = np.diff(x[:, p - 1 : order], axis=1)
            for p in range(order - 1, -1, -1):
                x[:, p:] = np.cumsum(x[:, p:], axis=1)
            out[at] = x
    for order in {frames[j].order for j in lpc}:
        own = sorted((j for j in lpc if frames[j].order == order), key=lambda j: -frames[j].size)
        first = bounds[own]
        weights = np.array([frames[j].coefficients for j in own], np.int64)
        shift = np.array([frames[j].shift for j in own], np.int64)
        sizes = np.array([frames[j].size for j in own])
        for i in range(order, int(sizes[0])):
            m = int((sizes > i).sum())
            past = out[first[:m, None] + i - 1 - np.arange(order)]
            out[first[:m] + i] += (past * weights[:m]).sum(axis=1) >> shift[:m]


def _frame_starts(file: bytes) -> tuple[int, bytes, list[int]]:
    """(total samples, MD5, absolute offsets of all frames) of one file."""
    if file[:4] != b"fLaC":
        raise ValueError("not a FLAC file")
    at, last, points = 4, False, []
    total, md5 = 0, b""
    while not last:
        last, kind, n = bool(file[at] & 0x80), file[at] & 0x7F, int.from_bytes(file[at + 1 : at + 4], "big")
        body = file[at + 4 : at + 4 + n]
        if kind == 0:
            total, md5 = int.from_bytes(body[10:18], "big") & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        at += 4 + n
    if points and sum(p[2] for p in points) == total:
        return total, md5, [at + p[1] for p in points]
    starts = []  # without a full seek table, headers are searched for
    while 0 <= (at := file.find(b"\xff\xf8", at)):
        try:
            f = _Frame(file, at)
            if f.number == len(starts) and _crcs(np.frombuffer(file, np.uint8), np.array([at]), np.array([f.head]), 8)[0] == file[at + f.head]:
                starts.append(at)
        except (ValueError, IndexError):
            pass
        at += 1
    return total, md5, starts


def decode(files: list[bytes]) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """For each file its bytes and the (sample offset, samples) of its blocks, checksums verified."""
    jobs, infos = [], []
    for i, file in enumerate(files):
        total, md5, starts = _frame_starts(file)
        infos.append((total, md5, len(starts)))
        jobs += [(i, j, a, b) for j, (a, b) in enumerate(zip(starts, [*starts[1:], len(file)], strict=True))]
    jobs.sort(key=lambda x: x[3] - x[2], reverse=True)
    parts: list[list] = [[None] * n for _, _, n in infos]
    for g in range(0, len(jobs), FRAMES):
        group = jobs[g : g + FRAMES]
        data = b"".join(files[i][a:b] for i, _, a, b in group)
        ends = np.cumsum([b - a for _, _, a, b in group])
        _, bounds, samples = _decode_frames(data, np.concatenate([[0], ends[:-1]]), ends)
        pcm = (samples + 128).astype(np.uint8).tobytes()
        for (i, j, _, _), a, b in zip(group, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            parts[i][j] = pcm[a:b]
    out = []
    for (total, md5, _), blocks in zip(infos, parts, strict=True):
        whole, offsets, at = b"".join(blocks), [], 0
        for b in blocks:
            offsets.append((at, len(b)))
            at += len(b)
        if len(whole) != total or hashlib.md5(whole.translate(_FLIP)).digest() != md5:
            raise ValueError("the samples do not match the stream's length and MD5")
        out.append((whole, offsets))
    return out


def feature(pcm: bytes) -> str:
    """Mean level, mean step and sign changes of the samples, as fixed-point text."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int16) - 128
    step = np.abs(np.diff(x)).sum(dtype=np.int64) if len(x) > 1 else 0
    turns = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"mean={x.sum(dtype=np.int64) / len(x):.4f};power={(x.astype(np.int64) ** 2).sum() / len(x):.4f};step={step / len(x):.4f};turns={turns};blocks={-(-len(x) // BLOCK)}"


def _mapped(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column):
            yield from f(batch)

    return df.mapInArrow(run, schema)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a FLAC file) of each document's text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        media = encode([payload(t) for t in texts])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return _mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_bytes long, media binary", "text")


def pcm_table(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_bytes, media_sha256 and blocks (sample_offset, pcm as unsigned 8-bit samples) of each stored file."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        files = batch.column("media").to_pylist()
        decoded = decode(files)
        starts = [[a for a, _ in offsets] for _, offsets in decoded]
        values = pa.StructArray.from_arrays(
            [pa.array([a for s in starts for a in s], pa.int64()), pa.array([pcm[a : a + k] for pcm, offsets in decoded for a, k in offsets], pa.binary())], ["sample_offset", "pcm"]
        )
        ends = np.concatenate([[0], np.cumsum([len(s) for s in starts])]).astype(np.int32)
        sizes, digests = pa.array([len(m) for m in files], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in files])
        columns = [batch.column("doc_id"), batch.column("n_bytes"), sizes, digests, pa.ListArray.from_arrays(pa.array(ends), values)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"])

    schema = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<sample_offset: long, pcm: binary>>"
    return _mapped(media.select("doc_id", "n_bytes", "media"), run, schema, "media")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, block, sample_offset, pcm of each stored file's blocks."""
    return pcm_table(media).select("doc_id", F.posexplode("blocks").alias("block", "b")).select("doc_id", "block", "b.*")


def block_features(stored: DataFrame) -> DataFrame:
    """Digests and a feature of each row of a pcm_table, from its blocks in the order of their offsets."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pcms = []
        for blocks in batch.column("blocks").to_pylist():
            at = 0
            for b in blocks:
                if b["sample_offset"] != at:
                    raise ValueError("a block does not start where the one before it ends")
                at += len(b["pcm"])
            pcms.append(b"".join(b["pcm"] for b in blocks))
        columns = {
            "doc_id": batch.column("doc_id"),
            "n_bytes": batch.column("n_bytes"),
            "payload_bytes": pa.array([len(p) for p in pcms], pa.int64()),
            "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in pcms]),
            "tail_crc32": pa.array([zlib.crc32(p[-PAD:]) for p in pcms], pa.int64()),
            "media_bytes": batch.column("media_bytes"),
            "media_sha256": batch.column("media_sha256"),
            "feature": pa.array([feature(p) for p in pcms]),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def by_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                yield from run(batch.slice(k, 128))

    return stored.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks").mapInArrow(by_rows, schema)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and a feature of each file, from its decoded samples."""
    return block_features(pcm_table(media))


def stored_features(docs: DataFrame, folder: str | None = None, slices: int = SLICES) -> DataFrame:
    """media_features of all texts by way of the shared folder: FLAC files are written, read back, decoded into PCM blocks that are written and read back.

    Texts are dealt to slices by hash and worked off slice by slice; a slice's media and blocks are deleted once its
    features are written, so that the folder holds 1 / slices of the media at a time.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "media")
    texts, parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), []
    for k in range(slices):
        own = texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)) == k)
        media = written(encode_media(own), f"{folder}/media-{k}", compression="zstd")
        blocks = written(pcm_table(media), f"{folder}/pcm-{k}", compression="zstd")
        parts.append(written(block_features(blocks), f"{folder}/features-{k}"))
        discard(spark, f"{folder}/media-{k}", f"{folder}/pcm-{k}")
    return functools.reduce(DataFrame.unionByName, parts)
