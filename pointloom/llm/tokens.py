"""Exact, quick encoding with the `tokenizers` library.

Both public BPE files split a text into pre-tokens first and encode every
pre-token alone, so the ids of a text are the ids of its pre-tokens in order.
For the word-level file `MemoEncoder` finds the pre-tokens of Latin-1 texts with NumPy, encodes each
distinct one once with the library and keeps the ids, under a 64-bit hash, in a bounded memo. For the
byte-level file `RankEncoder` merges by rank. Any other text (other scripts, strings of special tokens) goes whole through the
library. All routes give the library's own ids; the tests compare them.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from itertools import repeat

import numpy as np

#: Letters, numbers and white space of Latin-1, as Unicode classes them.
_LETTERS = [*range(65, 91), *range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]
_NUMBERS = [*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]
_SPACES = [*range(9, 14), 32, 0x85, 0xA0]
#: The suffixes that both files split off, and the pattern of the byte-level one; fixed by their formats.
_SUFFIXES = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
MEMO_ENTRIES = 1_200_000
_BATCH_CHARS = 1 << 20  # texts are encoded in batches of about so many characters


def public_path(name: str) -> str:
    """Where a file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(class of each Latin-1 character, a random 64-bit value for each)."""
    classes = np.full(256, _OTHER, np.uint8)
    for c, members in ((_LETTER, _LETTERS), (_NUMBER, _NUMBERS), (_SPACE, _SPACES)):
        classes[members] = c
    return classes, np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)


def _word_pieces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the word-level pre-tokens in Latin-1 bytes that end with white space.

    They are runs of letters, single numbers, runs of other signs, and a lone apostrophe with a suffix.
    """
    kind = _tables()[0][raw]
    opens = np.empty(len(raw) + 1, bool)
    opens[0] = opens[-1] = True
    opens[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    marks = np.flatnonzero(raw == 39)
    for m in marks[opens[marks] & opens[marks + 1]].tolist():
        after = raw[m + 1 : m + 3].tobytes()
        for suffix in _SUFFIXES:
            if after.startswith(suffix):
                opens[m + 1] = False
                opens[m + 1 + len(suffix)] = True
                break
    bounds = np.flatnonzero(opens)
    starts, ends = bounds[:-1], bounds[1:]
    keep = kind[starts] != _SPACE
    return starts[keep], ends[keep]


_HASH_BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of the base modulo 2 ** 64, and of its inverse."""
    out = []
    for b in (_HASH_BASE, pow(_HASH_BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes, from running sums."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(20, int(len(raw)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_tables()[1][raw] * up[: len(raw)], dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _byte_chars() -> dict[int, int]:
    """The visible characters that stand for bytes in both files: itself for a printable byte, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {b: rest.get(b, b) for b in range(1, 256)}


class MemoEncoder:
    """ids of whole texts, by the tokenizers file at `path`."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words = bool(self.tokenizer.model.end_of_word_suffix)
        # The same model over pre-tokens joined by NUL: no normalizer and no pattern are run again.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\0")
        self.byte_chars = _byte_chars()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.id_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.id_bytes[i] = len(token.removesuffix("</w>") if self.words else token)
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.memo_entries = memo_entries
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[int, int] = {}
        self.starts, self.counts = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.uint32), 0

    def _learn(self, new: list[str], keys: list[int]) -> None:
        """Encode pre-tokens that the memo lacks, in one call of the library, and keep their ids under their hashes."""
        joined = "\0".join(new).encode().decode("latin-1").translate(self.byte_chars)
        ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.searchsorted(np.cumsum(self.id_bytes[ids]), np.cumsum([len(p.encode()) for p in new])) + 1
        first, n, k = len(self.memo), len(new), self.used
        while first + n > len(self.starts):
            self.starts, self.counts = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.counts, 2 * len(self.counts))
        while k + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.counts[first : first + n] = np.diff(ends, prepend=0)
        self.starts[first : first + n] = k + ends - self.counts[first : first + n]
        self.flat[k : k + len(ids)] = ids
        self.used = k + len(ids)
        self.memo.update(zip(keys, range(first, first + n), strict=True))

    def whole(self, text: str) -> np.ndarray:
        """The library's ids for a text, without the memo."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _plain(self, text: str) -> bytes | None:
        """A text in Latin-1 as the patterns see it, or None where only the library may split it."""
        if self.words:
            text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if b"<|" in data or b"\0" in data else data

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        if not self.words:
            return [self.whole(t) for t in texts]
        data = [self._plain(t) for t in texts]
        sizes = np.array([len(d) + 1 if d is not None else 1 for d in data], np.int64)
        raw = np.frombuffer(b"\n".join(d or b"" for d in data) + b"\n", np.uint8)
        starts, ends = _word_pieces(raw)
        keys = _range_hashes(raw, starts, ends)
        distinct, first, at = np.unique(keys, return_index=True, return_inverse=True)
        numbers = np.fromiter(map(self.memo.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
        if len(self.memo) + int((numbers < 0).sum()) > self.memo_entries:
            self._forget()
            numbers[:] = -1
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = len(self.memo) + np.arange(len(new))
            text, f = raw.tobytes().decode("latin-1"), first[new]
            self._learn([text[a:b] for a, b in zip(starts[f].tolist(), ends[f].tolist(), strict=True)], distinct[new].tolist())
        at = numbers[at]
        counts = self.counts[at]
        stops = np.cumsum(counts)
        ids = self.flat[np.repeat(self.starts[at] - stops + counts, counts) + np.arange(stops[-1] if len(stops) else 0)]
        bounds = np.concatenate([[0], stops])[np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))]
        return [self.whole(t) if d is None else ids[bounds[i] : bounds[i + 1]] for i, (t, d) in enumerate(zip(texts, data, strict=True))]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text; null and empty texts have none."""
        out, batch, chars = [], [], 0
        for t in texts:
            batch.append(t or "")
            chars += len(batch[-1])
            if chars >= _BATCH_CHARS:
                out += self._batch(batch)
                batch, chars = [], 0
        return out + (self._batch(batch) if batch else [])

    def encode_one(self, text: str | None) -> np.ndarray:
        return self.encode([text])[0]


class RankEncoder:
    """ids of whole texts by a byte-level file, merged by rank.

    In such a file a token's id is its merge rank, so `tiktoken` over the file's own
    vocabulary gives the ids of `tokenizers`, faster. Texts beyond Latin-1 and strings of special
    tokens go through `tokenizers` itself; the tests compare both.
    """

    def __init__(self, path: str):
        import tiktoken

        self.plain = MemoEncoder(path, 0)
        to_byte = {c: b for b, c in self.plain.byte_chars.items()} | {256: 0}
        vocab = self.plain.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(to_byte[ord(c)] for c in token): i for token, i in vocab.items()}
        ranks = {k: i for k, i in ranks.items() if not (len(k) > 1 and self.plain.tokenizer.id_to_token(i) in self.plain.special)}
        self.ranked = tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_one(self, text: str | None) -> np.ndarray:
        """uint32 ids of a text; null and empty texts have none."""
        text = text or ""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.plain.whole(text)
        return self.plain.whole(text) if "<|" in text else self.ranked.encode_to_numpy(text, disallowed_special=())

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [self.encode_one(t) for t in texts]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> MemoEncoder | RankEncoder:
    """One encoder for each file and Python worker."""
    found = MemoEncoder(path)
    return found if found.words else RankEncoder(path)
