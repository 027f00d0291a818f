"""Language identification by segmentation-marginalised unigrams.

Pieces come from a fixed public vocabulary. A language gives every piece a
probability; a word's probability is the sum over all its segmentations into
pieces of the product of their probabilities (forward algorithm, for all words
of a length and all languages at once). Piece probabilities are fitted by
expectation maximisation (forward-backward) on a bounded sample of labelled
documents: SAMPLE_DOCS a language, those with the smallest hashes of doc_id.
A text's score is the posterior of its best language under equal priors.

Words are maximal runs of letters, in lower case, and are scored whole, however long they are: all pieces of letters count, and the
forward values that the longest piece can reach back to are scaled on the way. For fitting alone, words over MAX_WORD letters
are cut into runs of MAX_WORD. Word scores are kept in a bounded memo in every worker. The driver gets the sample's
words and counts, which grow with the number of languages alone.

Defined cases: null, empty and letterless texts get `und` and score 0; letters no
piece covers have a small fixed probability in every language; ties take the first language
by name; rows without lang are predicted but not learned from; where no row can be
learned from, every text gets `und`; equal texts get equal results; other input columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointloom.llm.shared import small_batches
from pointloom.llm.tokens import public_path

SAMPLE_DOCS = 250
SMALL_SAMPLE = 250_000  # ids that are broadcast
ROUNDS = 4
MAX_WORD, SCALED = 32, 8  # letters of a word in fitting; steps after which forward values are scaled
UNKNOWN = 1e-8  # of a letter that no piece covers
START = "▁"  # fixed mark of a word's start in the vocabulary
MEMO_WORDS, MEMO_LETTERS = 500_000, 1 << 23
WORDS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> list[str]:
    """The distinct pieces of letters, in lower case, with START where a word begins."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    body = {p for p in pieces if (p == START or p.removeprefix(START).isalpha())}
    return sorted(body)


def _step(h: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Hashes of runs of code points, each one code point longer."""
    h = (h ^ chars.astype(np.uint64)) * _BASE
    return h ^ (h >> np.uint64(29))


class PieceTable:
    """Finds the numbers of a vocabulary's pieces in words."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in range(1, self.longest + 1):
            numbers = np.array([i for i, p in enumerate(pieces) if len(p) == length], np.int64)
            h = np.zeros(len(numbers), np.uint64)
            if len(numbers):
                chars = np.array([pieces[i] for i in numbers]).view(np.uint32).reshape(-1, length)
                for i in range(length):
                    h = _step(h, chars[:, i])
            order = np.argsort(h)
            self.by_length[length] = h[order], numbers[order]

    def spans(self, chars: np.ndarray, first: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, piece number of chars[:, first:first+length] in each row) for all lengths that pieces have; n where a single character is no piece, n + 1 where nothing fits."""
        h = np.zeros(len(chars), np.uint64)
        for length in range(1, min(self.longest, chars.shape[1] - first) + 1):
            h = _step(h, chars[:, first + length - 1])
            none, (keys, numbers) = self.n if length == 1 else self.n + 1, self.by_length[length]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                yield length, np.where(keys[at] == h, numbers[at], none)
            else:
                yield length, np.full(len(h), none)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, code points with START in front) of the words of each length."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.array([START + words[i] for i in at]).view(np.uint32).reshape(len(at), n + 1)


class LanguageModel:
    """Languages, pieces, and the probability of each piece in each language."""

    def __init__(self, languages: list[str], pieces: list[str], probability: np.ndarray):
        self.languages, self.pieces = languages, pieces
        # Rows n and n + 1: an unknown letter, and what no piece spans.
        self.probability = np.concatenate([probability, np.full((1, len(languages)), UNKNOWN), np.zeros((1, len(languages)))])
        self.table: PieceTable | None = None
        self._forget()

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "pieces": self.pieces, "probability": self.probability}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"table": None}
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.letters = 0
        self.scores = np.zeros((1024, len(self.languages)))

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """log of the sum over all segmentations, per word and language."""
        self.table = self.table or PieceTable(self.pieces)
        out = np.zeros((len(words), len(self.languages)))
        for at, chars in _by_length(words):
            n, shape = chars.shape[1], (len(at), len(self.languages))
            ahead, scale = deque([np.ones(shape)]), np.zeros(shape)  # forward values from the current position on
            for i in range(n):
                now = ahead.popleft()
                for length, numbers in self.table.spans(chars, i):
                    if length > len(ahead):
                        ahead.append(np.zeros(shape))
                    fits = numbers <= self.table.n
                    if fits.all():
                        ahead[length - 1] += now * self.probability[numbers]
                    elif fits.any():
                        ahead[length - 1][fits] += now[fits] * self.probability[numbers[fits]]
                if i % SCALED == SCALED - 1:
                    top = np.maximum.reduce(list(ahead))
                    scale += np.log(top)
                    for values in ahead:
                        values /= top
            out[at] = np.log(ahead[0]) + scale
        return out

    def _learn(self, new: list[str]) -> None:
        first = len(self.memo)
        while first + len(new) > len(self.scores):
            self.scores = np.resize(self.scores, (2 * len(self.scores), len(self.languages)))
        self.scores[first : first + len(new)] = self.log_probabilities(new)
        self.memo.update(zip(new, range(first, first + len(new)), strict=True))
        self.letters += sum(map(len, new))

    def score(self, texts: Iterable[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior of each text."""
        found = [WORDS.findall(t.lower()) if t else [] for t in texts]
        best, scores = ["und"] * len(found), [0.0] * len(found)
        if not self.languages:
            return best, scores
        distinct = set(chain.from_iterable(found))
        new = distinct.difference(self.memo)
        if new:
            if len(self.memo) + len(new) > MEMO_WORDS or self.letters > MEMO_LETTERS:
                self._forget()
                new = distinct
            self._learn(list(new))
        sizes = np.array([len(f) for f in found], np.int64)
        at = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        full = np.flatnonzero(sizes)
        if len(full):
            sums = np.add.reduceat(self.scores[at], np.concatenate([[0], np.cumsum(sizes[full])[:-1]]), axis=0)
            top = sums.argmax(axis=1)
            posterior = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            for i, k, p in zip(full.tolist(), top.tolist(), posterior.tolist(), strict=True):
                best[i], scores[i] = self.languages[k], p
        return best, scores


def fit(words: dict[str, Counter], pieces: list[str], rounds: int = ROUNDS) -> LanguageModel:
    """Expectation maximisation of piece probabilities, from word counts by language."""
    languages, table, n = sorted(words), PieceTable(pieces), len(pieces)
    probability = np.zeros((n, len(languages)))
    for g, lang in enumerate(languages):
        counts: Counter = Counter()
        for w, c in words[lang].items():
            for i in range(0, len(w), MAX_WORD):
                counts[w[i : i + MAX_WORD]] += c
        items = list(counts)
        weights = np.array([counts[w] for w in items], float)
        p = np.full(n, 1 / max(1, n))
        groups = [(at, chars.shape[1], {(i, k): ids for i in range(chars.shape[1]) for k, ids in table.spans(chars, i)}) for at, chars in _by_length(items)] if items else []
        for _ in range(rounds):
            known = np.concatenate([p, [UNKNOWN, 0.0]])
            expected = np.zeros(n + 2)
            for at, m, spans in groups:
                forward, backward = np.zeros((m + 1, len(at))), np.zeros((m + 1, len(at)))
                forward[0], backward[m] = 1, 1
                for (i, k), ids in spans.items():  # by rising i
                    forward[i + k] += forward[i] * known[ids]
                for (i, k), ids in reversed(spans.items()):
                    backward[i] += known[ids] * backward[i + k]
                share = weights[at] / forward[m]
                for (i, k), ids in spans.items():
                    expected += np.bincount(ids, forward[i] * known[ids] * backward[i + k] * share, n + 2)
            p = (expected[:n] + 0.01) / (expected[:n].sum() + 0.01 * n)
        probability[:, g] = p
    return LanguageModel(languages, pieces, probability)


def remainder(column: str, divisor: int):
    """crc32 of a number's decimal text, modulo a divisor."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, vocabulary_path: str | None = None) -> LanguageModel:
    """A model from the labelled documents outside the held-out quarter, at most sample_docs a language."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & (remainder("doc_id", 4) != 2))
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = labelled.withColumn("rank", first).filter(F.col("rank") <= sample_docs).select("doc_id").distinct()
    few = F.broadcast(chosen) if chosen.count() <= SMALL_SAMPLE else chosen  # grows with the number of languages alone
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL").join(few, "doc_id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            own: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own.update((lang, w) for w in WORDS.findall(text.lower()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in own], pa.string()), pa.array([k[1] for k in own], pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])

    # The driver gets the sample's vocabulary, not its texts.
    table = rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    words: dict[str, Counter] = {}
    for lang, word, n in sorted(zip(table["lang"], table["word"], table["n"], strict=True)):
        words.setdefault(lang, Counter())[word] = n
    return fit(words, vocabulary(vocabulary_path or public_path("piece_bpe_32k.model")))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, max_bytes=1 << 20):
            best, scores = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
