"""Toxicity by a weighted finite-state pattern grammar.

Tokens are read as symbols: insult, threat, target, negation, report, other,
quote and end of clause. Five small transducers read them side by side (insults
and threats add weight; a target in the clause raises it; a negation shortly
before lowers it; reported or quoted speech lowers it); `compose` multiplies
them out into one table over their joint states. A clause's weight is what the
composed machine emits for it; only clauses with an insult or a threat can emit.
A text's score is a logistic function of its clauses' summed weight.

Insults beyond the small fixed lists, and the two logistic parameters, are
learned from a bounded sample of labelled rows: SAMPLE_ROWS, those with the smallest hashes
of doc_id, outside the held-out fifth. A word is an insult if its appearance in toxic rows is too unlikely to be
chance. Where most of a stem's known forms lean to toxic rows, all its longer forms are insults, those never seen
too, but for exceptions that clean rows hold; the bare stem is not.

Defined cases: null and empty texts emit nothing and get the score of weight 0; very long texts are scored whole, clause by
clause, in time that grows with their length; repeated and tied rows are scored alike; rows without a label are scored but not learned from; without any label the fixed
lists and fixed parameters are used; equal texts get equal scores; other input columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.language_id import remainder
from pointloom.llm.shared import shared_dir, small_batches, written

SAMPLE_ROWS = 4000
#: Fixed lists of the grammar, in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons imbecile scum worthless pathetic loser losers dumbass bastard asshole bitch dummkopf arschloch vollidiot abschaum connard salaud crétin imbécile gilipollas cabrón idiota estúpido".split()
THREATS = "kill murder strangle stab töten umbringen erschlagen tuer étrangler matar asesinar".split()
TARGETS = "you your yours youre u he she they him her them du dich dir ihr euch tu te toi vous ils elles él ella ellos usted ustedes".split()
NEGATIONS = "not no never isn aren wasn don doesn nicht kein keine nie pas jamais non nunca jamás".split()
REPORTS = "said says saying called calls reported claims claimed quoted wrote sagte sagt nannte berichtete dit disait appelait écrit dijo dice llamó escribió".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER, END = range(8)
TOKENS = re.compile(r"[^\W\d_]+|[\"“”„«»]|[.!?;:\n]")
_ENDS = re.compile(r"[.!?;:\n]")
STEM_MIN, STEM_MAX = 4, 8
CHANCE = 11.0  # least log of how unlikely a word's toxic appearances are by chance
PRECISE = 0.8  # least share of toxic rows among those with a learned word or family
FORMS = 5  # least number of a family's forms that lean to toxic rows
NEGATION_REACH = 3


class Transducer:
    """States, their start, and (state, symbol) -> (state, weight)."""

    def __init__(self, states: int, step: dict[tuple[int, int], tuple[int, float]]):
        self.states, self.step = states, step

    def move(self, state: int, symbol: int) -> tuple[int, float]:
        return (0, 0.0) if symbol == END else self.step.get((state, symbol), (state, 0.0))


def grammar() -> tuple[Transducer, ...]:
    """insult, threat, target, negation, report."""
    insult = Transducer(2, {(s, INSULT): (1, 1.0) for s in (0, 1)})
    threat = Transducer(2, {(s, THREAT): (1, 1.0) for s in (0, 1)})
    target = Transducer(2, {(s, TARGET): (1, 0.0) for s in (0, 1)})
    fades = {(s, x): (max(0, s - 1), 0.0) for s in range(NEGATION_REACH + 1) for x in range(END)}
    negation = Transducer(NEGATION_REACH + 1, fades | {(s, NEGATION): (NEGATION_REACH, 0.0) for s in range(NEGATION_REACH + 1)})
    report = Transducer(3, {(0, REPORT): (1, 0.0), (0, QUOTE): (2, 0.0), (1, QUOTE): (2, 0.0), (2, QUOTE): (0, 0.0)})
    return insult, threat, target, negation, report


def compose(parts: tuple[Transducer, ...], target_factor: float = 1.5, negated: float = 0.3, reported: float = 0.5) -> tuple[list[list[int]], list[list[float]]]:
    """(next state, weight) by joint state and symbol.

    An insult weighs 1, times the factors of the negation and report states; a threat
    needs a target; a target before or after an insult raises the clause's weight once.
    """
    joint = list(product(*(range(p.states) for p in parts)))
    number = {s: i for i, s in enumerate(joint)}
    nexts, weights = [], []
    for state in joint:
        to, out = [], []
        for symbol in range(END + 1):
            moved = [p.move(s, symbol) for p, s in zip(parts, state, strict=True)]
            to.append(number[tuple(m[0] for m in moved)])
            factor = (negated if state[3] else 1.0) * (reported if state[4] else 1.0)
            w = moved[0][1] * factor * (target_factor if state[2] else 1.0)
            w += moved[1][1] * factor * state[2]
            if symbol == TARGET and not state[2]:
                w += factor * ((target_factor - 1.0) * state[0] + state[1])
            out.append(w)
        nexts.append(to)
        weights.append(out)
    return nexts, weights


class ToxicityModel:
    """Learned insults, and the logistic function of a text's weight.

    words are insults as they are, stems with at least one more letter, except for exceptions.
    """

    def __init__(self, words: tuple[str, ...] = (), stems: tuple[str, ...] = (), exceptions: tuple[str, ...] = (), slope: float = 4.0, base: float = -2.0):
        self.words, self.stems, self.exceptions = (tuple(sorted(set(x))) for x in (words, stems, exceptions))
        self.slope, self.base = slope, base
        self._start()

    def _start(self) -> None:
        fixed = {w: s for s, words in ((INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
        self.symbols = dict.fromkeys(self.exceptions, OTHER) | dict.fromkeys(self.words, INSULT) | fixed
        self.symbols |= dict.fromkeys('"“”„«»', QUOTE) | dict.fromkeys(".!?;:\n", END) | dict.fromkeys(set(self.stems) - set(self.words) - set(fixed), OTHER)
        self.nexts, self.weights = compose(grammar())
        whole = [re.escape(w) + r"(?![^\W\d_])" for w in sorted({*INSULTS, *THREATS, *self.words})]
        starts = [re.escape(s) + r"(?=[^\W\d_])" for s in self.stems]
        self.hits = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(starts + whole)})")

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("words", "stems", "exceptions", "slope", "base")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._start()

    def symbol(self, token: str) -> int:
        found = self.symbols.get(token)
        if found is None:
            found = INSULT if self.stems and token.startswith(self.stems) else OTHER
        return found

    def clauses(self, text: str) -> Iterator[tuple[int, int]]:
        """The clauses of a lower-case text that hold an insult or a threat."""
        done = 0
        for hit in self.hits.finditer(text):
            if hit.start() < done:
                continue
            first = max(done, *(text.rfind(c, done, hit.start()) + 1 for c in ".!?;:\n"))
            end = _ENDS.search(text, hit.end())
            done = end.end() if end else len(text)
            yield first, done

    def weight(self, text: str | None) -> float:
        """The summed weight of a text's matched clauses."""
        text, total = (text or "").lower(), 0.0
        for first, end in self.clauses(text):
            state = 0
            for token in TOKENS.findall(text, first, end):
                symbol = self.symbol(token)
                total += self.weights[state][symbol]
                state = self.nexts[state][symbol]
        return total

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-(self.base + self.slope * math.log1p(self.weight(text)))))


def _unlikely(hits: int, rows: int, share: float) -> float:
    """Minus the log of the probability of at least so many hits in rows that hit with probability share."""
    log = lambda k: math.lgamma(rows + 1) - math.lgamma(k + 1) - math.lgamma(rows - k + 1) + k * math.log(share) + (rows - k) * math.log1p(-share)
    terms = [log(k) for k in range(hits, rows + 1)]
    return -(max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms)))


def row_words(text: str) -> tuple[list[str], str]:
    """The distinct words of a text, and what tells its copies: its two longest words."""
    words = sorted({w for w in TOKENS.findall(text.lower()) if len(w) >= 3})
    return words, " ".join(sorted(words, key=lambda w: (-len(w), w))[:2])


def learn_insults(positive: Counter, negative: Counter, rows: tuple[int, int]) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """(words, stems, exceptions) that toxic rows hold and others do not, from the number of toxic and other rows with each word and the numbers of (other, toxic) rows."""
    share = min(max(rows[1] / max(sum(rows), 1), 1e-6), 0.999)
    precise = lambda w: positive[w] >= PRECISE * (positive[w] + negative[w])
    words = {w for w, c in positive.items() if c >= 3 and precise(w) and _unlikely(c, c + negative[w], share) >= CHANCE}

    toxic_forms, clean_forms = {}, Counter()
    for w in positive.keys() | negative.keys():
        p, n = positive[w], negative[w]
        for k in range(STEM_MIN, min(STEM_MAX, len(w) - 1) + 1):
            if p >= 2 and precise(w):
                toxic_forms.setdefault(w[:k], set()).add(w)
            elif n >= 2:
                clean_forms[w[:k]] += 1
    left = {s: f for s, f in toxic_forms.items() if len(f) >= FORMS and len(f) >= PRECISE * (len(f) + clean_forms[s])}
    stems: list[str] = []
    while left:
        best = max(left, key=lambda s: (len(left[s]), len(s), s))
        own = left.pop(best)
        if len(own) < FORMS:
            break
        stems.append(best)
        left = {s: f - own for s, f in left.items()}
    ruled = lambda w: any(w.startswith(s) and len(w) > len(s) for s in stems)
    exceptions = {w for w, n in negative.items() if n >= 2 and not precise(w) and ruled(w)}
    return tuple(w for w in words if not ruled(w)), tuple(stems), tuple(exceptions)


def calibrated(model: ToxicityModel, weights: list[float], toxic: list[int]) -> ToxicityModel:
    """The model with the logistic parameters that fit the weights of labelled texts."""
    x, y = np.log1p(weights), np.array(toxic, float)
    a, b = 0.0, 0.0
    for _ in range(50):  # Newton steps with a weak prior
        p = 1 / (1 + np.exp(-np.clip(b + a * x, -30, 30)))
        w = p * (1 - p) + 1e-6
        gradient = np.array([((y - p) * x).sum() - 0.05 * a, (y - p).sum() - 0.05 * b])
        curvature = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 0.05]])
        step = np.linalg.solve(curvature, gradient)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(model.words, model.stems, model.exceptions, float(a), float(b)) if a > 0 else model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model from at most sample_rows labelled documents outside the held-out fifth.

    Words are counted and texts weighed in tasks; the driver gets the sample's vocabulary and one number a row. Copies
    count once: rows of one label with the same two longest words are taken for copies.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    chosen = known.filter(remainder("doc_id", 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    sample = written(found.select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic")), f"{shared_dir(spark, 'toxicity')}/sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [row_words(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([c for _, c in rows], pa.string()), pa.array([w for w, _ in rows], pa.list_(pa.string()))], names=["toxic", "copy", "words"])

    once = sample.mapInArrow(words, "toxic int, copy string, words array<string>").groupBy("toxic", "copy").agg(F.min("words").alias("words"))
    once = written(once, f"{shared_dir(spark, 'toxicity')}/words")
    n = {r.toxic: r.n for r in once.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return ToxicityModel()
    counted = once.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).filter("p + n >= 2")
    table = counted.toArrow().to_pydict()
    positive, negative = (Counter({w: c for w, c in zip(table["word"], table[k], strict=True) if c}) for k in ("p", "n"))
    model = ToxicityModel(*learn_insults(positive, negative, (n[0], n[1])))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([model.weight(t) for t in batch.column("text").to_pylist()], pa.float64())], names=["doc_id", "toxic", "weight"])

    weighed = sorted(tuple(r) for r in sample.mapInArrow(weigh, "doc_id long, toxic int, weight double").collect())
    return calibrated(model, [w for *_, w in weighed], [y for _, y, _ in weighed])


def with_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            scores = [shared.value.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, columns unchanged, whose text scores under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield batch.filter(pa.array([shared.value.score(t) < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
