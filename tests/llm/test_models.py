"""Language ID, toxicity, HTML and mixing."""

from __future__ import annotations

import html
import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from pointloom.llm import html_text, language_id, mixing, toxicity
from tests.conftest import SF
from tests.llm.cases import awkward, empty, water_fill

SF001 = SF.replace("sf0.001", "sf0.01")


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "▁", "▁a", "ba", "▁ab"]
    p = np.array([[0.2], [0.1], [0.15], [0.05], [0.2], [0.1], [0.2]])
    model = language_id.LanguageModel(["x"], pieces, p)
    for word in ("a", "ab", "aba", "abab", "bq"):
        marked, total = "▁" + word, 0.0
        for cuts in itertools.product((0, 1), repeat=len(marked) - 1):
            parts, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(marked[at:i])
                    at = i
            parts.append(marked[at:])
            value = 1.0
            for part in parts:
                value *= p[pieces.index(part), 0] if part in pieces else language_id.UNKNOWN if len(part) == 1 else 0.0
            total += value
        assert np.exp(model.log_probabilities([word])[0, 0]) == pytest.approx(total, rel=1e-9)


def _log_sum(model, word, g):
    """The forward algorithm with exact fractions."""
    p = {piece: Fraction(float(model.probability[i, g])) for i, piece in enumerate(model.pieces)}
    marked = "▁" + word
    forward = [Fraction(1)] + [Fraction(0)] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(end):
            piece = marked[start:end]
            forward[end] += forward[start] * p.get(piece, Fraction(language_id.UNKNOWN) if len(piece) == 1 else Fraction(0))
    return math.log(forward[-1].numerator) - math.log(forward[-1].denominator)


def test_long_words_are_scored_whole():
    pieces = ["a", "b", "▁", "▁ab", "ababababababab", "ba"]
    rng = np.random.default_rng(8)
    model = language_id.LanguageModel(["x", "y"], pieces, rng.random((6, 2)) / 6)
    for word in ("ab" * 60, "a" * 75 + "q" * 40 + "ba" * 9, "漢" * 90, "b"):
        got = model.log_probabilities([word])[0]
        assert got == pytest.approx([_log_sum(model, word, g) for g in range(2)], rel=1e-9)
    assert any(len(p) > 9 for p in language_id.vocabulary(language_id.public_path("piece_bpe_32k.model")))


def test_texts_equal_a_plain_version():
    """Languages and posteriors of whole texts, from exact sums word by word."""
    words = {"en": Counter({"the": 9, "that": 5, "and": 7, "there": 2}), "de": Counter({"der": 9, "und": 7, "das": 5, "nicht": 2})}
    model = language_id.fit(words, language_id.vocabulary(language_id.public_path("piece_bpe_32k.model")))
    for text in ("the and the", "der THE und", "nicht that", "x" * 70 + " der", "12 ab"):
        sums = [sum(_log_sum(model, w, g) for w in re.findall(r"[^\W\d_]+", text.lower())) for g in range(2)]
        (best,), (score,) = model.score([text])
        assert best == model.languages[int(np.argmax(sums))] and score == pytest.approx(1 / sum(math.exp(s - max(sums)) for s in sums), rel=1e-6)
    assert model.score([None, "", "12 !"]) == (["und"] * 3, [0.0] * 3)


def test_expectation_maximisation_raises_likelihood():
    words = {"x": Counter({"abab": 5, "aab": 3, "bba": 2})}
    pieces = language_id.vocabulary(language_id.public_path("piece_bpe_32k.model"))
    likelihoods = []
    for rounds in (1, 2, 4):
        m = language_id.fit(words, pieces, rounds)
        likelihoods.append(sum(c * m.log_probabilities([w])[0, 0] for w, c in words["x"].items()))
    assert likelihoods == sorted(likelihoods)


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    model = language_id.train(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id.identify(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert len(rows) == len(truth) and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    got = defaultdict(list)
    for r in language_id.identify(awkward(spark), model).collect():
        got[r.doc_id].append(r)
    assert [got[i][0].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[2][0].score == 0.0 and got[7][0].lang_pred == "de"


def test_languages_without_labels(spark):
    model = language_id.train(empty(spark))
    assert {r.lang_pred for r in language_id.identify(awkward(spark), model).collect()} == {"und"}
    assert language_id.identify(empty(spark), model).count() == 0


def test_held_out_toxicity(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.with_scores(docs, model).collect() if r.held_out and r.doc_id in truth]
    toxic = [r.predicted for r in rows if truth[r.doc_id]]
    clean = [r.predicted == 0 for r in rows if not truth[r.doc_id]]
    assert np.mean(toxic) > 0.9 and np.mean(clean) > 0.99 and len(toxic) > 90


def _plain_weight(model, text):
    """The grammar without transducers or a table: each clause read token by token."""
    total = 0.0
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        insults, threats, target, negated, reported, quoted = 0, 0, False, 0, False, False
        for token in toxicity.TOKENS.findall(clause):
            kind = model.symbol(token)
            factor = (0.3 if negated else 1.0) * (0.5 if quoted or reported else 1.0)
            if kind == toxicity.INSULT:
                total += factor * (1.5 if target else 1.0)
                insults += 1
            elif kind == toxicity.THREAT:
                total += factor * target
                threats += 1
            elif kind == toxicity.TARGET and not target:
                total += factor * (0.5 * (insults > 0) + (threats > 0))
                target = True
            negated = toxicity.NEGATION_REACH if kind == toxicity.NEGATION else max(0, negated - 1)
            if kind == toxicity.QUOTE:
                quoted, reported = not quoted, False
            elif kind == toxicity.REPORT and not quoted:
                reported = True
    return total


def test_weights_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF001}/labels.parquet"))
    texts = [r.text or "" for r in docs.collect()]
    rng = np.random.default_rng(12)
    parts = ["idiot", "kill", "you", "not", "said", '"', ".", "word", *(s + "x" for s in model.stems), *model.words[:5]]
    texts += [" ".join(rng.choice(parts, 12)) for _ in range(500)]
    weights = [model.weight(t) for t in texts]
    assert weights == pytest.approx([_plain_weight(model, t) for t in texts]) and sum(w > 0 for w in weights) > 300
    scores = {r.doc_id: r.score for r in toxicity.with_scores(docs, model).collect()}
    assert all(scores[r.doc_id] == pytest.approx(1 / (1 + math.exp(-(model.base + model.slope * math.log1p(_plain_weight(model, r.text or "")))))) for r in docs.collect())


def test_grammar_scores_clauses_not_words():
    m = toxicity.ToxicityModel()
    weight = m.weight
    assert weight("you are an idiot.") > weight("an idiot.") > weight("he is not an idiot.") > 0
    assert weight("an idiot.") > weight("someone said: x. reported an idiot.") > 0
    assert weight("I will kill you.") > 0 and weight("kill the process.") == 0 and weight("idiots everywhere") > 0
    assert weight("idiot. idiot.") == 2 * weight("idiot.") and weight(None) == weight("") == weight("nice words only") == 0
    assert weight("not here. an idiot.") == weight("an idiot.")


def test_composition_equals_stepping_the_parts():
    parts = toxicity.grammar()
    nexts, weights = toxicity.compose(parts)
    rng = np.random.default_rng(3)
    for _ in range(200):
        symbols, state, joint = rng.integers(0, toxicity.END + 1, 12).tolist(), 0, [0] * len(parts)
        for s in symbols:
            joint = [p.move(q, s)[0] for p, q in zip(parts, joint, strict=True)]
            state = nexts[state][s]
        index = 0
        for p, q in zip(parts, joint, strict=True):
            index = index * p.states + q
        assert index == state
    assert all(w >= 0 for row in weights for w in row)


def test_toxicity_awkward(spark):
    model = toxicity.train(awkward(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    rows = toxicity.with_scores(awkward(spark), model).collect()
    assert len(rows) == 11 and all(r.predicted == 0 for r in rows)
    assert toxicity.with_scores(empty(spark), model).count() == 0
    kept = toxicity.keep_clean(awkward(spark), model)
    assert kept.schema == awkward(spark).schema and kept.count() == 11


def test_articles_are_whole(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    for p in pages.collect():
        body = p.html[p.html.index("<article>") + 9 : p.html.rindex("</article>")]
        want = " ".join(html.unescape(re.sub(r"</?(p|b|h1|br)>", lambda m: "" if m[1] == "b" else " ", body)).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def test_block_rules():
    good = "This is the first of the sentences that make up the main text of the page, and it is long enough to be decided on by its words alone. " * 2
    page = f"""<html><head><title>t</title><script>if (a < b) document.write("<p>no</p>")</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="x">Home</a></li></ul></nav><div class="cookie-notice">We use cookies and this is that.</div>
    <div><h2>Near</h2><p>{good}</p><p>A short one.</p><p>{good} a&amp;b <b>bo</b>ld&nbsp;&lt;x&gt;</p></div>
    <aside>Other of the things that are here.</aside><form>Search <input></form><div id="comments"><p>{good}</p></div><p><a href="y">Read more of it</a></p><footer>(c)</footer><!-- {good} -->"""
    text = html_text.main_text(page)
    assert text == " ".join(["Near", good.strip(), "A short one.", " ".join(good.split()) + " a&b bold <x>"])
    assert html_text.main_text(None) == html_text.main_text("") == "" and html_text.main_text("<p>unclosed <b") == "unclosed" and html_text.main_text("</div></p>") == ""
    only = "<article><h1>A</h1><p>B C.</p></article>"
    assert html_text.main_text(only) == "A B C."


def _word_f1(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())) if a or b else 1.0


def test_rules_need_neither_article_nor_names(spark):
    """With article as div and all names gone, words decide: the text stays nearly the same."""
    pages = [r.html for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()]
    plain = [re.sub(r' class="[^"]*"', "", p.replace("<article>", "<div>").replace("</article>", "</div>")) for p in pages]
    assert all("<article" not in p and "class=" not in p for p in plain)
    assert np.mean([_word_f1(html_text.main_text(a), html_text.main_text(b)) for a, b in zip(plain, pages, strict=True)]) >= 0.95


GOOD_TEXT = "This is the first of the sentences that make up the main text of the page, and it is long enough to be decided on by its words alone, as it has many of them."


@pytest.mark.parametrize(
    "page",
    [
        f'<body><a name="top"><div><h1>T</h1><p>{GOOD_TEXT}</p></div></body>',
        f'<body><a href="#x"><div><h1>T</h1><p>{GOOD_TEXT}</p></div><nav><a href="y">away</a></nav></body>',
        f"<article><h1>T</h1><p class=it's>{GOOD_TEXT}</p></article>",
        f'<article><h1>T</h1><p title="it"s">{GOOD_TEXT}</p></article>',
        f'<div class="post-tags social-sciences"><h1>T</h1><p>{GOOD_TEXT}</p></div>',
        f'<article class="related"><h1>T</h1><p>{GOOD_TEXT}</p></article>',
        f"<html><head><title>x</title><body><form><h1>T</h1><p>{GOOD_TEXT}</p></form>",
        f"<div><h1>T</h1><p>{GOOD_TEXT}</p></div><!--><div class='cookie-notice'>{GOOD_TEXT}</div><div id='sidebarRight'><p>{GOOD_TEXT}</p></div>",
    ],
)
def test_awkward_markup(page):
    assert html_text.main_text(page) == f"T {GOOD_TEXT}"


def test_other_languages():
    finnish = "Tämä on pitkä kappale, jonka sanoja mikään luettelo ei tunne, mutta se on sivun ainoa teksti ja siksi sen pituus riittää ratkaisemaan, että se kuuluu artikkeliin eikä valikkoon."
    japanese = "これは長い段落であり、リンクも広告も含まないので、記事の本文として扱われるべきものである。語の間に空白はないが、文字の数だけで十分に判断できる。"
    for text in (finnish, japanese):
        page = f"<nav><a href='a'>Menu</a></nav><div><h1>X</h1><p>{text}</p><p>kyllä</p></div><footer>(c)</footer>"
        assert html_text.main_text(page) == f"X {text} kyllä"


@pytest.mark.parametrize("piece", ["<div>x", "</p>", "<p title=\"", "<a href=x>y<p>", "<p>z", "<h1>", "<form><h1>x", "<button>", "<!--", "<", "<a b='"])
def test_time_grows_with_the_page(piece):
    began = time.perf_counter()
    html_text.main_text("<div>" * 1000 + "<a href=y>" + piece * 100_000)
    assert time.perf_counter() - began < 20


def test_pages_awkward(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x y z</p></article>"), (1, "u", None), (5, "u", "<p>" * 50_000)]
    pages = spark.createDataFrame([(*r, "extra", 3) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = html_text.extract_text(pages).collect()
    assert len(got) == 5 and sorted(r.text for r in got) == ["", "", "", "", "x y z"]
    assert html_text.extract_text(pages.filter("false")).count() == 0


def test_short_pages_and_embedded_content_keep_their_text():
    assert html_text.main_text("<p>Just one line.</p>") == "Just one line."
    assert html_text.main_text("<div class=nav><p>Home</p></div><p>One.</p><p>Two.</p><footer>End</footer>") == "One. Two."
    assert html_text.main_text("<article><p>Euler: <math><mi>e</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>") == "Euler: e=1 holds."
    assert html_text.main_text("<article><p>See <object>the drawing</object> and <video>no video here</video>.</p></article>") == "See the drawing and no video here."


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_mix_meets_its_targets(spark, which):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if which == "table" else awkward(spark)
    rows = docs.select("doc_id", "text", "source").collect()
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    sizes = Counter()
    for r, n in zip(rows, words, strict=True):
        sizes[r.source] += n
    want = water_fill(dict(sizes))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(g.size for g in got) == sorted(words)
    source = {r.doc_id: r.source for r in rows}
    taken = Counter()
    for g in got:
        assert g.target == pytest.approx(want[source[g.doc_id]]) and 0 <= g.taken <= 2 * g.size
        taken[source[g.doc_id]] += g.taken
    for s, t in want.items():
        largest = max(n for r, n in zip(rows, words, strict=True) if r.source == s)
        assert abs(taken[s] - t) <= largest
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs).collect()))


def test_thresholds_equal_a_sort(spark):
    rng = np.random.default_rng(4)
    rows = [("s" if i % 3 else None, int(rng.integers(0, 50)), int(rng.integers(0, 1 << 60))) for i in range(500)] + [("s", 5, 77)] * 3
    sizes = spark.createDataFrame(rows, "source string, size long, cell long")
    aims = spark.createDataFrame([("s", 1234.5), (None, 800.0)], "source string, budget double")
    from pointloom.llm.shared import shared_dir

    got = {r.source: r for r in mixing.thresholds(sizes, aims, shared_dir(spark, "test"), True).collect()}
    for s, budget in (("s", 1234.5), (None, 800.0)):
        own, at = sorted((c, n) for t, n, c in rows if t == s and n), 0
        for c, group in itertools.groupby(own, key=lambda x: x[0]):
            n = sum(x[1] for x in group)
            if at + n >= budget:
                assert (got[s].cell, got[s].below, got[s].upto, got[s].rest) == (c, at, at + n, budget - at)
                break
            at += n


@pytest.mark.parametrize("kind", ["no ids", "one id", "equal rows"])
def test_mix_tells_rows_apart(spark, kind):
    """Rows that share an id, or have none, or are equal: a source still comes as near to its target as one row allows."""
    text = lambda i: " ".join(f"w{i if kind != 'equal rows' else 0}" for _ in range(10))
    rows = [(None if kind == "no ids" else 4, text(i), "a") for i in range(20)] + [(100 + i, "z " * 10, "b") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(docs).collect()
    want = water_fill({"a": 200, "b": 50})
    for size, source in ((200, "a"), (50, "b")):
        assert abs(sum(r.taken for r in got if r.source_size == size) - want[source]) <= 5
    assert sorted((r.size, r.taken, r.target) for r in got) == sorted((r.size, r.taken, r.target) for r in mixing.mix(docs.repartition(2)).collect())


def test_mix_of_nothing(spark):
    assert mixing.mix(empty(spark)).count() == 0
