"""Main text of HTML pages by two-pass block rules.

The page is cut into blocks of text at block-level tags; scripts, styles and comments yield none.

Pass one classifies each block by its words. Bad: blocks inside menus, footers, forms, adverts, comments and the like (by
tag, role, or a class or id that names nothing else) and blocks of which links hold much of the text. Good: blocks of
at least MID characters dense in stop words. Blocks of that length that lack them are bad, unless they stand in one container
with good ones or in an article; where the whole page lacks them, its language is unknown
and length decides alone. Shorter blocks stay undecided.

Pass two gives every undecided block the label of its nearest decided neighbours, first of those in its own
container, else of all: good if one side is good and the other is good or missing, or, between a good and a
bad side, if the good one is not farther. What stands outside an article element says nothing about
the undecided blocks in it, which are good by themselves. On a page without any good block or article, undecided blocks
in the container of the first top heading are good, or, where that leaves none, all undecided blocks.

Kept blocks have their character references decoded, white space turned into
single spaces and trimmed, and are joined in page order by one space.

Defined cases: null and empty pages give empty text; unclosed comments, scripts and
tags run to the end of the page; other unclosed elements, such as links, end where that is first noticed; stray quotes in tags belong to
the attribute they stand in; stray end tags are ignored, in time that grows with the page; repeated rows give repeated
results; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.shared import small_batches

#: Fixed lists: frequent function words, and names of tags and of page parts.
STOP_WORDS = frozenset(
    "the of and a to in is that it for on with as was are be this from at by or an not have he you his they we but had which "
    "der die das und ist von den mit sich des auf für nicht ein eine als auch es an werden dem zu "
    "le la les de des et est un une que qui dans pour par sur pas au avec ce il plus ne se sont "
    "el los las y que en un una por con para del se no su al lo como más es".split()
)
RAW_TAGS = frozenset("script style template noscript textarea iframe title select svg canvas button".split())
VOID_IF_CLOSED = frozenset(["svg"])  # may end in />
BAD_TAGS = frozenset("nav footer aside form menu dialog".split())
ARTICLE_TAGS = frozenset("article main".split())
BLOCK_TAGS = frozenset(
    "p div section article main nav header footer aside form menu dialog ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address fieldset legend details summary center body html hr hgroup search".split()
)
CONTAINERS = frozenset("div section article main td header footer nav aside form body center details fieldset".split())
SELF_CLOSED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion promoted sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer cookie cookies consent notice notices newsletter subscribe subscription social share sharing related recommended "
    "comment comments commentlist disqus replies popup modal overlay login signup copyright pagination pager toolbar skip".split()
)
#: Parts of a name that say where or in what something stands; beside them a bad part still names the whole.
PLACE_NAMES = frozenset("box bar wrap wrapper container list links link block section area panel inner site page main top bottom left right item items buttons button btn form text message post posts slot unit widget row col primary secondary article reader user the js content".split())
BAD_OUTSIDE = frozenset("header masthead topbar".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

_ATTRIBUTES = r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+"
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?<![^\s/\"'])(class|id|role|hidden|aria-hidden|href|itemprop)(?![^\s/>=])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"[^\W\d_]+")
_DENSE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")  # scripts that need about a third of the characters
MID = 140  # characters
STOP_LOW = 0.1  # share of a block's words
STOP_KNOWN = 0.05  # share of a page's words
LINKS_HIGH = 0.4
GOOD, BAD, OPEN = 1, -1, 0


class _Element:
    __slots__ = ("tag", "parent", "own_bad", "article", "box", "form", "holds_main", "bad")

    def __init__(self, tag: str, parent: _Element | None, own_bad: bool, article: int):
        self.tag, self.parent, self.own_bad, self.article, self.holds_main = tag, parent, own_bad, article, False
        self.bad: bool | None = None
        self.box = self if parent is None or tag in CONTAINERS else parent.box
        self.form = self if tag == "form" else parent.form if parent else None

    def is_bad(self) -> bool:
        """Whether this or an element around it is no part of an article; forms and names around the main part do not count. To be asked when the page is read."""
        unknown, e = [], self
        while e is not None and e.bad is None:
            unknown.append(e)
            e = e.parent
        for e in reversed(unknown):
            e.bad = (e.parent is not None and e.parent.bad) or (e.own_bad and (not e.holds_main or e.tag in ("nav", "aside", "footer")))
        return self.bad


def _is_bad_name(value: str, in_article: bool) -> bool:
    """Whether one of the names in a class or id says nothing but a bad part (and its place)."""
    for name in value.split():
        parts = [x for x in _PARTS.findall(_CAMEL.sub("-", name).lower()) if len(x) > 1]
        bad = BAD_NAMES if in_article else BAD_NAMES | BAD_OUTSIDE
        if any(x in bad for x in parts) and all(x in bad or x in PLACE_NAMES for x in parts):
            return True
    return False


def _attributes(attrs: str) -> dict[str, str]:
    return {name.lower(): "".join(values) for name, *values in reversed(_ATTR.findall(attrs))} if attrs else {}


def _is_bad(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element's tag or names mark it as no part of an article."""
    if tag in BAD_TAGS or (tag == "header" and not in_article) or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in BAD_ROLES:
        return True
    return tag not in ("html", "body") and any(_is_bad_name(attrs[k], in_article) for k in ("class", "id") if k in attrs)


class Block:
    """Text between block-level tags, and where it stood."""

    __slots__ = ("text", "element", "linked", "label", "heading")

    def __init__(self, text: str, element: _Element):
        self.text, self.element, self.linked, self.label, self.heading = text, element, 0, OPEN, element.tag == "h1"


class _Parser:
    """One pass over a page's tags."""

    def __init__(self, page: str):
        self.page, self.out, self.parts = page, [], []
        self.top = _Element("", None, False, 0)
        self.open: Counter[str] = Counter()  # tags of the open elements
        self.articles = 0
        self.link: list[tuple[Block, int]] | None = None  # earlier blocks of the open link and its characters there
        self.in_link = 0  # the open link's characters in the current block
        self.linked = 0  # characters of closed links in the current block

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        self.parts.clear()
        block = Block(text, self.top) if text else None
        if block:
            block.linked = self.linked
            self.out.append(block)
            if self.link is not None and self.in_link:
                self.link.append((block, self.in_link))
        self.linked = self.in_link = 0

    def text(self, piece: str) -> None:
        self.parts.append(piece)
        if self.link is not None:
            self.in_link += len(piece.strip())

    def close_link(self) -> None:
        """Only links that are closed count: an unclosed one would hold the rest of the page."""
        for block, n in self.link or []:
            block.linked += n
        self.linked += self.in_link
        self.link, self.in_link = None, 0

    def pop(self) -> None:
        self.open[self.top.tag] -= 1
        self.top = self.top.parent

    def start(self, tag: str, raw: str) -> None:
        self.flush()
        for closes in ({"p"} if self.top.tag == "p" else (), SELF_CLOSED.get(tag, ())):
            while self.top.tag in closes:
                self.pop()
        if tag == "hr" or (raw.endswith("/") and tag not in ARTICLE_TAGS and tag != "p" and tag != "div"):
            return
        attrs, article = _attributes(raw), self.top.article
        main = tag in ARTICLE_TAGS or attrs.get("role", "").lower() == "main" or "articlebody" in attrs.get("itemprop", "").lower()
        if main:
            self.articles += 1
            article = self.articles
        e = self.top if main else None
        while e is not None and not e.holds_main:
            e.holds_main, e = True, e.parent
        if tag == "h1" and self.top.form:  # a form around the page
            self.top.form.holds_main = True
        element = _Element(tag, self.top, not main and _is_bad(tag, attrs, bool(article)), article)
        self.top = element
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        self.flush()
        if self.open[tag]:
            while self.top.tag != tag:
                self.pop()
            self.pop()

    def run(self) -> list[Block]:
        page, at, last = self.page, 0, len(self.page)
        lower, no_end = None, set()
        while at < last and (token := _TOKEN.search(page, at)):
            if token.start() > at:
                self.text(page[at : token.start()])
            at = token.end()
            tag = (token["tag"] or "").lower()
            if not tag:
                continue
            if token["end"]:
                if tag == "a":
                    self.close_link()
                elif tag in BLOCK_TAGS:
                    self.end(tag)
            elif tag in RAW_TAGS:
                if tag in no_end or (tag in VOID_IF_CLOSED and token["attrs"].endswith("/")):
                    continue
                lower = page.lower() if lower is None else lower
                lower = lower if len(lower) == last else re.sub("[A-Z]", lambda m: m[0].lower(), page)
                found = lower.find(f"</{tag}", at)
                if found >= 0:
                    end = page.find(">", found)
                    at = end + 1 if end >= 0 else last
                elif tag in ("script", "style", "template", "textarea", "title", "iframe", "noscript"):
                    at = last
                else:
                    no_end.add(tag)
            elif tag == "a":
                self.link, self.in_link = [] if "href" in _attributes(token["attrs"]) else None, 0
            elif tag == "br":
                self.parts.append(" ")
            elif tag in BLOCK_TAGS:
                self.start(tag, token["attrs"])
        self.text(page[at:])
        self.flush()
        return self.out


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order."""
    return _Parser(page).run()


def _first_labels(found: list[Block]) -> None:
    long: list[tuple[Block, int, int]] = []
    for b in found:
        if b.element.is_bad() or b.linked > LINKS_HIGH * len(b.text):
            b.label = BAD
        elif len(b.text) + 2 * len(_DENSE.findall(b.text)) >= MID:
            words = _WORDS.findall(b.text.lower())
            long.append((b, sum(w in STOP_WORDS for w in words), len(words)))
    known = sum(n for _, n, _ in long) >= STOP_KNOWN * sum(n for _, _, n in long)
    boxes = set()
    weak = []
    for b, stop, words in long:
        if not known or stop >= STOP_LOW * words:
            b.label = GOOD
            boxes.add(id(b.element.box))
        elif not b.element.article:
            weak.append(b)
    for b in weak:
        b.label = OPEN if id(b.element.box) in boxes else BAD


def _neighbours(found: list[Block], keys: list) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """For each block (label, distance) of the nearest decided blocks with its key before and after it; label 0 for none."""
    sides = []
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict = {}
        side = [(0, 0)] * len(found)
        for i in order:
            label, at = last.get(keys[i], (0, i))
            side[i] = (label, abs(i - at))
            if found[i].label:
                last[keys[i]] = (found[i].label, i)
        sides.append(side)
    return list(zip(*sides, strict=True))


def _inherited(left: tuple[int, int], right: tuple[int, int]) -> int:
    """The label that two neighbours give; 0 where there is none."""
    if left[0] == right[0] or not left[0] or not right[0]:
        return left[0] or right[0]
    return GOOD if left[1] == right[1] else left[0] if left[1] < right[1] else right[0]


def classify(found: list[Block]) -> None:
    """Set each block's label to GOOD or BAD."""
    _first_labels(found)
    articles = [b.element.article for b in found]
    near = _neighbours(found, [id(b.element.box) for b in found])
    wide = _neighbours(found, articles)
    every = _neighbours(found, [0] * len(found))
    labels = []
    for i, b in enumerate(found):
        label = b.label or _inherited(*near[i])
        if not label and b.element.article:  # what stands outside the article says nothing about it
            label = _inherited(*wide[i]) or GOOD
        labels.append(label or _inherited(*every[i]) or BAD)
    if GOOD not in labels and not any(articles):
        box = next((b.element.box for b in found if b.heading and b.label != BAD), None)
        labels = [GOOD if b.label == OPEN and b.element.box is box else x for b, x in zip(found, labels, strict=True)]
    if GOOD not in labels:  # a page of short blocks alone: all that nothing speaks against
        labels = [GOOD if b.label == OPEN else x for b, x in zip(found, labels, strict=True)]
    for b, label in zip(found, labels, strict=True):
        b.label = label


def main_text(page: str | None) -> str:
    """The main text of a page."""
    found = blocks(page) if page else []
    classify(found)
    return " ".join(b.text for b in found if b.label == GOOD)


def extract_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
