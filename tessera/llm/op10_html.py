"""Main text of HTML pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by the element they stand in, tags score below zero; the weights are
learned from labelled pages (those whose own marks, such as ``article`` or ``main``, say where the content is), blended
with a prior. One linear scan finds the contiguous region with the largest sum. Blocks of the region that stand in an
element that is no article text (navigation, header and footer, sidebar, notice, advert, form, comments) are left out;
their words and tags count 0 in the scan, so they don't split the region.

An element stands apart by its tag or by its names. A name counts if all its words are known: ``cookie-notice`` does,
``search-engines`` doesn't. Names of adverts, notices, menus, sidebars, footers and comments count everywhere; others,
such as ``legal`` or ``search``, only outside of marked content, and only if labelled pages have them mostly outside.

Weights are fitted on about ``TRAIN_ROWS`` pages chosen by a hash of their id; extraction reads every whole page once,
with one pass and a stack of open containers, and shuffles nothing.

Defined results: null or empty html, or a page without a word outside such elements, gives the empty text. Unclosed or
crossed tags, comments and scripts are taken as far as they go; an article mark ends what was left open before it. Plain
text without tags is one block. Repeated rows are extracted each.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .op06_langid import sampled

TRAIN_ROWS, PRIOR = 1000, 50.0
# Elements by their role in a page, as HTML defines them, and names that sites give to what is no article.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas head title textarea select option button audio video map".split())
APART = frozenset("nav footer aside form dialog menu".split())
CONTAINERS = frozenset("div section article main header nav footer aside form dialog menu ul ol dl table tbody thead tfoot body html blockquote figure details fieldset center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption pre hr address figcaption summary legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMEABLE = HEADINGS | frozenset("p li td th dd dt figcaption pre".split())
ARTICLE_NAMES = frozenset("comment comments reply ad ads promo* related".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Names of what is no article text wherever it stands, and names that say so outside of marked content only. Word starts
#: (ending in *) stand for all words that begin so. NEUTRAL words may stand beside them in a name, others may not.
APART_NAMES = frozenset(
    "ad ads adbox adslot advert* sponsor* promo* cookie cookies consent gdpr notice notices alert disclaimer popup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer complementary contentinfo "
    "comment comments commentlist disqus reply replies respond share sharing social related recommend* newsletter subscribe subscription signup".split()
)
OUTSIDE_NAMES = frozenset("banner modal overlay side header masthead topbar toolbar login search pagination pager tags widget copyright legal skip".split())
NEUTRAL = frozenset(
    "site page main left right top bottom inner outer box block container wrap wrapper area list item items section sections bar body content form link links title text unit slot module panel row col column columns "
    "group global primary secondary post article entry blog user js mobile desktop sticky fixed small large all by the to and of in for a".split()
)
_OPEN = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:\-]*)")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?<![\w\-])hidden(?![\w\-])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Score of a word and a tag before any page was seen; kinds of words are the element that holds them.
WORD_PRIOR = {"p": 0.95, "h": 0.9, "li": 0.6, "a": 0.15, "td": 0.6, "quote": 0.95, "div": 0.7, "apart": 0.02}
#: Elements of a name that are taken to have been seen inside and outside of content.
NAME_PRIOR = (1, 9)
TAG_PRIOR = {"p": 0.9, "h": 0.8, "li": 0.4, "a": 0.2, "td": 0.5, "quote": 0.9, "div": 0.4, "apart": 0.02, "inline": 0.85, "article": 0.95}


_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _names(attributes: str) -> list[list[str]]:
    """The words of each name that an element has: of classes, id, role and item property, and of its label as a whole."""
    out = []
    for what, *values in _NAMES.findall(attributes):
        value = next(filter(None, values), "")
        for name in [value] if what.lower() == "aria-label" else value.split():
            out.append([w.lower() for w in _WORDS.findall(name)])
    return out


def _listed(word: str, names: frozenset[str]) -> bool:
    return word in names or any(word.startswith(n[:-1]) for n in names if n[-1] == "*")


def _found(names: list[list[str]], known: frozenset[str]) -> set[str]:
    """The words of ``known`` that a name is made of, beside neutral words only."""
    out = set()
    for words in names:
        hit = {w for w in words if _listed(w, known)}
        if hit and all(w in hit or w in NEUTRAL or _listed(w, APART_NAMES | OUTSIDE_NAMES) for w in words):
            out |= hit
    return out


def tags(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each tag; comments, declarations and instructions have no name.

    Linear: a place from which quotes were found not to close is not tried again, and without a > there is no more tag.
    """
    at, dead = 0, set()
    while (start := source.find("<", at)) >= 0:
        at = start + 1
        for opening, ending in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if source.startswith(opening, start):
                end = source.find(ending, start + len(opening))
                at = len(source) if end < 0 else end + len(ending)
                yield start, at, False, "", ""
                break
        else:
            m = _OPEN.match(source, at)
            if m is None and source[at : at + 1] not in ("!", "?"):
                continue
            end = source.find(">", at) if m is None else _tag_end(source, m.end(), dead)
            if end < 0:
                return
            at = end + 1
            yield (start, at, bool(m[1]), m[2].lower(), source[m.end() : end]) if m else (start, at, False, "", "")


def _tag_end(source: str, at: int, dead: set[int]) -> int:
    """Place of the > that ends a tag, quoted ones passed over; the first > where quotes don't close; -1 without any."""
    first, seen = at, []
    while (m := _STOP.search(source, at)) and m.start() not in dead:
        if m[0] == ">":
            return m.start()
        seen.append(m.start())
        close = source.find(m[0], m.end())
        if close < 0:
            break
        at = close + 1
    dead.update(seen)
    return source.find(">", first)


def _kind(tag: str) -> str:
    if tag in HEADINGS:
        return "h"
    if tag in ("p", "a", "li"):
        return tag
    if tag in ("td", "th", "tr", "table", "tbody", "thead", "dt", "dd", "dl", "caption"):
        return "td"
    if tag in ("blockquote", "pre", "figure", "figcaption"):
        return "quote"
    if tag in ("article", "main"):
        return "article"
    return "div" if tag in BLOCKS else "inline"


class Page:
    """Tokens of a page: (word kind or tag kind, is a word run, words, text, block number, stands apart, in marked content).

    ``outside``: which of OUTSIDE_NAMES count. ``named``: (name, in marked content) of the elements that have such a name.
    """

    def __init__(self, source: str, outside: frozenset[str] = OUTSIDE_NAMES):
        self.tokens: list[tuple] = []
        self.named: list[tuple[str, bool]] = []
        stack: list[tuple[str, bool, bool, bool]] = []  # element, apart, marked as content, in an article
        open_: Counter = Counter()
        block, link, kind, skip = 0, 0, "div", None
        apart = marked = False
        at = 0

        def text(s: str) -> None:
            if skip is None and s:
                n = len(s.split())
                k = "apart" if apart else "a" if link else kind
                self.tokens.append((k, True, n, s, block, apart, marked))

        def push(tag: str, apart: bool, marked: bool, inside: bool) -> None:
            stack.append((tag, apart, marked, inside))
            open_[tag] += 1

        def pop() -> str:
            tag = stack.pop()[0]
            open_[tag] -= 1
            return tag

        def named(tag: str, names: list[list[str]]) -> bool:
            """Whether a name says that the element is no article text."""
            weak = _found(names, OUTSIDE_NAMES)
            self.named.extend((w, marked) for w in weak)
            return bool(_found(names, APART_NAMES)) or (not marked and bool(weak & outside))

        for start, end, closing, tag, attributes in tags(source):
            if start < at:
                continue
            text(source[at:start])
            at = end
            if not tag:
                continue
            if skip is not None:
                if closing and tag == skip:
                    skip = None
                elif skip in ("head", "title") and tag in ("body", "article", "main"):
                    skip = None
                else:
                    continue
                if closing:
                    continue
            if tag in SKIPPED and not closing:
                if not attributes.rstrip().endswith("/"):
                    skip = tag
                    if tag in ("script", "style", "textarea"):
                        over = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                        at = len(source) if over is None else over.start()
                        if over is None:
                            break
                continue
            if tag in ("article", "main") and not closing:
                while stack and stack[-1][1] and not stack[-1][3]:
                    pop()
                apart, marked = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            if tag in CONTAINERS:
                if closing:
                    while open_[tag] and pop() != tag:
                        pass
                else:
                    names = _names(attributes)
                    _, own, marks, inside = stack[-1] if stack else ("", False, False, False)
                    own = own or tag in APART or (tag == "header" and not inside) or bool(_HIDDEN.search(attributes))
                    if tag == "article":
                        own = own or bool(_found(names, ARTICLE_NAMES))
                    elif tag not in ("body", "html", "main"):
                        own = named(tag, names) or own
                    content = tag in ("article", "main")
                    push(tag, own, marks or content or ["article", "body"] in names or ["articlebody"] in names, inside or content)
                apart, marked = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            elif tag in NAMEABLE and not closing and not apart and attributes:
                if named(tag, _names(attributes)):
                    push(tag, True, marked, stack[-1][3] if stack else False)
                    apart = True
            elif closing and stack and stack[-1][0] == tag:
                pop()
                apart, marked = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            if tag in BLOCKS:
                block += 1
                kind = _kind(tag) if not closing else _kind(stack[-1][0]) if stack else "div"
                kind = "div" if kind in ("article", "inline") else kind
                link = 0
            elif tag == "br":
                text(" ")
            elif tag == "a":
                link = 0 if closing else 1
            if tag not in VOID:
                self.tokens.append(("apart" if apart else _kind(tag), False, 0, "", block, apart, marked))
        if skip is None:
            text(source[at:])


class Weights:
    """Scores of words and tags by kind: log odds of standing in content, words cut at 0 from below, tags from above."""

    def __init__(self, counts: Counter | None = None):
        counts = counts or Counter()
        self.word, self.tag = {}, {}
        for table, prior, is_word in ((self.word, WORD_PRIOR, True), (self.tag, TAG_PRIOR, False)):
            for k, p in prior.items():
                inside, outside = counts[k, is_word, True], counts[k, is_word, False]
                scale = min(1.0, PRIOR / max(inside + outside, 1))
                p = (p * PRIOR + inside * scale) / (PRIOR + (inside + outside) * scale)
                table[k] = max(0.0, 1 + math.log(p / (1 - p)) / 3) if is_word else min(-0.1, -1 + math.log(p / (1 - p)) / 3)
        # what stands apart is cut from the output anyway, so it doesn't split the content around it
        self.word["apart"] = self.tag["apart"] = 0.0
        self.word.setdefault("inline", self.word["div"])
        # names that labelled pages mostly have inside their content say nothing against it elsewhere
        inside = lambda w: (NAME_PRIOR[0] + counts[f"name:{w}", False, True]) / (sum(NAME_PRIOR) + counts[f"name:{w}", False, True] + counts[f"name:{w}", False, False])
        self.outside = frozenset(w for w in OUTSIDE_NAMES if inside(w) < 0.5)


def best_region(tokens: list[tuple], weights: Weights) -> tuple[int, int]:
    """First and end of the contiguous run of tokens with the largest sum; empty if no sum is above zero."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, is_word, n, *_rest) in enumerate(tokens):
        if total <= 0:
            total, start = 0.0, i
        total += weights.word[kind] * n if is_word else weights.tag[kind]
        if total > best:
            best, at = total, (start, i + 1)
    return at


def extract(source: str | None, weights: Weights) -> str:
    """The page's main text: one line per block."""
    if not source:
        return ""
    tokens = Page(source, weights.outside).tokens
    first, end = best_region(tokens, weights)
    blocks: dict[int, list[str]] = {}
    for _kind_, is_word, _n, s, block, apart, _marked in tokens[first:end]:
        if is_word and not apart:
            blocks.setdefault(block, []).append(s)
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", train_rows: int = TRAIN_ROWS) -> Weights:
    """Weights from the sampled pages that mark their content; without such pages the prior."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for source in batch.column(0).to_pylist():
                page = Page(source or "")
                if any(t[6] for t in page.tokens):
                    for t in page.tokens:
                        total[t[0], t[1], t[6] and not t[5]] += t[2] if t[1] else 1
                    for name, inside in page.named:
                        total[f"name:{name}", False, inside] += 1
        rows = [(k, w, c, n) for (k, w, c), n in total.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["kind", "is_word", "inside", "n"])

    rows = sampled(pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(html_col).alias("html")), "id", train_rows)
    counts = rows.select("html").mapInArrow(count, "kind string, is_word boolean, inside boolean, n long").groupBy("kind", "is_word", "inside").agg(F.sum("n").alias("n")).collect()
    return Weights(Counter({(r.kind, r.is_word, r.inside): r.n for r in counts}))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``."""
    held = pages.sparkSession.sparkContext.broadcast(fit_weights(pages, id_col, html_col))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, held.value) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(scan, "page_id long, url string, text string, n_chars long")
