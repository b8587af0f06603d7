"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive and tags negative, each tag by a weight
that labelled pages give: the log odds of standing inside the marked content, times the factor under which
the scan finds that content best.  A linear scan finds the contiguous run with the largest sum.

Inside of it some elements are no content: scripts, styles, navigation, asides, forms, and those whose class,
id or role names them as menus, adverts, notices, comments and the like.  They hold no words: each costs a
little as a whole and is never part of the text.  An article's own header is content.  Names after a part such as
"no" or "with" say nothing, and so do names of subjects ("legal", "popular") before one of content ("article").
A form or an element with such a class or id that wraps the page (no article or main is outside, and it holds
one, or most words with few outside; for names of subjects, more than there are outside) is left to the scan; no
run crosses its border.  So is a navigation, form or drawing without an end tag, by the weight of its tag.

Defined cases: null or empty html gives an empty text; a page without words has none; a tag
that the page's end cuts off is no text; repeated pages each get their row; extra columns, whatever their
names, are not read; an empty table gives no rows; pages are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from parley.llm.common import lean, strings, table
from parley.llm.labelledpages import labelled_pages

# Elements by kind, in HTML.
RAW = (
    "script", "style", "noscript", "template", "iframe", "textarea", "title", "annotation", "annotation-xml", "object", "xmp",
    "noembed", "noframes"
)
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "fieldset", "label", "datalist", "svg"}
#: Elements of which a slash before the end of the tag closes them.
FOREIGN = {"svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
    "var", "wbr"
}
INLINE |= {
    "math", "mfrac", "mi", "mn", "mo", "mover", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup",
    "mtext", "munder", "munderover", "semantics"
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "adslot", "adbox", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pager", "pagination", "toc",
    "header", "masthead", "topbar", "footer", "bottombar", "copyright", "legal",
    "sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "share", "sharing", "social", "tags",
    "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "paywall",
    "comment", "comments", "commentlist", "replies", "reply", "disqus", "respond", "discussion", "form", "search",
}

#: Parts of a name after which the others describe a layout: no-sidebar, with-menu.
QUALIFIERS = {"no", "not", "non", "without", "with", "has", "have", "hide"}
REPLIES = {"comment", "comments", "commentlist", "replies", "reply", "disqus", "respond"}
#: Names that may be what an article is about, and names of content that they then stand before.
SUBJECTS = {"legal", "popular", "trending", "discussion", "tags", "notice", "alert", "social", "share", "search", "form", "banner", "copyright"}
CONTENT = {"article", "body", "content", "entry", "main", "page", "post", "story", "text"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "article", "main"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/a-z!?][^>]*(?:>|\Z)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
WORD_SCORE = 1.0
#: What an element that can't be content costs as a whole, wherever it stands.
SHUT_SCORE = -0.2
#: A wrapper holds more than so many times the words outside of it, or is none by its words; a form without blocks has so many.
WRAPPER_TIMES, WRAPPER_WORDS = 4, 50

#: Factors of the log odds that are tried on the labelled pages.
FACTORS = (0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0)


def names_boilerplate(rest: str) -> set[str]:
    """What in a tag's class, id, role or hidden attribute marks the element as something else than content.

    Parts of classes and ids; "*" for a role or a hidden element, which no wrapper of a page has.
    """
    found = set()
    for m in ATTRIBUTE.finditer(rest):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true" or kind == "role" and value.lower() in ROLES:
            found.add("*")
        if kind in ("class", "id"):
            for one in value.split():
                parts = [x.lower() for x in NAME_PARTS.findall(one)]
                for part in parts:
                    if part in SUBJECTS and parts[-1] in CONTENT:
                        continue
                    if part in QUALIFIERS:
                        break
                    if part in NAMES:
                        found.add(part)
    return found


def pieces(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text): kind is text, open, close or none (a comment, a raw element, a cut tag)."""
    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            yield "text", "", html[at : m.start()]
        at = m.end()
        if m["name"]:
            yield ("close" if m["close"] else "open"), m["name"].lower(), m["rest"]
        else:
            yield "none", (m["raw"] or "").lower(), ""
    if at < len(html):
        yield "text", "", html[at:]


def log_odds(labelled: Iterable[str]) -> dict[str, float]:
    """Of each tag the log odds of an occurrence inside the content, among those that the scan looks at."""
    sides: tuple[dict, dict] = ({}, {})
    for html in labelled:
        content = False
        for kind, name, _, before, after in steps_of(html):
            if name == "content":
                content = kind == "open"
            elif kind in ("open", "close") and not before.shut and not (name == "header" and after.shut):  # a page's own header is none of an article's
                side = sides[content]
                side[name] = side.get(name, 0) + 1
    totals = [sum(side.values()) + 1 for side in sides]
    rate = lambda side, name: math.log((side.get(name, 0) + 0.5) / totals[side is sides[1]])
    return {name: rate(sides[1], name) - rate(sides[0], name) for name in {*sides[0], *sides[1]}}


def agreement(labelled: Iterable[str], weights: dict[str, float]) -> float:
    """Mean share of words that the extracted texts and the content have in common."""
    total = 0.0
    for html in labelled:
        inside = html[html.index("<content>") + 9 : html.index("</content>")]
        want = Counter(re.sub(r"<[^>]*>", " ", inside).split())
        got = Counter(extract(html.replace("<content>", "").replace("</content>", ""), weights).split())
        total += 2 * (want & got).total() / max((want + got).total(), 1)
    return total / len(labelled)


@lru_cache(maxsize=1)
def tag_weights() -> dict[str, float]:
    """The score of each tag's occurrence, below 0; the entry "" is for tags that no labelled page has."""
    pages = labelled_pages()
    odds = log_odds(pages)
    tries = [{"": -0.5} | {name: min(-0.05, factor * x) for name, x in odds.items()} for factor in FACTORS]
    return max(tries, key=lambda w: agreement(pages, w))


class Element:
    """An element that can't be content by its name, and what it holds."""

    def __init__(self, up: Element | None, name: str, marks: set[str]):
        self.up, self.name, self.marks = up, name, marks
        self.ended = self.shut = False
        self.borders = 0  # how many wrappers it is in, itself among them
        self.words = self.direct = 0  # words inside, and those in no further such element
        self.blocks = self.content = False  # whether it holds blocks of text; an article or main
        self.may_wrap = "*" not in marks and (up is None or up.may_wrap) and (name == "form" or name not in BOILERPLATE)


def judge(page: Element, elements: list[Element]) -> None:
    """Sets which elements are shut; outer ones come first."""
    page.words = page.direct
    for e in reversed(elements):
        e.words += e.direct
        e.up.words += e.words
        if e.up is not page:  # the page's own article or main stands outside of all these
            e.up.blocks |= e.blocks
            e.up.content |= e.content
    pool = page.words - sum(e.words for e in elements if not e.may_wrap and (e.up is page or e.up.may_wrap))
    open_words = page.direct
    for e in elements:
        e.borders, e.shut = e.up.borders, True
        if e.up.shut or "*" in e.marks:
            continue
        loose = not e.ended and e.name in ("nav", "form", "menu", "svg") and e.blocks
        subject = bool(e.marks) and e.marks <= SUBJECTS and e.name not in BOILERPLATE
        enough = e.blocks or e.words >= WRAPPER_WORDS or subject and not open_words
        most = enough and 2 * e.words > pool and e.words > (1 if subject else WRAPPER_TIMES) * open_words and not (open_words and e.marks & REPLIES)
        if loose or (e.may_wrap or not e.ended) and not page.content and (e.content or most):
            e.shut = False
            e.borders += not loose
            open_words += e.direct


def best_run(scores: Iterable[float]) -> tuple[int, int]:
    """(begin, end) of the contiguous run with the largest sum above 0; of equal ones the first, at its longest."""
    best, best_at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total < 0:
            total, begin = 0.0, i
        total += score
        if total > best or total == best and best_at[0] == begin and best > 0:
            best, best_at = total, (begin, i + 1)
    return best_at


def steps_of(html: str) -> list[tuple[str, str, str, Element, Element]]:
    """(kind, name, text, the innermost element that may be no content before and after) of each piece, judged."""
    page = Element(None, "", set())
    elements: list[Element] = []
    stack: list[tuple[str, Element, bool]] = []  # (name, innermost element that can't be content, whether it is this one)
    here, steps = page, []
    for kind, name, text in pieces(html):
        before = here
        if kind == "text":
            here.direct += len(text.split())
        elif kind == "open" and name not in VOID:
            marks = names_boilerplate(text)
            bad = name in BOILERPLATE
            if (name == "header" or "header" in marks) and here is page and any(x in ("article", "main") for x, _, _ in stack):
                marks, bad = marks - {"header"}, bad and name != "header"  # the content's own
            bad = bad or marks and name not in ("html", "body", "article", "main")
            if name in BLOCKS:
                here.blocks = True
                here.content |= name in ("article", "main") and not marks
            if not text.rstrip().endswith("/") or name in BOILERPLATE - FOREIGN:
                if bad:
                    here = Element(here, name, marks)
                    elements.append(here)
                stack.append((name, here, bool(bad)))
        elif kind == "close":
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None and not (name in INLINE and any(x not in INLINE for x, _, _ in stack[depth + 1 :])):
                if stack[depth][2]:
                    stack[depth][1].ended = True
                del stack[depth:]
                here = stack[-1][1] if stack else page
        steps.append((kind, name, text, before, here))
    judge(page, elements)
    return steps


def extract(html: str | None, weights: dict[str, float] | None = None) -> str:
    """The page's main text: blocks joined by two line feeds."""
    if not html:
        return ""
    weights = weights or tag_weights()
    unknown = weights[""]
    steps = steps_of(html)
    runs: list[tuple[float, str | None, bool]] = []  # (score, text, whether a block ends here)
    for kind, name, text, before, after in steps:
        if kind == "text":
            if not after.shut:
                runs.append((WORD_SCORE * len(text.split()), text, False))
            continue
        block = name not in INLINE
        if before.borders != after.borders and not before.shut and not after.shut:
            score = -math.inf
        else:
            score = 0.0 if kind == "none" or before.shut else SHUT_SCORE if after.shut else weights.get(name, unknown)
        runs.append((score, " " if name == "br" else None, block and kind != "none"))
    begin, end = best_run(score for score, _, _ in runs)
    blocks, held = [], []
    for _, text, ends in runs[begin:end]:
        if text is not None:
            held.append(text)
        elif ends:
            blocks.append("".join(held))
            held = []
    blocks.append("".join(held))
    return "\n\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    weights = tag_weights()  # learnt once, by the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [extract(x.as_py(), weights) for x in strings(part.column("html"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    ["page_id", "url", "text", "n_chars"]
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(lean(run), f"page_id {kind}, url string, text string, n_chars long")


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
