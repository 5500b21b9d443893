"""Main text of web pages: the marked article, or else by line-block distribution.

Markup is stripped to lines, one per block element that holds text. Scripts, styles and
containers that are never part of an article (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments) leave no lines.

A page that marks its article (``article`` or ``main``) gives the lines inside the mark,
all of them; line-block distribution decides nothing there, because it would drop short
blocks of a text whose bounds the page states.

On other pages link text counts nothing, and the lengths are summed over a sliding window
of lines. The text begins at the first surge, where the sum rises above the threshold, or
at the lines with text of their own right before it. From there to the last dive every run
is kept whole: a run begins at a line with text of its own and ends where the sum falls to
zero, which is where a window holds links alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermem.llm.common import text_rows

WINDOW = 3
SURGE = 80
DROPPED = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>"
    r"|<svg(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+(?<=/)>"
    r"|<(script|style|noscript|template|svg|iframe|object|canvas|title|textarea|select|button)(?=[\s/>])[^>]*>(?:.*?</\1\s*>|.*)",
    re.S | re.I,
)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
CONTAINERS = frozenset("nav header footer aside form menu dialog fieldset".split())
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer header masthead comment comments reply replies discussion disqus respond cookie cookies "
    "consent notice notices alert popup modal newsletter subscribe signup login share sharing social related recommended widget "
    "pagination pager toolbar contentinfo complementary search".split()
)
#: Names that parts of an article also bear, and words that stand beside a name without changing it.
SHARED = frozenset("discussion header notice notices alert search social promotion".split())
PLAIN = frozenset(
    "list lists box boxes wrapper wrap container item items link links left right top bottom main site page slot unit block button buttons "
    "area section bar inner outer posts stories form icon icons primary secondary global mobile desktop sticky thread".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may lack an end tag: the start tags that end them, and the elements that shield them from these.
OPEN_ENDED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))), "tr": (frozenset(("tr", "tbody", "tfoot")), frozenset(("table",))),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl",)))),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th", "tr", "tbody", "tfoot")), frozenset(("table",)))),
}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u "
    "var wbr img label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(("article", "main"))


def _named(name: str, inside: bool) -> bool:
    """Whether a whole class, role or id names a container; words beside it must not change its meaning."""
    words = {w for w in re.split(r"[\W\d_]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if len(w) > 1}
    names = words & NAMES
    return bool(names) and words <= NAMES | PLAIN and not (inside and names <= SHARED)


def _boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is never part of an article. Names of headings say nothing, nor do ids of sections or inside an article."""
    if tag in CONTAINERS:
        return True
    if tag in ("body", "html", *ARTICLE, *HEADINGS) or "=" not in attributes:
        return False
    used = ("class", "role") if inside or tag == "section" else ("class", "role", "id")
    for key, *values in ATTRIBUTE.findall(attributes):
        if key.lower() in used and any(_named(name, inside) for name in "".join(values).split()):
            return True
    return False


def _ends(skipped: str, opened: list[str], ending: bool, tag: str, inside: int) -> bool:
    """Whether a block tag ends a skipped element that has no end tag of its own before it."""
    if tag in ARTICLE and bool(ending) == (inside > 0):
        return True
    if ending:  # of a parent, as no element inside is open by this name
        return skipped == "p" or skipped in OPEN_ENDED
    closers, shields = OPEN_ENDED.get(skipped, (frozenset(), frozenset()))
    return skipped == "p" or (tag in closers and not shields.intersection(opened))


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """Text, length (link text outside an article counts nothing) and the article mark of every line of a page."""
    page = DROPPED.sub(" ", page)
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    state = {"linked": 0, "inside": 0}

    def close() -> None:
        text = " ".join("".join(parts).split())
        lines.append((text, max(0, len(text) - (0 if state["inside"] else state["linked"])), state["inside"] > 0))
        parts.clear()
        state["linked"] = 0

    skipped, opened, anchors, at = "", [], 0, 0
    for found in TAG.finditer(page):
        if not skipped and found.start() > at:
            text = html.unescape(page[at:found.start()])
            parts.append(text)
            state["linked"] += len(text) if anchors else 0
        at = found.end()
        ending, tag = found[1] if found[2] else found[4], (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if skipped:
            if tag in INLINE or tag in VOID:
                continue
            if ending and tag in opened:
                del opened[len(opened) - 1 - opened[::-1].index(tag):]
            elif ending and tag == skipped:
                skipped = ""
            elif _ends(skipped, opened, ending, tag, state["inside"]):
                skipped = ""
            elif not ending and not found[0].endswith("/>"):
                opened.append(tag)
            if skipped or (ending and tag not in ARTICLE):
                continue
        if tag in INLINE:
            anchors += (1 if not ending else -min(1, anchors)) if tag == "a" else 0
            continue
        close()
        if tag in ARTICLE:
            state["inside"] = max(0, state["inside"] + (-1 if ending else 1))
        elif not ending and tag not in VOID and not found[0].endswith("/>") and _boilerplate(
                tag, found[3] or found[6] or "", state["inside"] > 0):
            skipped, opened = tag, []
    if not skipped:
        rest = page[at:]
        parts.append(html.unescape(rest[:rest.find("<")] if re.search(r"<[a-zA-Z/!?]", rest) else rest))
    close()
    return lines


def main_text(page: str | None) -> str:
    """The article's text: white space inside a block is one space, blocks are joined by one space."""
    lines = [line for line in lines_of(page or "") if line[0]]
    if any(inside for _, _, inside in lines):
        return " ".join(text for text, _, inside in lines if inside)
    lengths = [length for _, length, _ in lines]
    sums = [sum(lengths[i:i + WINDOW]) for i in range(len(lengths))]
    surge = min(SURGE, max(sums, default=0))
    first = next((i for i, (length, total) in enumerate(zip(lengths, sums)) if length and total >= surge), len(lines))
    while first and lengths[first - 1]:
        first -= 1
    kept, running = [], False
    for i in range(first, len(lines)):
        running = sums[i] > 0 and (running or lengths[i] > 0)
        if running:
            kept.append(lines[i][0])
    return " ".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Id, ``text`` and the columns of ``keep`` of every page.

    A null or empty page, or one without an article, gives an empty text; repeated rows
    each give a row; an empty table gives none. Other columns are not read.
    """
    used = pages.select(F.col(id_col).alias("id_"), F.col(html_col).alias("html_"), *(F.col(k).alias(f"keep{i}_") for i, k in enumerate(keep)))
    fields = [(id_col, used.schema["id_"].dataType), *((k, used.schema[f"keep{i}_"].dataType) for i, k in enumerate(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for ids, texts in text_rows([batch]):
                out = [main_text(t) for t in texts]
                rest = [batch.column(2 + i).slice(done, len(ids)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(ids)), *rest, pa.array(out, pa.string())], names=[id_col, *keep, "text"])
                done += len(ids)

    return used.mapInArrow(run, ", ".join(f"`{n}` {t.simpleString()}" for n, t in fields) + ", text string")
