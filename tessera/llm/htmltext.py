"""Main text of web pages by tag-path ratios.

Text nodes are grouped by their root-to-leaf tag path.  A path's text length and punctuation, each over its number of
nodes, are smoothed along the page's order of paths and fused by their product; paths above a threshold hold the
content.  The element that holds most of their text is the article, and all of its blocks are kept but for what is
marked as something else (menus, adverts, forms, comments and the like).  Where no element is marked up as the article,
blocks on content paths beside that element are kept too.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches

#: Share of the chosen paths' text that the article's element must hold.
SHARE = 0.85
#: A path holds content from this many standard deviations above the mean of fused ratios, or this share of the best.
LIFT = 0.5
PART = 0.1

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del img ruby rt rp".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
NOT_TEXT = set("head script style title noscript template svg math iframe object embed canvas audio video select option button textarea datalist".split())
NOT_ARTICLE = set("nav header footer aside form dialog menu".split())
#: Words of classes and ids that mark something other than the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|banners?|sponsor(?:ed|s)?|promo(?:s|tion|tions)?|cookies?|gdpr|consent|notices?|newsletter|subscribe|signup|"
    r"comments?|commentlist|disqus|replies|sidebars?|sidenav|menus?|navbar|nav|navigation|breadcrumbs?|footers?|headers?|masthead|related|recommended|share|sharing|social|popup|modal|overlay|paywall|"
    r"widgets?|toolbar|pagination|pager|skip-link|login|search)(?:$|[\s_-])"
)
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Elements that a start tag of the first kind closes, up to the stops.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
STOPS = {"ul", "ol", "dl", "table", "select", "body", "html"}

_token = re.compile(r"<(?:!--(?:.*?)(?:-->|\Z)|![^>]*>|\?[^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_attr = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)
_punct = re.compile(r"[.,;:!?…。，！？、؟।]")


class Element(NamedTuple):
    tag: str
    parent: int
    mark: int  # 2 if it is surely no part of an article, 1 if its class or id says so
    text: bool  # its text is text at all
    depth: int


def _mark(tag: str, attrs: str) -> int:
    if tag in NOT_ARTICLE:
        return 2
    found = 0
    for name, a, b, c in _attr.findall(attrs) if attrs and tag not in ("html", "body") else ():
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and MARKS.search(value):
            found = 1
        if name == "role" and value.strip() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return 2
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
    return found


def others(elements: list[Element], by_class: bool = True) -> list[bool]:
    """For each element whether it or one around it is no part of an article.  A class or id doesn't count on an
    element that holds the article (a page's frame may be called "with-sidebar")."""
    holds = [e.tag in ("article", "main") for e in elements]
    for i in range(len(elements) - 1, 0, -1):
        if holds[i]:
            holds[elements[i].parent] = True
    out: list[bool] = []
    for i, e in enumerate(elements):
        out.append(e.parent >= 0 and out[e.parent] or e.mark == 2 or e.mark == 1 and by_class and not holds[i])
    return out


def parse(page: str) -> tuple[list[Element], list[tuple[int, int, str]]]:
    """The elements, and the text nodes as (block, element, text) in page order; a block ends at any element that
    isn't inline."""
    elements = [Element("", -1, 0, True, 0)]
    nodes: list[tuple[int, int, str]] = []
    stack = [0]
    block, at, n = 0, 0, len(page)

    def text(raw: str) -> None:
        if raw and elements[stack[-1]].text:
            nodes.append((block, stack[-1], entities.unescape(raw) if "&" in raw else raw))

    while at < n:
        m = _token.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            block += 1
        if close:
            for j in range(len(stack) - 1, 0, -1):
                if elements[stack[j]].tag == tag:
                    del stack[j:]
                    break
                if tag in INLINE and elements[stack[j]].tag not in INLINE:
                    break
            continue
        if tag in VOID:
            continue
        if tag not in INLINE and elements[stack[-1]].tag in INLINE | {"p"}:
            # A block ends an open paragraph, with the inline elements left open in it.
            for j in range(len(stack) - 1, 0, -1):
                if elements[stack[j]].tag == "p":
                    del stack[j:]
                    break
                if elements[stack[j]].tag not in INLINE:
                    break
        ends = CLOSED_BY.get(tag, ())
        for j in range(len(stack) - 1, 0, -1) if ends else ():
            if elements[stack[j]].tag in STOPS - set(ends):
                break
            if elements[stack[j]].tag in ends:
                del stack[j:]
                break
        up = elements[stack[-1]]
        elements.append(Element(tag, stack[-1], _mark(tag, attrs), up.text and tag not in NOT_TEXT, up.depth + 1))
        if attrs.rstrip().endswith("/") and tag in ("svg", "path", "circle", "rect", "use"):
            continue
        stack.append(len(elements) - 1)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else n
    return elements, nodes


def _path_ids(elements: list[Element], other: list[bool]) -> tuple[list[int], list[tuple[int, str]]]:
    """Each element's path as a number, and the (number before, step) that a number stands for."""
    known: dict[tuple[int, str], int] = {}
    steps: list[tuple[int, str]] = []
    ids: list[int] = []
    for e, o in zip(elements, other):
        step = (ids[e.parent] if e.parent >= 0 else -1, e.tag + "!" * o)
        if step not in known:
            known[step] = len(steps)
            steps.append(step)
        ids.append(known[step])
    return ids, steps


def _ratios(nodes: list[tuple[int, int, str]], ids: list[int]) -> dict[int, tuple[int, int, int, float]]:
    """path: (nodes, text length, punctuation, fused ratio), in order of first use."""
    found: dict[int, list[int]] = {}
    for _, e, raw in nodes:
        if size := len(raw.strip()):
            row = found.setdefault(ids[e], [0, 0, 0])
            row[0] += 1
            row[1] += size
            row[2] += len(_punct.findall(raw))
    if not found:
        return {}
    counts = np.array(list(found.values()), float)
    ratios = counts[:, 1:] / counts[:, :1]
    if len(ratios) > 2:
        kernel = np.array([0.25, 1.0, 0.25])
        norm = np.convolve(np.ones(len(ratios)), kernel, "same")
        ratios = np.stack([np.convolve(r, kernel, "same") / norm for r in ratios.T], 1)
    fused = ratios[:, 0] * (1 + ratios[:, 1])
    return {p: (*c, float(f)) for (p, c), f in zip(found.items(), fused)}


def path_ratios(elements: list[Element], nodes: list[tuple[int, int, str]]) -> list[tuple[str, int, int, int, float]]:
    """(path, nodes, text length, punctuation, fused ratio) of each tag path with text, in order of first use; a step
    ends in ! where it is marked as something other than the article."""
    ids, steps = _path_ids(elements, others(elements))
    out = []
    for p, row in _ratios(nodes, ids).items():
        names = []
        while p >= 0:
            names.append(steps[p][1])
            p = steps[p][0]
        out.append(("/".join(reversed(names)), *row))
    return out


def blocks(page: str | None) -> list[str]:
    """The blocks of the page's main text, in order."""
    elements, nodes = parse(page or "")
    for by_class in (True, False):  # where classes leave nothing, they are not taken at their word
        other = others(elements, by_class)
        ids, _ = _path_ids(elements, other)
        rows = _ratios([x for x in nodes if not other[x[1]]], ids)
        if rows:
            break
    else:
        return []
    nodes = [x for x in nodes if not other[x[1]]]
    fused = np.array([r[3] for r in rows.values()])
    best = float(fused.max())
    level = max(PART * best, 0.5 * min(float(fused.mean() + LIFT * fused.std()), best))
    content = {p for p, r in rows.items() if r[3] >= level}
    held = [0] * len(elements)
    for _, e, raw in nodes:
        if ids[e] in content:
            held[e] += len(raw.strip())
    for e in range(len(elements) - 1, 0, -1):  # parents come first
        held[elements[e].parent] += held[e]
    root = max((e for e in range(len(elements)) if held[e] >= SHARE * held[0]), key=lambda e: elements[e].depth)
    # An element marked up as the article, or else the main part, holds its heading and short blocks as well.
    beside: set[int] = set()
    up, x = {}, root
    while x > 0:
        up.setdefault(elements[x].tag, x)
        x = elements[x].parent
    if "article" in up or "main" in up:
        root = up.get("article", up.get("main"))
    else:
        while elements[root].tag in INLINE | {"p"}:
            root = elements[root].parent
        # A guessed element may be one large part of the article: an introduction before a long list isn't in the list.
        beside = {block for block, e, raw in nodes if ids[e] in content and raw.strip()}
    within = [False] * len(elements)
    within[root] = True
    for e in range(root + 1, len(elements)):
        within[e] = within[elements[e].parent]
    out: list[str] = []
    last = -1
    for block, e, raw in nodes:
        if within[e] or block in beside:
            if block != last:
                out.append("")
                last = block
            out[-1] += raw
    return [t for t in (" ".join(b.split()) for b in out) if t]


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", n_col: str = "n_chars") -> DataFrame:
    """pages with text_col, the main text with blocks joined by a space, and n_col, its code points (long).

    Columns of these names are replaced, all others pass through.  A null or empty page, or one without text, gives an
    empty text.  Repeated rows stay; an empty table gives an empty result.
    """
    names = [c for c in pages.columns if c not in (text_col, n_col)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [" ".join(blocks(t.as_py())) for t in batch.column(html_col)]
        return pa.record_batch([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*names, text_col, n_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in names)
    return map_batches(pages.select(*names), run, f"{schema}, `{text_col}` string, `{n_col}` long").select(*names, F.col(text_col), F.col(n_col))
