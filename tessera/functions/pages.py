"""Web pages read whole, in Arrow batches: links, structured data, content by selector, outlines.

A page is parsed once into a small tree; everything else is a walk over it.  What needs no tree (address tests, scores,
votes) is in columns.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ids import MONTHS

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: What a page's content is looked for in where no selector is known, and the length that ends the search.
LADDER = ("article", "main", "[role=main]", "#content", ".content", "body")
ENOUGH = 200
#: Fixed values of the linked-data vocabulary.
ARTICLE_TYPES = {"article", "newsarticle"}
TITLE_KEYS = ("headline", "name", "title")
DATE_KEYS = ("datePublished", "dateCreated", "dateModified")


class Node:
    __slots__ = ("tag", "attrs", "up", "kids")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [k for k in reversed(node.kids) if isinstance(k, Node)]

    def strings(self, silent: bool = False) -> Iterator[str]:
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            elif silent or x.tag not in SILENT:
                todo += reversed(x.kids)

    def text(self) -> str:
        return " ".join(" ".join(s.split()) for s in self.strings() if s.strip())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag)
        if ends and self.at.tag in ends:
            self.at = self.at.up
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        self.at.kids.append(data)


def tree(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


# --- selectors

_step = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:#[\w-]+|\.[\w-]+|\[[^\]]+\])*)")
_test = re.compile(r"#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([\^*$]?)=\s*[\"']?([^\]\"']*)[\"']?)?\s*\]")


def _matcher(step: str) -> Callable[[Node], bool]:
    m = _step.fullmatch(step)
    if not m or not step:
        raise ValueError(f"bad selector {step!r}")
    tag, tests = m[1], _test.findall(m[2])

    def ok(n: Node) -> bool:
        if tag and tag != "*" and n.tag != tag.lower():
            return False
        for ident, cls, attr, how, value in tests:
            if ident and n.attrs.get("id") != ident or cls and cls not in n.attrs.get("class", "").split():
                return False
            if attr:
                own = n.attrs.get(attr)
                if own is None or value and not {"": own == value, "^": own.startswith(value), "$": own.endswith(value), "*": value in own}[how]:
                    return False
        return True

    return ok


def select(root: Node, selector: str) -> Node | None:
    """The first element in page order that one of the selector's comma-separated chains fits: steps of tag, #id, .class
    and [attribute] tests, joined by blanks (within) or > (child of)."""
    chains = []
    for part in selector.split(","):
        steps = re.sub(r"\s*>\s*", " >", part.strip()).split()
        chains.append([(s.startswith(">"), _matcher(s.lstrip(">"))) for s in steps])

    def fits(n: Node, chain: list, i: int) -> bool:
        child, ok = chain[i]
        if not ok(n):
            return False
        if i == 0:
            return True
        up = n.up
        while up is not None:
            if fits(up, chain, i - 1):
                return True
            if child:
                return False
            up = up.up
        return False

    for n in root.walk():
        if n.tag and any(chain and fits(n, chain, len(chain) - 1) for chain in chains):
            return n
    return None


# --- links


def normal_host(host: str) -> str:
    host = host.lower()
    return host[4:] if host.startswith("www.") else host


def links(root: Node, url: str) -> list[str]:
    """The page's links, absolute by its base address, without query, fragment and last slash; sorted and distinct."""
    base = next((n.attrs["href"] for n in root.walk() if n.tag == "base" and n.attrs.get("href")), url)
    found = set()
    for n in root.walk():
        href = n.attrs.get("href", "").strip() if n.tag == "a" else ""
        if not href or href.startswith(("#", "mailto:", "tel:", "javascript:", "data:")):
            continue
        try:
            full = urlsplit(urljoin(base, href).split("?")[0].split("#")[0].rstrip("/"))
        except ValueError:
            continue
        if full.scheme in ("http", "https") and full.hostname:
            found.add(f"{full.scheme}://{normal_host(full.hostname)}{full.path}")
    return sorted(found)


# --- structured data


def linked_items(root: Node) -> list[dict]:
    """The objects of the page's linked data in order: each block's own, those of lists, and those of a @graph."""
    out: list[dict] = []

    def add(x) -> None:
        if isinstance(x, list):
            for y in x:
                add(y)
        elif isinstance(x, dict):
            out.append(x)
            graph = x.get("@graph")
            out.extend(y for y in graph if isinstance(y, dict)) if isinstance(graph, list) else None

    for n in root.walk():
        if n.tag == "script" and n.attrs.get("type") == "application/ld+json":
            try:
                add(json.loads("".join(n.strings(silent=True))))
            except (ValueError, RecursionError):
                continue
    return out


def _is_article(item: dict) -> bool:
    kinds = item.get("@type")
    return any(isinstance(k, str) and k.lower() in ARTICLE_TYPES for k in (kinds if isinstance(kinds, list) else [kinds]))


def _named(item: dict, keys: Sequence[str]) -> Iterator[str]:
    return (v for k in keys if isinstance(v := item.get(k), str) and v.strip())


def picked(items: list[dict]) -> dict | None:
    """The item that speaks for the article: an article, else one with a title or date, else the first."""
    ranked = [*filter(_is_article, items), *(i for i in items if any(_named(i, TITLE_KEYS + DATE_KEYS))), *items]
    return ranked[0] if ranked else None


def title_of(items: list[dict]) -> str | None:
    """Of the item that is picked; else any item's headline (a bare name may be the publisher's)."""
    from html import unescape

    best = picked(items)
    for raw in [*_named(best or {}, TITLE_KEYS), *(h for i in items for h in _named(i, ("headline",)))]:
        return re.sub(r"\s{2,}", " ", unescape(raw)).strip()
    return None


def day_of(raw: str) -> datetime.date | None:
    """A date at the start of a text: ISO (with any time), dotted, or a day, a written month and a year."""
    raw = raw.strip()
    if not raw or len(raw) > 128:
        return None
    try:
        if m := re.match(r"(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)", raw):
            return datetime.date(int(m[1]), int(m[2]), int(m[3]))
        if m := re.match(r"(\d{1,2})\.(\d{1,2})\.(\d{4})", raw):
            return datetime.date(int(m[3]), int(m[2]), int(m[1]))
        if (m := re.match(r"(\d{1,2})\s+(\w+)\s+(\d{4})", raw)) and m[2].lower() in MONTHS:
            return datetime.date(int(m[3]), MONTHS.index(m[2].lower()) + 1, int(m[1]))
    except ValueError:
        return None
    return None


def date_of(items: list[dict]) -> datetime.date | None:
    """The first date of any item: the one that is picked needn't carry it."""
    return next((d for i in items for raw in _named(i, DATE_KEYS) if (d := day_of(raw))), None)


# --- pages


def read_page(html: str | None, selector: str | None = None, ladder: Sequence[str] = LADDER) -> dict:
    """title, day, content, selector, method and status of a page.

    A known selector comes first; if it finds nothing, the ladder's first with ENOUGH characters, or its longest."""
    root = tree(html)
    items = linked_items(root)
    out = {"title": title_of(items), "day": date_of(items), "content": "", "selector": None, "method": None}
    hit = select(root, selector) if selector else None
    if hit is not None:
        out |= {"content": hit.text(), "selector": selector, "method": "selector"}
    else:
        best: tuple[int, str, str] | None = None
        for s in ladder:
            if (n := select(root, s)) is not None:
                t = n.text()
                best = max(best, (len(t), s, t), key=lambda x: x[0]) if best else (len(t), s, t)
                if len(t) >= ENOUGH:
                    best = (len(t), s, t)
                    break
        if best:
            out |= {"content": best[2], "selector": best[1], "method": f"fallback:{best[1]}"}
    out["status"] = "ok" if out["content"] else "empty_text"
    return out


def outline(root: Node, depth: int = 8) -> str:
    """The page's body as nested tags with their classes; neighbours of one form are counted, numbers in classes dropped."""

    def form(n: Node) -> str:
        names = [c for c in n.attrs.get("class", "").split() if not any(ch.isdigit() for ch in c)][:3]
        return ".".join([n.tag, *names]) + (f"#{n.attrs['id']}" if n.attrs.get("id") else "")

    def of(n: Node, left: int) -> str:
        kids = [k for k in n.kids if isinstance(k, Node) and k.tag not in SILENT]
        if not kids or not left:
            return form(n)
        runs: list[list] = []
        for k in kids:
            if runs and runs[-1][0] == form(k):
                runs[-1][1] += 1
            else:
                runs.append([form(k), 1, k])
        return f"{form(n)}({' '.join(of(k, left - 1) + (f'*{c}' if c > 1 else '') for _, c, k in runs)})"

    return of(select(root, "body") or root, depth)


PAGE = "title string, day date, content string, selector string, method string, status string"


def _mapped(df: DataFrame, schema: str, fn: Callable[..., dict], *cols: str) -> DataFrame:
    """df's first column with what fn makes of the others, in Arrow batches; every page is read whole."""
    given, names = df.columns[0], [x.split()[0] for x in schema.split(", ")]
    kinds = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in kinds.fields]

    def run(batches):
        for b in batches:
            rows = [fn(*x) for x in zip(*(b.column(c).to_pylist() for c in cols))]
            yield pa.record_batch([b.column(given), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, types))], names=[given, *names])

    return df.mapInArrow(run, f"{given} {df.schema[given].dataType.simpleString()}, {schema}")


def read_pages(df: DataFrame, html: str = "html", selector: str | None = None) -> DataFrame:
    """df's first column with the fields of read_page().  selector names a column; null there: the ladder alone."""
    cols = [html, selector] if selector else [html]
    return _mapped(df, PAGE, read_page, *cols)


def page_links(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """df's first column with links, an array."""
    return _mapped(df, "links array<string>", lambda h, u: {"links": links(tree(h), u or "")}, html, url)


def outlines(df: DataFrame, html: str = "html") -> DataFrame:
    return _mapped(df, "outline string", lambda h: {"outline": outline(tree(h))}, html)


# --- addresses, in columns

#: Segments that lists and service pages have, and endings that are no pages.
LIST_SEGMENTS = ("tag", "tagi", "kategoria", "autor", "strona", "page", "feed", "rss", "search")
FILES = r"\.(pdf|jpe?g|png|webp|gif|zip|docx?)$"


def segments(url: Column) -> Column:
    path = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _hyphens(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("-"), F.lit("")))


def is_article_path(url: Column) -> Column:
    """Whether an address may be an article's: not a file, no list's segment; a single segment must be a long title or
    hold a number of five digits."""
    s = segments(url)
    last = F.element_at(s, -1)
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\d+[_-]", ""), r"\.[^.]*$", "")
    one = F.regexp_replace(last, r"\.[^.]*$", "")
    single = (F.length(one) > 15) & (_hyphens(one) >= 2) | one.rlike(r"\d{5,}")
    bad = F.lower(last).rlike(FILES) | F.exists(s, lambda x: F.lower(bare(x)).isin(*LIST_SEGMENTS))
    return F.when(F.size(s) == 0, F.lit(False)).when(bad, F.lit(False)).when(F.size(s) == 1, single).otherwise(F.lit(True))


def article_score(url: Column) -> Column:
    """How much an address looks like an article's: a long hyphenated title, long numbers, a dated folder, depth."""
    s = segments(url)
    path = F.concat(F.lit("/"), F.array_join(s, "/"))
    last = F.coalesce(F.get(s, F.size(s) - 1), F.lit(""))
    titled = F.when((F.length(last) > 25) & (_hyphens(last) >= 3), 3).when((F.length(last) > 12) & (_hyphens(last) >= 2), 2).otherwise(0)
    return titled + F.when(path.rlike(r"\d{5,}"), 2).otherwise(0) + F.when(path.rlike(r"/20\d{2}/\d{2}/"), 2).otherwise(0) + F.least(F.greatest(F.size(s) - 1, F.lit(0)), F.lit(2))


def majority(votes: DataFrame, key: str, selector: str, generic: Sequence[str] = ("body", "html", "div", "main", "article")) -> DataFrame:
    """(key, selector, votes): each key's most frequent selector, one that says more than a bare tag if there is any;
    ties by name.  Nulls, blanks and selectors of over 120 characters don't vote."""
    n = votes.where(F.trim(F.col(selector)) != "").where(F.length(selector) <= 120).groupBy(key, selector).agg(F.count("*").alias("votes"))
    order = Window.partitionBy(key).orderBy(F.col(selector).isin(*generic), F.desc("votes"), selector)
    return n.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
