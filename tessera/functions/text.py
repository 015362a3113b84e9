"""Text functions: columns where built-ins can say it, vectorised UDFs where they can't."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLISH = ("ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "acelnoszzACELNOSZZ")


def plain(text: str | None) -> str | None:
    """Lower case without marks (NFKD); l for l with stroke."""
    if text is None:
        return None
    kept = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return kept.lower().replace("ł", "l")


@F.pandas_udf(T.StringType())
def normalize_text(s: pd.Series) -> pd.Series:
    return s.map(plain)


def without_polish_marks(c: Column) -> Column:
    return F.translate(c, *POLISH)


def jaro(a: str, b: str) -> float:
    """Share of characters that match within half the longer length, and of these that stand in the same order."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    hits = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                hits.append(ch)
                break
    if not hits:
        return 0.0
    others = [ch for ch, f in zip(b, free) if not f]
    moved = sum(x != y for x, y in zip(hits, others)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def winkler(a: str | None, b: str | None) -> float | None:
    """Jaro similarity raised for up to four equal first characters where it is above 0.7."""
    if a is None or b is None:
        return None
    s = jaro(a, b)
    if s <= 0.7:
        return s
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return s + 0.1 * same * (1 - s)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict = {}
    return pd.Series([seen[p] if p in seen else seen.setdefault(p, winkler(*p)) for p in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters of matching blocks over the characters of both."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("op", "old", "new")])))
def sequence_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    def edits(x: str, y: str) -> list[dict]:
        return [{"op": k, "old": x[i:j], "new": y[m:n]} for k, i, j, m, n in difflib.SequenceMatcher(None, x, y).get_opcodes() if k != "equal"]

    return pd.Series([edits(x or "", y or "") for x, y in zip(a, b)])


def prefixes_of_words(c: Column, most: int = 20) -> Column:
    """The beginnings of all words of a name, lower-cased and distinct: an index for search by prefix."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 0)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.least(F.length(w), F.lit(most))), lambda n: F.substring(w, F.lit(1), n))))))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(without_polish_marks(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def shortened(c: Column, most: int = 160) -> Column:
    """Cut at the last space before the limit, with an ellipsis."""
    head = F.regexp_replace(F.substring(c, 1, most), r"\s+\S*$", "")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(head, F.lit("…")))


#: Nominal endings in the order in which they are tried, words of organisations that tell nothing, short
#: labels of parties with what texts call them, and (short name, part of a committee's name) of parties.
ENDINGS = "owymi owego owej owym owych owie owemu ami ach om iem em u ie ej ego e i y a".split()
COMMON_ORG_WORDS = (
    "spolka spolki spolce spolke spolk spółka spółki spółk z ograniczona odpowiedzialnoscia odpowiedzialnosci odpowiedzialnosc spzoo sa s zaklad zaklady fundacja fundacji centrum sp akcyjna"
    " polska polskie polski polskiej krajowa krajowy powiatowa powiatowy miejskie miejskiego miejski miejskiej miejsca"
).split()
PARTY_LABELS = {
    "pis": ("pis", "prawo i sprawiedliwosc"),
    "po": ("koalicja obywatelska",),
    "psl": ("psl", "polskie stronnictwo ludowe"),
    "polska 2050": ("polska 2050", "pl2050"),
    "nowa lewica": ("nowa lewica",),
    "konfederacja": ("konfederacja",),
}
PARTY_NAMES = (
    ("pis", "prawo i sprawiedliwosc"),
    ("psl", "polskie stronnictwo ludowe"),
    ("sld", "sojusz lewicy demokratycznej"),
    ("koalicja obywatelska", "koalicja obywatelska"),
    ("konfederacja", "konfederacja"),
    ("nowoczesna", "nowoczesna"),
    ("trzecia droga", "trzecia droga"),
    ("polska 2050", "polska 2050"),
    ("pl2050", "pl2050"),
    ("samoobrona", "samoobrona"),
    ("liga polskich rodzin", "ligi polskich rodzin"),
    ("zjednoczona prawica", "zjednoczona prawica"),
    ("akcja wyborcza solidarnosc", "akcja wyborcza solidarnosc"),
    ("unia wolnosci", "unia wolnosci"),
)


def _literals(values) -> Column:
    return F.array(*map(F.lit, values))


def stem(word: Column) -> Column:
    """A word without its ending: the first of ENDINGS that leaves four letters or more; words as normalize_text() gives them."""
    ending = F.get(F.filter(_literals(ENDINGS), lambda e: F.endswith(word, e) & (F.length(word) - F.length(e) >= 4)), F.lit(0))
    return F.substring(word, F.lit(1), F.length(word) - F.coalesce(F.length(ending), F.lit(0)))


def org_terms(name: Column) -> Column:
    """The stems of five letters or more by which a text mentions an organisation, sorted; none of COMMON_ORG_WORDS.

    Names as normalize_text() gives them; a null name has none."""
    words = F.transform(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: F.struct(w.alias("word"), stem(w).alias("stem")))
    told = F.filter(words, lambda x: ~x["word"].isin(COMMON_ORG_WORDS) & ~x["stem"].isin(COMMON_ORG_WORDS) & (F.length(x["stem"]) >= 5))
    return F.array_sort(F.array_distinct(F.transform(told, lambda x: x["stem"])))


def party_terms(label: Column) -> Column:
    """What a text calls the party of a label or of a committee's name, sorted; none for other and null labels.

    Labels as normalize_text() gives them."""
    named = F.array_compact(F.array(*(F.when(F.contains(label, F.lit(part)), F.lit(t)) for short, part in PARTY_NAMES for t in (short, part))))
    out = F.when(F.lit(False), named)
    for short, terms in PARTY_LABELS.items():
        out = out.when(label == short, _literals(terms))
    return F.array_sort(F.array_distinct(out.otherwise(named)))


def without_thoughts(c: Column) -> Column:
    """A model's answer without its think blocks and code fences."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?(</think>|$)", ""), r"(?m)^```\w*\s*$", ""))


def first_object(c: Column) -> Column:
    """The text from the first brace to the last; null if there is none."""
    found = F.regexp_extract(without_thoughts(c), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def context(c: Column, needle: Column, around: int = 40) -> Column:
    at = F.instr(c, needle)
    return F.when(at > 0, F.substring(c, F.greatest(at - around, F.lit(1)), F.length(needle) + 2 * around))


_space = re.compile(r"\s+")


def locate(quote: str | None, text: str | None, least: float = 0.85) -> tuple[int, int, float] | None:
    """Where a quote stands in a text, word for word or nearly so; parts joined by an ellipsis may be apart."""
    if not quote or not text:
        return None
    parts = [p for p in (_space.sub(" ", x).strip() for x in re.split(r"\[?(?:\.\.\.|…)\]?", quote)) if p]
    flat = _space.sub(" ", text)
    at, first, score = 0, None, 1.0
    for p in parts:
        i = flat.find(p, at)
        if i < 0:
            m = difflib.SequenceMatcher(None, flat[at:], p, autojunk=False)
            blocks = [b for b in m.get_matching_blocks() if b.size > 2]
            if not blocks:
                return None
            hit = sum(b.size for b in blocks) / len(p)
            if hit < least:
                return None
            i, end, score = at + blocks[0].a, at + blocks[-1].a + blocks[-1].size, min(score, hit)
        else:
            end = i + len(p)
        first = i if first is None else first
        at = end
    return None if first is None else (first, at, score)


@F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("score", T.DoubleType())]))
def verbatim_span(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows = [locate(q, t) or (None, None, None) for q, t in zip(quote, text)]
    return pd.DataFrame(rows, columns=["start", "stop", "score"]).astype({"start": "Int32", "stop": "Int32", "score": "float64"})
