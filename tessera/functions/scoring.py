"""Scores of addresses and models, by name: a scorer is a function that makes a column of columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import ids, pages, text

SCORERS: dict[str, Callable[..., Column]] = {}


def scorer(name: str):
    """Register a scorer under a name; a name can be taken once."""

    def add(fn: Callable[..., Column]) -> Callable[..., Column]:
        if name in SCORERS:
            raise ValueError(f"{name} is taken")
        SCORERS[name] = fn
        return fn

    return add


class ScoreModel(Protocol):
    """What a trained scorer offers: fit on rows with a label, and a score for rows."""

    def fit(self, rows: DataFrame) -> ScoreModel: ...

    def score(self, rows: DataFrame) -> DataFrame: ...


#: Parts of addresses of lists and of sections that are off the subject, with what they cost.
LISTS = ("/tag/", "/tagi/", "/kategoria/", "/autor/", "/strona/", "/page/", "/feed", "/rss")
OFF_SUBJECT = ("/sport/", "/rozrywka/", "/pogoda/", "/moda/", "/kuchnia/", "/lifestyle/")
NO_PAGES = r"\.(pdf|jpg|jpeg|png|webp|gif)$"


def _any(c: Column, parts: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(c, F.lit(p))
    return found


@scorer("default")
def subject_score(url: Column, keywords: Sequence[str] = (), domains: Sequence[str] = ()) -> Column:
    """10 for a domain of interest, 1 for each keyword in the longest part of the path; lists, sections off the subject,
    privacy pages and files cost; never below 0."""
    s = pages.segments(url)
    longest = F.reduce(s, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    slug = text.without_polish_marks(F.lower(longest))
    path = F.lower(F.concat(F.lit("/"), F.array_join(s, "/")))
    hits = F.lit(0)
    for k in keywords:
        hits = hits + F.contains(slug, text.without_polish_marks(F.lit(k))).cast("int")
    score = hits + F.when(ids.host(url).isin(*domains), 10).otherwise(0) if domains else hits
    score = score - F.when(path.rlike("polityka.prywatnosci"), 10).otherwise(0) - F.when(_any(path, LISTS), 5).otherwise(0)
    score = score - F.when(_any(path, OFF_SUBJECT), 3).otherwise(0) - F.when(path.rlike(NO_PAGES), 10).otherwise(0)
    return F.greatest(score, F.lit(0))


@scorer("regional")
def regional_score(url: Column, keywords: Sequence[str] = (), places: Sequence[str] = ()) -> Column:
    """10 for each regional site or section that the address names, 1 for each keyword; files score 0."""
    low = F.lower(url)
    score = F.lit(0)
    for p in places:
        score = score + F.contains(low, F.lit(p)).cast("int") * 10
    for k in keywords:
        score = score + F.contains(low, F.lit(k)).cast("int")
    return F.when(low.rlike(NO_PAGES), 0).otherwise(score)
