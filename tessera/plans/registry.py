"""Queries by name, with the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.dialect import DUCK, SPARK
from tessera.plans.domain import BASE, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _needed(text: str) -> list[str]:
    """The views that a text names, each after those it needs."""
    out: list[str] = []

    def visit(t: str) -> None:
        for name in VIEWS:
            if name not in out and re.search(rf"\b{name}\b", t):
                visit(VIEWS[name](DUCK))
                if name not in out:
                    out.append(name)

    visit(text)
    return out


class Tables:
    """The tables of a folder and the views over them; t["name"] is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(f"select * from {name}")

    def sql(self, text: str) -> DataFrame:
        views = _needed(text)
        whole = text + " ".join(VIEWS[v](SPARK) for v in views)
        for name in BASE:
            if re.search(rf"\b{name}\b", whole):
                self[name].createOrReplaceTempView(name)
        for name in views:
            self.spark.sql(VIEWS[name](SPARK)).createOrReplaceTempView(name)
        return self.spark.sql(text)


def oracle_text(text: str) -> str:
    views = _needed(text)
    if not views:
        return text
    head = ",\n".join(f"{v} as ({VIEWS[v](DUCK)})" for v in views)
    body = text.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {head},\n{body[14:]}"
    return f"with {head},\n{body[4:]}" if body.lower().startswith("with ") else f"with {head}\n{body}"


def both(name: str, text: Callable) -> None:
    """A query that is the same SQL in both engines, but for the dialect."""
    QUERIES[name] = lambda spark, sf_dir: Tables(spark, sf_dir).sql(text(SPARK))
    ORACLES[name] = oracle_text(text(DUCK))


def query(name: str, oracle: Callable | None = None):
    """A query that is a function of the tables; oracle gives the SQL that checks it."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle_text(oracle(DUCK))
        return fn

    return add
