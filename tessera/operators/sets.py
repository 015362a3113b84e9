"""Differences of tables: snapshots, reconciliation, fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def symmetric_anti(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side only, with the side: left or right."""
    left = a.select(*keys).distinct().join(b, list(keys), "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(b.select(*keys).distinct().join(a, list(keys), "left_anti").withColumn("side", F.lit("right")))


def reconcile(new: DataFrame, stored: DataFrame, key: str, partial: bool = False) -> DataFrame:
    """(key, action): write what is new or changed, retract what is stored only, unless the new side is partial."""
    row = lambda df, name: df.select(F.col(key), F.xxhash64(*[F.col(c) for c in sorted(df.columns) if c != key]).alias(name))
    both = row(new, "_new").join(row(stored, "_old"), key, "full_outer")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), F.lit(None if partial else "retract")).when(F.col("_new") != F.col("_old"), "update")
    return both.withColumn("action", action).where("action is not null").select(key, "action")


def map_diff(df: DataFrame, old: str, new: str) -> DataFrame:
    """df with added, removed and changed: sorted keys that differ between two maps."""
    keys = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    both = F.array_intersect(keys(old), keys(new))
    changed = F.filter(both, lambda k: ~F.element_at(F.col(old), k).eqNullSafe(F.element_at(F.col(new), k)))
    return (
        df.withColumn("added", F.array_sort(F.array_except(keys(new), keys(old))))
        .withColumn("removed", F.array_sort(F.array_except(keys(old), keys(new))))
        .withColumn("changed", F.array_sort(changed))
    )


def occurrence_match(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], order_in: str, order_st: str) -> DataFrame:
    """The n-th incoming row of an identity takes the n-th stored one; each stored row is claimed once."""
    a = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order_in)))
    b = stored.select(*keys, F.col(order_st).alias("stored")).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("stored")))
    return a.join(b, [*keys, "_n"], "left").drop("_n")


#: Ranges that ordered sums are dealt out over; their bounds are literals of the plan.
RANGES = 64


def _ranged(df: DataFrame, order: Column, own: str) -> DataFrame:
    """df with own, the number of the range that order falls in; bounds are percentiles, one number for each range."""
    at = [i / RANGES for i in range(1, RANGES)]
    bounds = sorted(set(df.agg(F.percentile_approx(order, F.array(*map(F.lit, at)), F.lit(1000)).alias("b")).first().b or []))
    if not bounds:
        return df.withColumn(own, F.lit(0))
    return df.withColumn(own, F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < order)), F.lit(0)))


def running_sum(df: DataFrame, order: str, value: str, name: str, ties: Sequence[str] = ()) -> DataFrame:
    """df with name, the sum of value over the rows up to each one by the number order (then ties).

    No window holds all rows: each range is summed in a task of its own, on top of the sums of the ranges before."""
    rows = _ranged(df, F.col(order), "_range")
    sums = rows.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    within = F.sum(value).over(Window.partitionBy("_range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + within).drop("_range", "_before")


def numbered(df: DataFrame, order: str, name: str, ties: Sequence[str] = ()) -> DataFrame:
    """df with name, each row's place from 1 by the number order (then ties), without a window over all rows."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name, ties).drop("_one")
