"""Joins and summaries in time.

As-of joins unite both sides and carry the last value along a window over the key: one shuffle, no pair of rows that
doesn't match, whatever the number of rows in a key's history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; ties by the order itself, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _carried(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, value: Sequence[str], ahead: bool, strict: bool) -> DataFrame:
    """left with struct _r of the nearest right row before (or after) it in time; at equal times it counts unless strict."""
    right_first = ahead == strict  # at equal times
    pack = F.struct(F.col(rt).alias("_t"), *value)
    a = left.select(F.col(key).alias("_k"), F.col(lt).alias("_t"), F.lit(int(right_first)).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(pack).schema[0].dataType).alias("_r"))
    b = right.select(F.col(key).alias("_k"), F.col(rt).alias("_t"), F.lit(int(not right_first)).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), pack.alias("_r"))
    w = Window.partitionBy("_k").orderBy("_t", "_side")
    near = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if ahead else F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return a.unionByName(b).withColumn("_r", near).where("_l is not null").select("_l.*", "_r")


def asof_backward(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, value: Sequence[str], strict: bool = False) -> DataFrame:
    """Each left row with _r, the last right row of its key at or before it (before it, if strict); null if none."""
    return _carried(left, right, key, lt, rt, value, ahead=False, strict=strict)


def asof_forward(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, value: Sequence[str], strict: bool = False) -> DataFrame:
    """Each left row with _r, the first right row of its key at or after it (after it, if strict); null if none."""
    return _carried(left, right, key, lt, rt, value, ahead=True, strict=strict)


def asof_nearest(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, value: Sequence[str]) -> DataFrame:
    """Each left row with _r, the right row of its key that is nearest in days; of two as near the earlier."""
    back = asof_backward(left, right, key, lt, rt, value).withColumnRenamed("_r", "_b")
    both = asof_forward(back, right, key, lt, rt, value).withColumnRenamed("_r", "_f")
    nearer = F.col("_b").isNotNull() & (F.col("_f").isNull() | (F.datediff(F.col(lt), F.col("_b._t")) <= F.datediff(F.col("_f._t"), F.col(lt))))
    return both.withColumn("_r", F.when(nearer, F.col("_b")).otherwise(F.col("_f"))).drop("_b", "_f")


def interval_has_event(intervals: DataFrame, events: DataFrame, key: str, start: str, end: str, day: str) -> DataFrame:
    """intervals with hit: some event of the key in (start, end], told by the last event at or before end."""
    found = asof_backward(intervals, events, key, end, day, [])
    return found.withColumn("hit", F.coalesce(F.col("_r._t") > F.col(start), F.lit(False))).drop("_r")


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals merged: keys, start, end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    marked = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def covered_days(intervals: DataFrame, days: DataFrame, start: str, end: str, day: str) -> DataFrame:
    """intervals with covered: every day from start to end is in days.

    Distinct days are counted up to each one in yearly parts, so that an interval needs two look-ups by the day, joins on
    equal keys, instead of a row for each of its days: the count up to its end less that before its start must be its
    length.  A day that isn't in days has no count, and its interval isn't covered."""
    known = days.select(F.col(day).alias("_d")).where("_d is not null").distinct().withColumn("_y", F.year("_d"))
    years = known.groupBy("_y").agg(F.count("*").alias("_n"))  # one row for each year
    before = years.select("_y", (F.sum("_n").over(Window.orderBy("_y")) - F.col("_n")).alias("_before"))
    upto = known.join(F.broadcast(before), "_y").select("_d", (F.col("_before") + F.row_number().over(Window.partitionBy("_y").orderBy("_d"))).alias("_upto"))
    lo, hi = (upto.select(F.col("_d").alias(f"_{s}"), F.col("_upto").alias(f"_{s}_upto")) for s in ("lo", "hi"))
    hit = intervals.join(lo, F.col(start) == F.col("_lo"), "left").join(hi, F.col(end) == F.col("_hi"), "left")
    whole = F.col("_hi_upto") - F.col("_lo_upto") == F.datediff(end, start)
    return hit.withColumn("covered", F.coalesce(whole, F.lit(False))).drop("_lo", "_lo_upto", "_hi", "_hi_upto")


def misses_in_a_row(df: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """(key, misses): rows since the last one that was ok, counted from the newest."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    ranked = df.withColumn("_rn", F.row_number().over(w))
    return ranked.groupBy(key).agg((F.coalesce(F.min(F.when(ok, F.col("_rn"))), F.count("*") + 1) - 1).cast("long").alias("misses"))


def bands(df: DataFrame, score: str, cuts: Sequence[float] = (0.99, 0.95, 0.85, 0.60)) -> DataFrame:
    """df with pct, the percentile rank with ties at their average, and band, 5 to 1.

    Ranks come from counts of distinct scores, so that the ordered window holds one row for each score."""
    counts = df.groupBy(score).agg(F.count("*").alias("_n"))
    w = Window.orderBy(score)
    below = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    pct = (below + (F.col("_n") + 1) / 2) / F.sum("_n").over(Window.partitionBy())
    ranked = counts.withColumn("pct", pct).drop("_n")
    band = F.lit(1)
    for i, c in enumerate(sorted(cuts), 2):
        band = F.when(F.col("pct") >= c, i).otherwise(band)
    return df.join(ranked, score).withColumn("band", band.cast("int"))
