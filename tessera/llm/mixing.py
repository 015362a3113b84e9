"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key divided by its quality weight; a source takes its documents whole as often as
its target holds them (complete epochs), then those of the smallest keys up to the rest of its budget.  The prefix
sums over keys run in two levels: sums of key ranges of a source first, then within each range, so that a source
with a third of all documents is dealt out over thousands of (source, range) groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_prefix

WORD = r"[^\x20\x09-\x0D]+"
#: Key ranges of a source; a range holds about this share of it.
RANGES = 4096


def words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A document's weight, 0.25 to 1: the share of code points that are no digits, marks or symbols of ASCII."""
    clean = F.length(F.translate(text, "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", ""))
    return F.coalesce(0.25 + 0.75 * clean / F.when(F.length(text) > 0, F.length(text)), F.lit(0.25))


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """sizes (source, source_size) with target: all sizes shared by weight, none above cap times its source's size.

    Sources in code point order, null last, take the weights in turn.  With r = cap * size / weight in rising order,
    the sources before the first whose r reaches the level of those left stop at their cap; the rest share by weight.
    One row for each source goes through one window; a null source stands last, no sources give no rows.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", w).withColumn("_cap", (cap * F.col("source_size")).cast("double")).withColumn("_r", F.col("_cap") / F.col("_w"))
    rising = Window.orderBy("_r", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("_level", (F.sum("source_size").over(everything) - before) / left)
    # Past the first source that the level reaches, levels only fall; where rounding leaves none, all are at their cap.
    level = F.coalesce(F.max(F.when(F.col("_level") <= F.col("_r"), F.col("_level"))).over(everything), F.max("_r").over(everything))
    return s.withColumn("_at", level).select("source", "source_size", F.least("_cap", F.col("_at") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, ranges: int = RANGES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target, epochs, taken and copies (input columns of these names are replaced).

    taken is size times the number of copies of the document in the mix (epochs, and one more for those that the rest
    of the budget takes); a document over the end of the budget is taken if that comes nearer to the target.  Null and
    empty texts have size 0 and take part; a null source is a source of its own.  Keys come from a hash of id and text:
    reruns agree, and rows that repeat in both tie, which changes nothing that can be told apart.  An empty table gives
    an empty result.
    """
    out = ("size", "source_size", "target", "epochs", "taken", "copies")
    docs = docs.drop(*(c for c in out if c not in (id_col, text_col, source_col)))
    own = free_prefix(docs.columns)
    key, range_, src, no_src, sum_, before, upto, copies = (f"{own}{x}" for x in ("key", "range", "src", "no_src", "sum", "before", "upto", "copies"))
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    d = docs.withColumn("size", words(F.col(text_col))).withColumn(key, -F.log(u) / quality(F.col(text_col)))
    d = d.withColumn(range_, F.least(F.lit(ranges - 1), F.floor(ranges * (1 - F.exp(-F.col(key)))).cast("int")))
    d = d.withColumn(src, F.coalesce(F.col(source_col), F.lit(""))).withColumn(no_src, F.col(source_col).isNull())

    sums = d.groupBy(src, no_src, range_).agg(F.sum("size").alias(sum_))
    sizes = sums.groupBy(src, no_src).agg(F.sum(sum_).alias("source_size"))
    sizes = sizes.withColumn("source", F.when(~F.col(no_src), F.col(src))).select("source", "source_size")
    aim = targets(sizes, weights, cap).select(
        F.coalesce("source", F.lit("")).alias(src),
        F.col("source").isNull().alias(no_src),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
    )
    in_source = Window.partitionBy(src, no_src).orderBy(range_)
    ahead = sums.withColumn(before, F.sum(sum_).over(in_source) - F.col(sum_)).drop(sum_)
    state = ahead.join(aim, [src, no_src])

    in_range = Window.partitionBy(src, no_src, range_).orderBy(key, F.col(id_col).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = d.join(state, [src, no_src, range_]).withColumn(upto, F.col(before) + F.sum("size").over(in_range))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    nearer = (F.col(upto) - rest < rest - (F.col(upto) - F.col("size"))) & (F.col("size") > 0)
    more = F.when((rest > 0) & ((F.col(upto) <= rest) | nearer), 1).otherwise(0)
    m = m.withColumn(copies, F.col("epochs") + more).withColumn("taken", (F.col("size") * F.col(copies)).cast("long"))
    return m.select(*docs.columns, "size", "source_size", "target", "epochs", "taken", F.col(copies).cast("int").alias("copies"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs (doc_id, text, source and any others), each as often as mix() takes it.

    Rows that repeat are taken one by one; an empty table gives an empty result."""
    whole = docs.select("doc_id", "text", "source", F.struct("*").alias("_row"))
    taken = mix(whole, **options).where("copies > 0")
    return taken.select("_row", F.explode(F.expr("sequence(1, copies)")).alias("_n")).select("_row.*")
