"""Shared helpers: lineage cuts in the cluster's shared folder, table readers, Arrow mapping, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd constant; XOR with it hides a column's hash partitioning from the planner, so that a join on it gets an
#: exchange on both sides, which adaptive execution can split when a key is hot.
DETACH = 0x5DEECE66D


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only where the session names none and runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = f"file://{tempfile.gettempdir()}/checkpoints/tessera"
    return named.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut of the lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def released() -> None:
    """Give free memory back to the system: workers outlive their tasks, and those of all stages share a machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out
        released()

    return df.mapInArrow(run, schema)


def free_prefix(columns: Iterable[str]) -> str:
    """A beginning that no column's name has, for columns of an operator's own."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def detached(col) -> F.Column:
    return F.col(col).bitwiseXOR(F.lit(DETACH).cast("long")) if isinstance(col, str) else col.bitwiseXOR(F.lit(DETACH).cast("long"))


#: Bits of the filter of ids that flagged() broadcasts, whatever the input (16 MB).
ID_BITS = 1 << 27
#: Bits of one row of it: what Spark's bitmaps hold.
BITMAP = 1 << 15


def flagged(df: DataFrame, key: str, ids: DataFrame, id_col: str, flag: str) -> DataFrame:
    """df with the column flag: false where key is surely none of ids, true where it may be.

    One bit for each id in a filter of a fixed size, so that rows which need no join aren't shuffled for it; with more
    ids than it can tell apart more rows are flagged, and all are in the end."""
    spot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(ID_BITS))
    own = free_prefix([*df.columns, flag])
    at, row, bits = f"{own}at", f"{own}row", f"{own}bits"
    marks = ids.select(spot(id_col).alias(at)).groupBy(F.floor(F.col(at) / BITMAP).alias(row)).agg(F.bitmap_construct_agg((F.col(at) % BITMAP).cast("long")).alias(bits))
    held = df.withColumn(at, spot(key)).join(F.broadcast(marks.withColumnRenamed(row, f"{row}_")), F.floor(F.col(at) / BITMAP) == F.col(f"{row}_"), "left")
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.col(at) % BITMAP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return held.withColumn(flag, F.coalesce(F.call_function("getbit", byte.cast("long"), (F.col(at) % 8).cast("int")) == 1, F.lit(False))).drop(at, bits, f"{row}_")


def _minima(pairs: DataFrame) -> DataFrame:
    """pairs(u, v) with m, the smallest of u and its neighbours v.  Hot u's are pre-aggregated, then split by the join."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select(detached("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.withColumn("k", detached("u")).join(low, "k").select("u", "v", "m")


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected graph of long ids; root is the smallest id of its component.

    Alternating large-star and small-star rounds, each cut to the shared folder.  Self links and repeats are ignored,
    nulls are dropped; an empty edge table gives an empty result.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    pairs = cut(pairs, "links")
    before = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minima(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Each pair is now (larger, smaller): the smaller neighbours of u are its v's.
        low = _minima(large)
        small = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        pairs = cut(small, "stars")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
