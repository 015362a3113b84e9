"""Streaming: re-aggregation of the keys that change, rate limits by key, and windows with watermarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def on_changes(stream: DataFrame, key: str, recompute: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Per micro-batch: recompute(keys) for the keys in it, written as a new version of their rows under path.

    A batch that is run again writes the same folder, so results are exact; current_rows() reads the newest version.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = recompute(batch.select(key).distinct()).withColumn("_batch", F.lit(number))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(spark: SparkSession, path: str, key: str) -> DataFrame:
    rows = spark.read.parquet(path).drop("batch")
    newest = rows.groupBy(key).agg(F.max("_batch").alias("_batch"))
    return rows.join(newest, [key, "_batch"]).drop("_batch")


def token_bucket(df: DataFrame, key: str, ts: str, rate: float, burst: float, order: str) -> DataFrame:
    """(key, order, allowed): requests that a bucket of `burst` tokens, filled at `rate` a second, lets pass.

    One group is one key's requests in order of time; their state is two numbers."""

    def run(k, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values([ts, order])
        level, last, out = burst, None, []
        for t in pdf[ts]:
            if last is not None:
                level = min(burst, level + (t - last).total_seconds() * rate)
            last = t
            ok = level >= 1
            level -= ok
            out.append(bool(ok))
        yield pd.DataFrame({key: pdf[key], order: pdf[order], "allowed": out})

    kinds = dict(df.dtypes)
    one = lambda k, pdf: next(run(k, iter([pdf])))
    return df.select(key, ts, order).groupBy(key).applyInPandas(one, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean")


def token_bucket_stream(stream: DataFrame, key: str, ts: str, rate: float, burst: float, order: str) -> DataFrame:
    """token_bucket() over a stream: level and time of the last request are kept for each key between batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = dict(stream.dtypes)

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (burst, None)
        pdf = pd.concat(list(batches)).sort_values([ts, order])
        out = []
        for t in pdf[ts]:
            now = t.timestamp()
            level = min(burst, level + (now - last) * rate) if last is not None else level
            last = now
            ok = level >= 1
            level -= ok
            out.append(bool(ok))
        state.update((float(level), float(last)))
        yield pd.DataFrame({key: pdf[key].values, order: pdf[order].values, "allowed": out})

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean"
    return stream.select(key, ts, order).groupBy(key).applyInPandasWithState(run, schema, "level double, last double", "append", GroupStateTimeout.NoTimeout)


def drained(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into files, and read them."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def reuse_split(rows: DataFrame, cache: DataFrame, key: str, versions: list[str]) -> DataFrame:
    """rows with reuse: the cache holds a good result for the same key and the same version columns."""
    good = cache.where("error is null").select(key, *[F.col(v).alias(f"_{v}") for v in versions]).distinct()
    same = F.lit(True)
    for v in versions:
        same = same & F.col(v).eqNullSafe(F.col(f"_{v}"))
    return rows.join(good, key, "left").withColumn("reuse", F.col(f"_{versions[0]}").isNotNull() & same).drop(*[f"_{v}" for v in versions])


def bounded_calls(df: DataFrame, call: Callable[[str], str], column: str, out: str, in_flight: int = 8) -> DataFrame:
    """df with out, a client's answer for each row; at most in_flight requests of a task are open; errors give null."""
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        def safe(x):
            try:
                return call(x)
            except Exception:
                return None

        with ThreadPoolExecutor(in_flight) as pool:
            for pdf in batches:
                yield pdf.assign(**{out: list(pool.map(safe, pdf[column]))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, `{out}` string").select(*names, out)


def claim(queue: DataFrame, now: str, expired_before: str, n: int, most: int = 3) -> DataFrame:
    """A queue (id, priority, state, retries, leased_at and others) after a worker's turn.

    Leases from before expired_before go back, at their retry number `most` they fail instead; then the n pending rows
    of the smallest (priority, id) are leased from now on.  The n are found by a top-n, without ordering the queue."""
    late = F.coalesce((F.col("state") == "leased") & (F.col("leased_at") < F.lit(expired_before).cast("timestamp")), F.lit(False))
    tried = F.col("retries") + F.when(late, 1).otherwise(0)
    back = queue.withColumns({"state": F.when(late & (tried >= most), "failed").when(late, "pending").otherwise(F.col("state")), "retries": tried.cast(queue.schema["retries"].dataType), "leased_at": F.when(~late, F.col("leased_at"))})
    won = back.where("state = 'pending'").orderBy("priority", "id").limit(n).select("id", F.lit(True).alias("_won"))
    out = back.join(F.broadcast(won), "id", "left")
    return out.withColumns({"state": F.when(F.col("_won"), "leased").otherwise(F.col("state")), "leased_at": F.when(F.col("_won"), F.lit(now).cast(queue.schema["leased_at"].dataType)).otherwise(F.col("leased_at"))}).drop("_won")
