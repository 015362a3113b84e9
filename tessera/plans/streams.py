"""Streaming queries, run over what the tables hold; windows are an extension beyond the register domain."""

from __future__ import annotations


from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources.files import scratch
from tessera.streaming import recompute


def _event_stream(t):
    path = scratch(t.spark, "stream")
    t["events"].repartition(2).write.parquet(path)
    return t.spark.readStream.schema(t["events"].schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("r1_recompute_on_change", lambda e: "select user_id, count(*) as n, round(sum(value), 4) as total from events group by user_id")
def r1(t):
    out, mark = scratch(t.spark, "r1"), scratch(t.spark, "r1-mark")
    every = t["events"]

    def again(keys):
        return every.join(keys, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))

    recompute.on_changes(_event_stream(t), "user_id", again, out, mark).awaitTermination()
    return recompute.current_rows(t.spark, out, "user_id")


@query("r2_token_bucket")
def r2(t):
    return recompute.token_bucket(t["events"], "user_id", "ts", 1 / 7200, 3.0, "event_id")


_QUEUE = """select id, host, priority, retries, case when done then 'done' when id % 3 = 0 then 'leased' else 'pending' end as state, case when not done and id % 3 = 0 then ts end as leased_at from queue"""


@query("r3_lease_retry", lambda e: f"""with q as ({_QUEUE}), late as (select *, state = 'leased' and leased_at < timestamp '2024-01-15 00:00:00' as expired from q),
    back as (select id, host, priority, case when expired and retries + 1 >= 3 then 'failed' when expired then 'pending' else state end as state, case when expired then retries + 1 else retries end as retries, case when not expired then leased_at end as leased_at from late),
    won as (select id from back where state = 'pending' order by priority, id limit 25)
    select id, case when id in (select id from won) then 'leased' else state end as state, retries, case when id in (select id from won) then timestamp '2024-01-20 00:00:00' else leased_at end as leased_at from back""")
def r3(t):
    return recompute.claim(t.sql(_QUEUE), "2024-01-20 00:00:00", "2024-01-15 00:00:00", 25).select("id", "state", "retries", "leased_at")


@query("r4_micro_batches", lambda e: "select count(*) as n, count(distinct event_id) as distinct_n from events")
def r4(t):
    rows = recompute.drained(t.spark, _event_stream(t).select("event_id"), scratch(t.spark, "r4"), scratch(t.spark, "r4-mark"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("distinct_n"))


@query("r5_incremental_reuse", lambda e: "select p_partkey, p_size % 3 = 0 and p_partkey % 5 <> 0 as reuse from part")
def r5(t):
    rows = t["part"].select("p_partkey", F.md5("p_name").alias("hash"), F.lit(2).alias("version"))
    cache = t["part"].select("p_partkey", F.md5("p_name").alias("hash"), F.when(F.col("p_size") % 3 == 0, 2).otherwise(1).alias("version"), F.when(F.col("p_partkey") % 5 == 0, "cut off").alias("error"))
    return recompute.reuse_split(rows, cache, "p_partkey", ["hash", "version"]).select("p_partkey", "reuse")


@query("r6_bounded_calls", lambda e: "select p_partkey, case when p_size > 40 then null else upper(p_name) end as answer from part")
def r6(t):
    def call(x):
        if x.endswith("!"):
            raise ValueError(x)
        return x.upper()

    asked = t["part"].select("p_partkey", F.when(F.col("p_size") > 40, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("q"))
    return recompute.bounded_calls(asked, call, "q", "answer").select("p_partkey", "answer")


@query("r7_daily_export", lambda e: "select cast(ts as date) as day, count(*) as rows, min(event_id) as first_id, max(event_id) as last_id from events group by cast(ts as date)")
def r7(t):
    """A folder for each day, as an export leaves them, read back."""
    path = scratch(t.spark, "r7")
    t["events"].select("event_id", F.to_date("ts").alias("day")).repartition("day").write.partitionBy("day").option("compression", "zstd").parquet(path)
    back = t.spark.read.schema("event_id long, day date").parquet(path)
    return back.groupBy("day").agg(F.count("*").alias("rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))



@query("x1_tumbling", lambda e: "select cast(floor(epoch(ts) / 3600) as bigint) as hour, event_type, count(*) as n from events group by 1, 2")
def x1(t):
    w = F.window("ts", "1 hour")
    agg = _event_stream(t).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "60 days").groupBy(w, "event_type").agg(F.count("*").alias("n"))
    mem = f"x1_{scratch(t.spark, 'q')[-8:]}"
    q = agg.writeStream.format("memory").queryName(mem).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.table(mem).select(F.floor(F.unix_timestamp("window.start") / 3600).alias("hour"), "event_type", "n")


@query("x2_sliding", lambda e: "select w as start, count(*) as n from (select unnest([cast(floor(epoch(ts) / 3600) as bigint), cast(floor(epoch(ts) / 3600) as bigint) - 1]) as w from events) x group by w")
def x2(t):
    w = F.window("ts", "2 hours", "1 hour")
    return t["events"].groupBy(w).agg(F.count("*").alias("n")).select(F.floor(F.unix_timestamp("window.start") / 3600).alias("start"), "n")


@query("x3_session", lambda e: "select user_id, count(*) as sessions, max(n) as longest from (select user_id, s, count(*) as n from (select user_id, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (select *, case when date_diff('microsecond', lag(ts) over (partition by user_id order by ts, event_id), ts) < 21600000000 then 0 else 1 end as fresh from events) a) b group by user_id, s) c group by user_id")
def x3(t):
    s = t["events"].groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
