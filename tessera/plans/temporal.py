"""Time, interval and ranking queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import sets, temporal
from tessera.plans.registry import both, query


@query("w8_latest_per_key", lambda e: "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) x where rn = 1")
def w8(t):
    return temporal.latest_per_key(t["events"], ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("j15_asof_nearest", lambda e: f"""select krs, day, near from (select s.krs, s.day, u.day as near, row_number() over (partition by s.krs, s.day order by abs({e.days('s.day', 'u.day')}), u.day) as rn from scrapes s left join updates u on s.krs = u.krs) x where rn = 1""")
def j15(t):
    return temporal.asof_nearest(t["scrapes"], t["updates"], "krs", "day", "day", []).select("krs", "day", F.col("_r._t").alias("near"))


@query("j16_asof_backward", lambda e: "select s.krs, s.day, max_by(u.change, u.day) as change from scrapes s left join updates u on s.krs = u.krs and u.day <= s.day group by s.krs, s.day")
def j16(t):
    return temporal.asof_backward(t["scrapes"], t["updates"], "krs", "day", "day", ["change"]).select("krs", "day", "_r.change")


@query("j17_last_change_before", lambda e: "select s.krs, s.day, max(u.day) as last_change from scrapes s left join updates u on s.krs = u.krs and u.day <= s.day group by s.krs, s.day")
def j17(t):
    return temporal.asof_backward(t["scrapes"], t["updates"], "krs", "day", "day", []).select("krs", "day", F.col("_r._t").alias("last_change"))


@query("j18_interval_exists", lambda e: f"select s.krs, s.day, count(u.day) > 0 as hit from scrapes s left join updates u on u.krs = s.krs and u.day > s.day and u.day <= {e.plus_days('s.day', '2')} group by s.krs, s.day")
def j18(t):
    spans = t["scrapes"].select("krs", "day", F.date_add("day", 2).alias("until"))
    return temporal.interval_has_event(spans, t["updates"], "krs", "day", "until", "day").select("krs", "day", "hit")


@query("j19_interval_coverage", lambda e: f"""with spans as (select krs, day as lo, {e.plus_days('day', '2')} as hi from scrapes), days as (select day from updates group by day having count(*) >= (select count(*) * 1.0 / count(distinct day) from updates))
    select krs, lo, count(d.day) = 3 as covered from spans left join days d on d.day between lo and hi group by krs, lo""")
def j19(t):
    spans = t["scrapes"].select("krs", F.col("day").alias("lo"), F.date_add("day", 2).alias("hi"))
    busy = t.sql("select day from updates group by day having count(*) >= (select count(*) * 1.0 / count(distinct day) from updates)")
    return temporal.covered_days(spans, busy, "lo", "hi", "day").select("krs", "lo", "covered")


both("j20_consecutive_pairs_with_update", lambda e: """select p.krs, p.day, p.next_day, min(u.day) as first_update, count(*) as n from (select krs, day, lead(day) over (partition by krs order by day) as next_day from scrapes) p
    join updates u on u.krs = p.krs and u.day > p.day and u.day <= p.next_day group by p.krs, p.day, p.next_day""")


@query("j21_forward_chain", lambda e: """with api as (select distinct krs, day from scrapes where method = 'api'), rej as (select distinct krs, day from scrapes where method = 'register'),
    one as (select a.krs, a.day as api1, min(r.day) as rej1 from api a join rej r on r.krs = a.krs and r.day >= a.day group by a.krs, a.day),
    two as (select o.krs, o.api1, o.rej1, min(a.day) as api2 from one o join api a on a.krs = o.krs and a.day > o.rej1 group by o.krs, o.api1, o.rej1),
    three as (select t.krs, t.api1, t.rej1, t.api2, min(r.day) as rej2 from two t join rej r on r.krs = t.krs and r.day >= t.api2 group by t.krs, t.api1, t.rej1, t.api2)
    select t.krs, t.api1, t.rej1, min(u.day) as changed, t.api2, t.rej2 from three t left join updates u on u.krs = t.krs and u.day > t.rej1 and u.day <= t.api2 group by t.krs, t.api1, t.rej1, t.api2, t.rej2""")
def j21(t):
    """Each api scrape with the register scrape that follows, the next api scrape and register scrape, and the first
    update between the inner two."""
    api, rej = (t["scrapes"].where(F.col("method") == m).select("krs", "day").distinct() for m in ("api", "register"))
    chain = api.withColumnRenamed("day", "api1")
    for at, of, step, strict in (("api1", rej, "rej1", False), ("rej1", api, "api2", True), ("api2", rej, "rej2", False)):
        chain = temporal.asof_forward(chain, of, "krs", at, "day", [], strict=strict).where("_r is not null").withColumn(step, F.col("_r._t")).drop("_r")
    near = temporal.asof_forward(chain, t["updates"].select("krs", "day"), "krs", "rej1", "day", [], strict=True)
    return near.withColumn("changed", F.when(F.col("_r._t") <= F.col("api2"), F.col("_r._t"))).select("krs", "api1", "rej1", "changed", "api2", "rej2")


@query("j9_symmetric_anti", lambda e: """select krs, day, 'left' as side from (select distinct krs, day from scrapes) s where not exists (select 1 from updates u where u.krs = s.krs and u.day = s.day)
    union all select krs, day, 'right' from updates u where not exists (select 1 from scrapes s where u.krs = s.krs and u.day = s.day)""")
def j9(t):
    return sets.symmetric_anti(t["scrapes"], t["updates"], ["krs", "day"])


@query("w5_merge_intervals", lambda e: """select person, min(start_date) as start_date, max(end_date) as end_date from (select *, sum(fresh) over (partition by person order by start_date, end_date, company rows unbounded preceding) as island from
    (select *, case when start_date <= max(end_date) over (partition by person order by start_date, end_date, company rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from posts where end_date is not null) x) y group by person, island""")
def w5(t):
    return temporal.islands(t["posts"].where("end_date is not null"), ["person"], "start_date", "end_date").select("person", "start_date", "end_date")


@query("a12_experience_years", lambda e: f"""select person, floor(sum({e.days('lo', 'hi')}) / 30.44 / 12 * 10) / 10 as experience_years from (select person, min(start_date) as lo, max(stop) as hi from
    (select *, sum(fresh) over (partition by person order by start_date, stop, company rows unbounded preceding) as island from (select *, case when start_date <= max(stop) over (partition by person order by start_date, stop, company rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh
    from (select *, coalesce(end_date, date '2001-12-31') as stop from posts) p) x) y group by person, island) z group by person""")
def a12(t):
    spans = t["posts"].withColumn("stop", F.coalesce("end_date", F.lit("2001-12-31").cast("date")))
    days = temporal.islands(spans, ["person"], "start_date", "stop").groupBy("person").agg(F.sum(F.datediff("stop", "start_date")).alias("d"))
    return days.select("person", (F.floor(F.col("d") / 30.44 / 12 * 10) / 10).alias("experience_years"))


@query("w9_percentile_bands", lambda e: """select id, band from (select id, case when pct >= 0.99 then 5 when pct >= 0.95 then 4 when pct >= 0.85 then 3 when pct >= 0.60 then 2 else 1 end as band from
    (select c_custkey as id, (rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0) / count(*) over () as pct from (select c_custkey, floor(c_acctbal / 50) as s from customer) x) y) z""")
def w9(t):
    return temporal.bands(t["customer"].withColumn("s", F.floor(F.col("c_acctbal") / 50)), "s").select(F.col("c_custkey").alias("id"), "band")


@query("w10_consecutive_misses", lambda e: """select krs, coalesce(min(case when n_people > 3 then rn end), count(*) + 1) - 1 as misses from (select krs, n_people, row_number() over (partition by krs order by day desc) as rn from snapshots) x group by krs""")
def w10(t):
    return temporal.misses_in_a_row(t["snapshots"], "krs", "day", F.col("n_people") > 3)


@query("t3_topk_per_bucket", lambda e: "select id, bucket from (select *, row_number() over (partition by bucket order by priority, id) as rn from queue where not done) x where rn <= 2")
def t3(t):
    # A lateral limit loses its order on the way to the buckets, and has no bucket without a number.
    ranked = t.sql("select id, bucket, row_number() over (partition by bucket order by priority nulls last, id nulls last) as rn from queue where not done")
    return ranked.where("rn <= 2").select("id", "bucket")


#: Customers with a year in which they ordered, as two snapshots hold them.
_SEEN = "select cast(o_custkey as string) || '-' || cast(year(o_orderdate) as string) as k, o_orderkey % 2 as half from orders"


@query("u5_snapshot_diff", lambda e: f"with s as ({_SEEN}) select k, 'deleted' as what from (select k from s where half = 0 except select k from s where half = 1) a union all select k, 'new' from (select k from s where half = 1 except select k from s where half = 0) b")
def u5(t):
    a, b = (t.sql(_SEEN).where(f"half = {i}").select("k") for i in (0, 1))
    return a.subtract(b).withColumn("what", F.lit("deleted")).union(b.subtract(a).withColumn("what", F.lit("new")))


_NEW = "select o_orderkey as k, o_custkey as who, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as status from orders where o_orderkey % 5 <> 1"
_OLD = "select o_orderkey as k, o_custkey as who, o_orderstatus as status from orders where o_orderkey % 5 <> 2"


def _reconciled(e):
    return f"select coalesce(a.k, b.k) as k, case when b.k is null then 'insert' when a.k is null then 'retract' else 'update' end as action from ({_NEW}) a full outer join ({_OLD}) b on a.k = b.k where a.k is null or b.k is null or a.status <> b.status"


@query("u6_reconcile", _reconciled)
def u6(t):
    return sets.reconcile(t.sql(_NEW), t.sql(_OLD), "k")


@query("k6_reconciling_sink", lambda e: f"select action, count(*) as n from ({_reconciled(e)}) r group by action")
def k6(t):
    return sets.reconcile(t.sql(_NEW), t.sql(_OLD), "k").groupBy("action").agg(F.count("*").alias("n"))


@query("u7_field_diff", lambda e: f"""with old as (select rev as r, node, event_type, user_id from revisions), d as (select a.r, {e.array("case when a.event_type <> b.event_type then 'event_type' end", "case when a.user_id <> b.user_id then 'user_id' end")} as xs from old a join old b on b.r = a.r + 400)
    select r, {e.text(e.filter('xs', 'x', 'x is not null'))} as changed from d""")
def u7(t):
    r = t["revisions"]
    as_map = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"))
    a = r.select(F.col("rev").alias("r"), as_map.alias("old"))
    b = r.select((F.col("rev") - 400).alias("r"), as_map.alias("new"))
    return sets.map_diff(a.join(b, "r"), "old", "new").select("r", F.array_join("changed", ",").alias("changed"))


@query("y1_occurrence_match", lambda e: """with i as (select vote, node, category, row_number() over (partition by node, category order by vote) as n from votes where vote % 2 = 0),
    s as (select vote as stored, node, category, row_number() over (partition by node, category order by vote) as n from votes where vote % 2 = 1) select i.vote, s.stored from i left join s on i.node = s.node and i.category = s.category and i.n = s.n""")
def y1(t):
    v = t["votes"].select("vote", "node", "category")
    return sets.occurrence_match(v.where("vote % 2 = 0"), v.where("vote % 2 = 1"), ["node", "category"], "vote", "vote").select("vote", "stored")


@query("w1_surrogate_key", lambda e: "select id, cast(row_number() over (order by last_name, first_name, id) as bigint) as rowid from register_people")
def w1(t):
    """Rows before a name are counted over distinct names; within a name rows are numbered apart."""
    names = ["last_name", "first_name"]
    counts = t["register_people"].groupBy(*names).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy(*names)) - F.col("n")).drop("n")
    number = F.row_number().over(Window.partitionBy(*names).orderBy("id"))
    return t["register_people"].withColumn("n", number).join(before, names).select("id", (F.col("before") + F.col("n")).cast("long").alias("rowid"))


@query("w12_round_robin", lambda e: "select id, host, cast(row_number() over (order by rn, host) as bigint) as pos from (select id, host, row_number() over (partition by host order by priority, id) as rn from queue where not done) x")
def w12(t):
    """The first of each host, then the second, and so on: rounds are counted, and hosts numbered within a round."""
    rows = t["queue"].where("not done").select("id", "host", F.row_number().over(Window.partitionBy("host").orderBy("priority", "id")).alias("rn"))
    rounds = rows.groupBy("rn").agg(F.count("*").alias("n"))
    before = rounds.select("rn", (F.sum("n").over(Window.orderBy("rn")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("rn").orderBy("host"))
    return rows.withColumn("n", place).join(before, "rn").select("id", "host", (F.col("before") + F.col("n")).cast("long").alias("pos"))
