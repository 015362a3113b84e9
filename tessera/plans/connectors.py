"""Sources and sinks: tables go out in a format and come back through its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sets
from tessera.plans.registry import both, query
from tessera.sources import files


@query("s1_jsonl", lambda e: "select krs, company_name, is_public from companies")
def s1(t):
    path = files.scratch(t.spark, "s1")
    files.write_lines(t["companies"].select("krs", "company_name", "is_public"), path)
    return files.read_jsonl(t.spark, path, "krs string, company_name string, is_public boolean")


@query("s2_csv", lambda e: "select o_orderkey, o_orderpriority, o_totalprice from orders")
def s2(t):
    path = files.scratch(t.spark, "s2")
    t["orders"].select("o_orderkey", "o_orderpriority", "o_totalprice").write.option("sep", ";").option("header", True).csv(path)
    return files.read_csv(t.spark, path, "o_orderkey long, o_orderpriority string, o_totalprice double", sep=";")


@query("s3_tsv_positions", lambda e: "select code4 as code, lower(place_name) as city from place_codes where place % 3 <> 0")
def s3(t):
    path = files.scratch(t.spark, "s3")
    line = F.concat_ws("\t", F.lit("PL"), F.when(F.col("place") % 3 != 0, F.col("code4")).otherwise(F.lit("")), "place_name", F.lit("x"))
    t["place_codes"].select(line.alias("value")).write.text(path)
    return files.read_positions(t.spark, path, {1: "code", 2: "city"}).select("code", F.lower("city").alias("city"))


both("s4_parquet", lambda e: "select p_partkey, p_brand from part where p_size > 25")


@query("s5_spreadsheet_headers", lambda e: "select * from (values ('1', 'a', 'x'), ('2', 'b', null)) as v(\"Person name\", \"Person name_1\", \"Votes name\")")
def s5(t):
    return files.sheet(t.spark, [["Person", None, "Votes"], ["name", "name", None], [1, "a", "x"], [2, "b", None]], 2).select(F.col("Person name"), F.col("Person name_1"), F.col("Votes name"))


def _archive(t, name, make):
    """One archive of each region's name, written through Spark and read back as blobs."""
    path = files.scratch(t.spark, name)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"name": pdf["r_name"], "content": [make(n) for n in pdf["r_name"]]})

    t["region"].select("r_name").mapInPandas(run, "name string, content binary").write.parquet(path)
    return t.spark.read.parquet(path)


def _zip(name):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("other.txt", "x")
        z.writestr("data.csv", f"{name};1")
    return out.getvalue()


def _tar(name):
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo(f"{name}.json")
        info.size = len(name)
        t.addfile(info, io.BytesIO(name.encode()))
    return out.getvalue()


@query("s6_zip_member", lambda e: "select r_name || '!data.csv' as name, r_name || ';1' as content from region")
def s6(t):
    return files.unzip(_archive(t, "s6", _zip), "data.csv").select("name", F.col("content").cast("string").alias("content"))


@query("s7_xml_pages", lambda e: "select n_nationkey as id, n_name as title from nation")
def s7(t):
    path = files.scratch(t.spark, "s7")
    pages = F.concat(F.lit("<page><id>"), F.col("n_nationkey").cast("string"), F.lit("</id><title>"), "n_name", F.lit("</title></page>"))
    t["nation"].coalesce(1).agg(F.concat(F.lit("<dump>"), F.array_join(F.collect_list(pages), ""), F.lit("</dump>")).alias("value")).write.text(path)
    return files.read_xml(t.spark, path, "page", "id int, title string")


@query("s8_json_blobs", lambda e: "select n_nationkey as k, n_name as name from nation")
def s8(t):
    path = files.scratch(t.spark, "s8")
    t["nation"].select(F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))).alias("value")).write.text(path)
    lines = files.read_blobs(t.spark, path, "*.txt").select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("j")).where("j <> ''")
    return lines.select(F.from_json("j", "k int, name string").alias("r")).select("r.k", "r.name")


@query("s9_listing", lambda e: "select true as listed")
def s9(t):
    path = files.scratch(t.spark, "s9")
    t["nation"].write.parquet(path)
    return files.list_files(t.spark, path, "*.parquet").agg((F.sum("length") > 0).alias("listed"))


@query("s10_tar_mirror", lambda e: "select r_name || '.json' as name, r_name as content from region")
def s10(t):
    return files.untar(files.mirror(_archive(t, "s10", _tar))).select("name", F.col("content").cast("string").alias("content"))


@query("s11_newest_export", lambda e: "select event_id from (select event_id, user_id % 3 as stamp, cast(ts as date) as d, max(user_id % 3) over (partition by cast(ts as date)) as top from events) x where stamp = top")
def s11(t):
    df = t["events"].select("event_id", F.to_date("ts").alias("d"), (F.col("user_id") % 3).alias("stamp"))
    return files.newest_export(df, "d", "stamp").select("event_id")


@query("s12_database_dump", lambda e: "select cast(r_regionkey as varchar) as id, case when r_regionkey = 2 then null else r_name || chr(9) || 'x' end as name from region")
def s12(t):
    path = files.scratch(t.spark, "s12")
    line = F.concat(F.col("r_regionkey").cast("string"), F.lit("\t"), F.when(F.col("r_regionkey") == 2, F.lit("\\N")).otherwise(F.concat("r_name", F.lit("\\tx"))))
    dump = t["region"].agg(F.concat(F.lit("-- dump\nCOPY public.areas (id, name) FROM stdin;\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n\\.\n")).alias("value"))
    dump.write.text(path)
    rows = files.read_copy(files.read_blobs(t.spark, path, "*.txt")).where("table = 'public.areas'")
    return rows.select(F.col("row")["id"].alias("id"), F.col("row")["name"].alias("name"))


@query("s13_paged_urls", lambda e: "select page_id, url, cast(floor((row_number() over (order by page_id) - 1) / 500) as bigint) as page from pages")
def s13(t):
    rows = sets.numbered(t["pages"].select("page_id", "url"), "page_id", "at")
    return rows.select("page_id", "url", F.floor((F.col("at") - 1) / 500).alias("page"))


both("s14_document_query", lambda e: "select id, name from nodes where kind in ('person', 'place') and published and score > 0 order by score desc, id limit 25")
both("s15_literal_table", lambda e: "select r.name, count(*) as n from (values ('01', 'one'), ('02', 'two'), ('03', 'three')) as r(code, name) join place_codes p on p.code2 = r.code group by r.name")
both("s16_registry_table", lambda e: "select g.activity, g.label, count(*) as n from (values ('84.11', 'office'), ('36.00', 'water'), ('35.14', 'energy')) as g(activity, label) join companies c on c.activity = g.activity group by g.activity, g.label")


@query("k1_jsonl_sorted", lambda e: "select c_custkey, c_acctbal from customer")
def k1(t):
    path = files.scratch(t.spark, "k1")
    files.write_lines(t["customer"].select("c_custkey", "c_acctbal"), path, sort="c_acctbal")
    return t.spark.read.schema("c_custkey long, c_acctbal double").json(path)


@query("k2_csv_writer", lambda e: "select s_suppkey, s_name from supplier")
def k2(t):
    path = files.scratch(t.spark, "k2")
    files.write_csv(t["supplier"].select("s_suppkey", "s_name"), path)
    return files.read_csv(t.spark, path, "s_suppkey long, s_name string")


@query("k3_append", lambda e: "select n_nationkey from nation union all select n_nationkey from nation")
def k3(t):
    path = files.scratch(t.spark, "k3")
    for _ in range(2):
        t["nation"].select("n_nationkey").write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


@query("k4_atomic_promotion", lambda e: "select s_suppkey from supplier where s_suppkey % 2 = 1")
def k4(t):
    path = files.scratch(t.spark, "k4")
    for i in (0, 1):
        files.promote(t.spark, t["supplier"].select("s_suppkey").where(f"s_suppkey % 2 = {i}"), path)
    return t.spark.read.parquet(path)


@query("k5_changed_only", lambda e: "select n_nationkey from nation where n_nationkey % 5 = 0")
def k5(t):
    n = t["nation"]
    stored = files.changed_only(n, t.spark.createDataFrame([], "n_nationkey int, sha256 string"), "n_nationkey").select("n_nationkey", "sha256")
    new = n.withColumn("n_name", F.when(F.col("n_nationkey") % 5 == 0, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name")))
    return files.changed_only(new, stored, "n_nationkey").select("n_nationkey")


@query("k7_partition_archive", lambda e: "select host, day, count(*) as n from (select user_id % 5 as host, cast(ts as date) as day from events) x where day < date '2024-01-20' and not (host = 1 and day < date '2024-01-10') group by host, day")
def k7(t):
    df = t["events"].select((F.col("user_id") % 5).alias("host"), F.to_date("ts").alias("day"), "event_id")
    done = df.where("host = 1 and day < date '2024-01-10'").select("host", "day").distinct()
    path = files.scratch(t.spark, "k7")
    files.archive_new(df, done, "host", "day", "2024-01-20").repartition("host", "day").write.partitionBy("host", "day").parquet(path)
    return t.spark.read.schema("event_id long, host long, day date").parquet(path).groupBy("host", "day").agg(F.count("*").alias("n"))


@query("k8_batched_writes", lambda e: "select true as within, count(*) as rows from customer")
def k8(t):
    sizes = files.chunked(t["customer"], 400, "c_custkey").groupBy("chunk").agg(F.count("*").alias("n"))
    return sizes.agg((F.max("n") <= 400).alias("within"), F.sum("n").alias("rows"))
