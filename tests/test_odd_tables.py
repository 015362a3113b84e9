"""Queries against DuckDB on small tables with what the generated ones don't hold."""

import datetime

import duckdb

import __spark_entry__ as entry


def compare(spark, folder, name, **tables):
    """The query's rows and its SQL's, over tables of (schema, rows)."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = entry.queries()[name](spark, str(folder))
    cols = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(repr(tuple(row[names.index(c)] for c in cols)) for row in found.fetchall())
    return df, sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()), want


DAY = datetime.datetime(2024, 1, 1)


def test_first_of_each_bucket(spark, tmp_path):
    """Buckets and priorities that are null, and no order that a shuffle could lose."""
    rows = [(i, DAY, None if i % 7 == 0 else i % 5, None if i % 11 == 0 else ("purchase", "view")[i % 3 > 0], None if i % 4 == 0 else float(i * 37 % 300), "{}") for i in range(400)]
    df, got, want = compare(spark, tmp_path, "t3_topk_per_bucket", events=("event_id long, ts timestamp, user_id long, event_type string, value double, props string", rows))
    assert got == want and len(got) == 12
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "priority" in plan[plan.index("Window") :].split("\n")[0]


def graph(nation, published=True):
    """Orders, lines and suppliers; the second supplier is of this nation.  Published are sums of ids that 4 doesn't divide."""
    lines = [(o, 0, s, n, DAY) for o, s, n in [(0, 1, 1), (0, 1, 2), (0, 4, 1), (0, 4, 2), (1, 3, 1), (1, 3, 2), (1, 4, 1), (2, 4, 1), (2, 4, 2)] if published or (o, s) == (2, 4)]
    return {
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp", [(0, 4, DAY), (1, 5, DAY), (2, None, DAY)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp", lines),
        "supplier": ("s_suppkey long, s_name string, s_nationkey long, s_acctbal double", [(1, "a", 1, 0.0), (4, "b", nation, 0.0)] if published else []),
    }


def test_idempotent_insert(spark, tmp_path):
    """Published keys aren't gathered in one place; null keys as in SQL."""
    for case, (tables, n) in {"known": (graph(2), 2), "null": (graph(None), 0), "none": (graph(2, False), 1)}.items():
        df, got, want = compare(spark, tmp_path / case, "y5_idempotent_insert", **tables)
        assert got == want and len(got) == n
        assert "LeftAnti" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_addresses_of_one_normal_form(spark, tmp_path):
    """Facts go to the page's own address, not to another with the same normal form; odd addresses, negative ids."""
    urls = ["https://a.example/1", "https://a.example/1/", "https://www.a.example/1", "https://a.example/1", "http://b.example/?u=http://www.b.example", "http://b.example/http://www.x", "http://c.example/ ", "http://c.example", "", None]
    rows = [(i, urls[i % 10], "") for i in [*range(1, 60), -1, -2, -4]]
    _, got, want = compare(spark, tmp_path, "y6_facts_on_articles", pages=("page_id long, url string, html string", rows))
    assert got == want and len(got) == 60
