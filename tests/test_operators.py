"""Operators on hand-made rows, and the plans that scans are expected to get."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import ids, text
from tessera.operators import graph, sets, temporal
from tessera.plans.dag import Dag
from tessera.plans.registry import Tables
from tessera.sources import files

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(n)


@pytest.fixture(scope="module")
def visits(spark):
    return spark.createDataFrame([("a", day(5)), ("a", day(10)), ("b", day(1))], "k string, at date")


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([("a", day(5), 1), ("a", day(12), 2), ("a", day(8), 3), ("c", day(1), 4)], "k string, on date, v int")


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_as_of(visits, facts):
    v = F.col("_r.v")
    assert rows(temporal.asof_backward(visits, facts, "k", "at", "on", ["v"]), "k", "at", v) == [("a", day(10), 3), ("a", day(5), 1), ("b", day(1), None)]
    assert rows(temporal.asof_backward(visits, facts, "k", "at", "on", ["v"], strict=True), "k", "at", v) == [("a", day(10), 3), ("a", day(5), None), ("b", day(1), None)]
    assert rows(temporal.asof_forward(visits, facts, "k", "at", "on", ["v"]), "k", "at", v) == [("a", day(10), 2), ("a", day(5), 1), ("b", day(1), None)]
    assert rows(temporal.asof_forward(visits, facts, "k", "at", "on", ["v"], strict=True), "k", "at", v) == [("a", day(10), 2), ("a", day(5), 3), ("b", day(1), None)]
    # Two days before and two after: the earlier one.
    assert rows(temporal.asof_nearest(visits, facts, "k", "at", "on", ["v"]), "k", "at", v) == [("a", day(10), 3), ("a", day(5), 1), ("b", day(1), None)]


def test_touching_intervals_merge(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 2, 3), (1, 11, 12), (2, 1, 1)], "k int, lo int, hi int")
    assert rows(temporal.islands(df, ["k"], "lo", "hi"), "k", "lo", "hi") == [(1, 0, 9), (1, 11, 12), (2, 1, 1)]


def test_covered_days_and_misses(spark):
    spans = spark.createDataFrame([(day(1), day(3)), (day(2), day(2)), (day(3), day(5))], "lo date, hi date")
    days = spark.createDataFrame([(day(i),) for i in (1, 2, 3, 5, 2)], "d date")
    assert rows(temporal.covered_days(spans, days, "lo", "hi", "d"), "lo", "covered") == [(day(1), True), (day(2), True), (day(3), False)]
    runs = spark.createDataFrame([("x", 1, True), ("x", 2, False), ("x", 3, False), ("y", 1, False), ("z", 2, True)], "k string, n int, ok boolean")
    assert rows(temporal.misses_in_a_row(runs, "k", "n", F.col("ok")), "k", "misses") == [("x", 2), ("y", 1), ("z", 0)]


def test_bands(spark):
    one = spark.createDataFrame([(5.0,)], "s double")
    assert rows(temporal.bands(one, "s"), "band") == [(5,)]
    many = spark.createDataFrame([(float(i),) for i in range(100)] + [(1e9,)], "s double")
    got = temporal.bands(many, "s").groupBy("band").count()
    assert dict(map(tuple, got.collect())) == {5: 2, 4: 4, 3: 10, 2: 25, 1: 60}


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "parent int, child int")
    assert rows(graph.closure(e), "parent", "child") == sorted([(a, b) for a in (1, 2, 3) for b in (1, 2, 3)] + [(4, 5)], key=repr)
    seeds = spark.createDataFrame([(1,)], "id int")
    assert rows(graph.reach(seeds, e, "parent", "child"), "id", "depth") == [(1, 0), (2, 1), (3, 2)]


def test_dead_ends_stop_the_search(spark):
    e = spark.createDataFrame([("r", "c", "owns"), ("c", "p", "employed"), ("p", "c2", "employed"), ("r", "p", "topic")], "source string, target string, kind string")
    start = spark.createDataFrame([("r",)], "id string")
    got = graph.typed_reach(start, e, {"owns": True, "employed": False})
    assert rows(got, "id") == [("c",), ("p",), ("r",)]


def test_pagerank_agrees_with_a_dense_matrix(spark):
    import numpy as np

    pairs = [(0, 1, 1.0), (1, 2, 0.25), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0), (0, 4, 0.25)]
    edges = spark.createDataFrame(pairs, "source int, target int, weight double")
    seeds = spark.createDataFrame([("g", 0, 1.0), ("g", 3, 1.0), ("h", 1, 2.0)], "grp string, id int, weight double")
    got = {(r.grp, r.id): r.score for r in graph.pagerank(edges, seeds, tol=1e-12, max_rounds=60).collect()}
    m = np.zeros((5, 5))
    for a, b, w in pairs:
        m[a, b] += w
    out = m.sum(1)
    for grp, s in (("g", np.array([0.5, 0, 0, 0.5, 0])), ("h", np.array([0, 1.0, 0, 0, 0]))):
        x = s.copy()
        for _ in range(300):
            move = sum(x[i] * m[i] / out[i] for i in range(5) if out[i])
            x = 0.85 * (move + x[out == 0].sum() * s) + 0.15 * s
        for i in range(5):
            assert abs(got.get((grp, i), 0.0) - x[i]) < 1e-4


def test_differences(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "k int, v string")
    old = spark.createDataFrame([(2, "x"), (3, "c"), (4, None)], "k int, v string")
    assert rows(sets.reconcile(new, old, "k"), "k", "action") == [(1, "insert"), (2, "update"), (3, "retract")]
    assert rows(sets.reconcile(new, old, "k", partial=True), "k", "action") == [(1, "insert"), (2, "update")]
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None}), (None, {"z": "1"})], "o map<string,string>, n map<string,string>")
    assert rows(sets.map_diff(maps, "o", "n"), "added", "removed", "changed") == [(["c"], ["a"], ["b"]), (["z"], [], [])]


def test_text(spark):
    assert text.winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4) and text.winkler("", "a") == 0 and text.winkler("x", None) is None
    assert text.plain("Łódź ÀÉ") == "lodz ae"
    assert text.locate("one two [...] four", "zero one  two three four five") == (5, 23, 1.0)
    df = spark.createDataFrame([("<think>{}</think> ok {\"a\": {\"b\": 1}} end", "Zażółć gęślą!")], "s string, t string")
    assert rows(df, text.first_object(F.col("s")), text.slug(F.col("t"))) == [('{"a": {"b": 1}}', "zazolc-gesla")]


def test_ids(spark):
    df = spark.createDataFrame([("5260250274", "012100784", "3 maja 2020"), ("5260250275", "012100785", "03.05.2020"), ("x", None, "2020-05-03"), ("1", "1", "32.01.2020")], "nip string, regon string, d string")
    assert rows(df, ids.nip_ok(F.col("nip")), ids.parsed_date(F.col("d"))) == sorted([(True, dt.date(2020, 5, 3)), (False, dt.date(2020, 5, 3)), (False, dt.date(2020, 5, 3)), (False, None)], key=repr)
    urls = spark.createDataFrame([("WWW.Example.org/A/",), ("http://x.pl//",), ("https://www.a.b/c?d=1",)], "u string")
    assert rows(urls, ids.normal_url(F.col("u"))) == [("http://x.pl",), ("https://a.b/c?d=1",), ("https://example.org/A",)]


def test_copy_escapes_and_headers():
    assert files.copy_value("\\N") is None and files.copy_value("a\\tb\\\\c\\101\\x42") == "a\tb\\cAB"
    assert files.merged_headers([["A", None, "B"], ["x", "y", "y"], [None, None, "z"]]) == ["A x", "A y", "B y z"]


def test_mirror_takes_the_newest_whole_archive(spark):
    whole = spark.createDataFrame([("2024/total/1.tgz", b""), ("2024/total/2.tgz", b""), ("2024/delta/3.tgz", b"")], "name string, content binary")
    assert rows(files.mirror(whole), "name") == [("2024/total/2.tgz",)]
    assert files.mirror(whole.where("name like '%delta%'")).count() == 1


def test_dag_runs_only_what_it_must(spark, tmp_path):
    calls = []
    dag = Dag(spark, str(tmp_path))

    @dag.add("one")
    def one():
        calls.append("one")
        return spark.range(3)

    @dag.add("two", ("one",))
    def two(x):
        calls.append("two")
        return x.where("id > 0")

    assert dag.run("two")["two"].count() == 2 and calls == ["one", "two"]
    assert dag.plan("two") == {"one": "up to date", "two": "up to date"}
    dag.run("two")
    assert calls == ["one", "two"]
    assert dag.plan("two", refresh=frozenset({"one"})) == {"one": "asked", "two": "an input runs"}
    dag.add("two", ("two",))(two)
    with pytest.raises(ValueError):
        dag.order("two")


def test_filters_and_columns_reach_the_scan(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = t["lineitem"].where("l_quantity > 45").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_as_of_joins_shuffle_once(visits, facts):
    plan = temporal.asof_backward(visits, facts, "k", "at", "on", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


# --- pages, registers, scores


def test_page_tree_and_selectors():
    from tessera.functions import pages

    root = pages.tree('<body><p>a<p>b</p><ul><li>1<li class="x y">2</ul><div id=d data-k="v w"><b>in</b></div><br/>z &amp; q<script>no()</script>')
    assert root.text() == "a b 1 2 in z & q"
    assert pages.select(root, "li.y").text() == "2" and pages.select(root, "#d > b").text() == "in" and pages.select(root, "body b").text() == "in"
    assert pages.select(root, "ul > b") is None and pages.select(root, "nav, [data-k^=v]").attrs["id"] == "d" and pages.select(root, "[data-k=v]") is None
    assert pages.outline(root) == "body(p*2 ul(li li.x.y) div#d(b) br)"
    for html in (None, "", "<", "<a href", "</p></p>", "<b>" * 3000):
        pages.outline(pages.tree(html))
        assert pages.links(pages.tree(html), "https://x.example/") == []


def test_links_by_base_address():
    from tessera.functions import pages

    html = '<base href="https://www.Base.example/dir/"><a href=" x/?q ">1</a><a href="/y#f">2</a><a href="//Other.example/z/">3</a><a href="ftp://q/">4</a><a href="#x"><a href="http://[bad">'
    assert pages.links(pages.tree(html), "https://x.example/") == ["https://base.example/dir/x", "https://base.example/y", "https://other.example/z"]


def test_linked_data():
    from tessera.functions import pages

    doc = lambda *parts: pages.linked_items(pages.tree("".join(f'<script type="application/ld+json">{p}</script>' for p in parts)))
    items = doc('{"@type": "WebSite", "name": "Site"}', "{bad", '[{"@graph": [{"@type": ["X", "newsarticle"], "headline": "A  &quot;b&quot;"}, {"datePublished": "03.05.2024, 10:00"}]}]')
    assert len(items) == 4 and pages.title_of(items) == 'A "b"' and str(pages.date_of(items)) == "2024-05-03"
    assert pages.title_of(doc('{"x": 1}', '{"headline": "late"}')) == "late" and pages.title_of([]) is None and pages.date_of(doc('{"datePublished": "2024-13-01"}')) is None
    assert str(pages.day_of("7 maja 2023")) == "2023-05-07" and pages.day_of("x" * 200) is None


def test_content_ladder():
    from tessera.functions import pages

    long = "word " * 60
    page = f"<body><nav>{long * 3}</nav><article>short</article><main>{long}</main></body>"
    got = pages.read_page(page)
    assert got["method"] == "fallback:main" and got["content"] == long.strip() and got["status"] == "ok"
    assert pages.read_page(page, "article")["content"] == "short" and pages.read_page(page, "section")["method"] == "fallback:main"
    assert pages.read_page("<p>tiny</p>")["status"] == "empty_text" and pages.read_page(None)["content"] == ""


def test_majority_prefers_what_says_more(spark):
    from tessera.functions import pages

    votes = spark.createDataFrame([("a", "article")] * 3 + [("a", ".text"), ("a", " "), ("a", None), ("b", "article"), ("b", "x" * 200)], "k string, s string")
    assert rows(pages.majority(votes, "k", "s"), "k", "s", "votes") == [("a", ".text", 1), ("b", "article", 1)]


def test_register_people_and_unread_places():
    import json

    from tessera.functions import register

    p = lambda s, **more: {"nazwisko": {"nazwiskoICzlon": s}, "imiona": {"imie": "I"}, **more}
    body = {"dzial2": {"reprezentacja": [{"sklad": [p("A", funkcjaWOrganie="X"), p("A", funkcjaWOrganie="X"), {"nazwa": "firm"}]}], "prokurenci": p("B")}, "dzial9": {"new": [{"in": p("C")}]}}
    record = json.dumps({"odpis": {"dane": body}})
    assert [(x["surname"], x["role"]) for x in register.people_of(record)] == [("A", "reprezentacja: X"), ("B", "prokurent")]
    assert register.unread_paths(record) == ["dzial9.new[].in"]
    for other in (None, "", "[]", "{}", '{"odpis": []}', '{"odpis": {"dane": [1]}}', '{"odpis": {"dane": {"dzial2": [], "dzial1": {"wspolnicySpzoo": [1, null]}}}}', "[" * 100_000):
        assert register.people_of(other) == [] and register.unread_paths(other) == []
    assert len(register.PERSON_PATHS) == 17


def test_infobox():
    from tessera.functions import register

    kind, fields, linked = register.infobox("x {{Polityk infobox | a = [[L|shown]] and {{t|u=1}} | b=2|c}} rest | d = 4")
    assert (kind, fields, linked["a"]) == ("Polityk", {"a": "shown and {{t|u=1}}", "b": "2"}, ["L"])
    assert register.infobox("no box") is None and register.infobox(None) is None and register.infobox("{{X infobox | a = 1")[0] == "X"


def test_unique_probability(spark):
    one = lambda *x: spark.range(1).select(ids.unique_probability(*(F.lit(v).cast(k) for v, k in zip(x, ("double", "double", "boolean", "double"))))).first()[0]
    import math

    assert one(0.1, 0.5, True, 400) == pytest.approx((1 - 0.05) ** 10) and one(0.1, 0.5, False, 400) == pytest.approx(0.9**10)
    assert one(0.1, None, True, 4000) == pytest.approx(math.exp(-10)) and one(None, None, True, 40) == 0 and one(0.5, 0.5, True, None) == pytest.approx(math.exp(-1250 * 0.25))
    assert one(float("nan"), 0.5, True, 40) == pytest.approx(0.5)


def test_fact_lines(spark):
    from tessera.functions import register

    text_ = "Facts:\n- employment | person=A | organization=O | role='r'\n* employment | person=B | organization=Komitet Wyborczy\nparty_membership | person=C\n- x | person=D\npersonal_relation | subject=E | object=F=G"
    got = spark.createDataFrame([(text_,), (None,), ("",)], "a string").select(register.fact_lines(F.col("a")).alias("f")).collect()
    assert [dict(x) for x in got[0].f] == [{"fact_type": "employment", "person": "A", "organization": "O", "role": "r"}, {"fact_type": "personal_relation", "subject": "E", "object": "F=G"}]
    assert not got[1].f and not got[2].f


def test_scorers_have_one_name():
    from tessera.functions import scoring

    with pytest.raises(ValueError):
        scoring.scorer("default")(lambda c: c)


def test_numbered_and_running_sum(spark):
    df = spark.range(0, 3000, 3).selectExpr("(id * 7919) % 3001 as k", "id % 5 as v")
    want, total = [], 0
    for i, r in enumerate(sorted(df.collect()), 1):
        total += r.v
        want.append((r.k, i, total))
    got = sets.running_sum(sets.numbered(df, "k", "n"), "k", "v", "s")
    assert sorted((r.k, r.n, r.s) for r in got.collect()) == want
    assert sets.numbered(df.limit(0), "k", "n").collect() == []


def test_descendants_walk_only_from_the_starts(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (5, 6)], "parent long, child long")
    starts = spark.createDataFrame([(4,), (2,)], "parent long")
    assert rows(graph.descendants(starts, e), "parent", "child") == [(2, 1), (2, 2), (2, 3), (4, 5), (4, 6)]


def test_claim(spark):
    from tessera.streaming import recompute

    t0, t9 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9)
    q = spark.createDataFrame([(1, 5, "pending", 0, None), (2, 1, "leased", 2, t0), (3, 1, "leased", 0, t0), (4, 1, "leased", 0, t9), (5, 9, "pending", 0, None), (6, 0, "done", 0, None)], "id long, priority long, state string, retries int, leased_at timestamp")
    got = {r.id: (r.state, r.retries) for r in recompute.claim(q, "2024-01-10 00:00:00", "2024-01-05 00:00:00", 2).collect()}
    assert got == {1: ("leased", 0), 2: ("failed", 3), 3: ("leased", 1), 4: ("leased", 0), 5: ("pending", 0), 6: ("done", 0)}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        files.scratch(Session(), "x")


# --- queries that have no SQL, against plain Python


def test_queries_without_sql(spark):
    import difflib

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    q = entry.queries()
    part = {r.p_partkey: r for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_type").collect()}
    for r in q["f4_sequence_ratio"](spark, sf).collect():
        m = difflib.SequenceMatcher(None, part[r.p_partkey].p_name, part[r.p_partkey].p_type)
        assert r.ratio == pytest.approx(m.ratio(), abs=1e-6) and r.edits == sum(o[0] != "equal" for o in m.get_opcodes())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    import re

    for r in q["f19_entity_runs"](spark, sf).collect():
        assert r.entities == len(re.findall(r"[A-Z][a-z]+(?: [A-Z][a-z]+)+", docs[r.doc_id]))
    spans = q["f13_verbatim_span"](spark, sf).collect()
    assert len(spans) == sum(t is not None for t in docs.values())
    for r in spans:
        flat = re.sub(r"\s+", " ", docs[r.doc_id])
        if r.start is not None and r.score == 1:
            first = re.sub(r"\s+", " ", docs[r.doc_id][49:89]).strip()
            assert flat[r.start :].startswith(first[:10]) or not first
    people, cands = spark.read.parquet(f"{sf}/customer.parquet").collect(), spark.read.parquet(f"{sf}/orders.parquet").collect()
    place = {c.c_custkey: c.c_nationkey for c in people}
    pool: dict[tuple, dict[str, int]] = {}
    for o in cands:
        if o.o_custkey in place:
            names = pool.setdefault((place[o.o_custkey], o.o_custkey % 37), {})
            last = f"Last{o.o_custkey % 211}"
            names[last] = min(names.get(last, o.o_orderkey), o.o_orderkey)
    want = {}
    for c in people:
        own = f"Last{c.c_custkey % 211}"
        scored = [(-(2.0 if n == own else difflib.SequenceMatcher(None, own, n).ratio() + 0.1), k) for n, k in pool.get((c.c_nationkey, c.c_custkey % 37), {}).items()]
        if scored and min(scored)[0] <= -0.75:
            want[c.c_custkey] = (min(scored)[1], round(-min(scored)[0], 6))
    assert {r.id: (r.other, r.s) for r in q["j24_exact_then_fuzzy"](spark, sf).collect()} == want
    taken: dict[int, tuple[float, float]] = {}
    allowed = {}
    for r in sorted(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts").collect(), key=lambda r: (r.user_id, r.ts, r.event_id)):
        level, at = taken.get(r.user_id, (3.0, r.ts.timestamp()))
        level = min(3.0, level + (r.ts.timestamp() - at) / 7200)
        allowed[r.event_id] = level >= 1
        taken[r.user_id] = (level - 1 if level >= 1 else level, r.ts.timestamp())
    got = q["r2_token_bucket"](spark, sf).collect()
    flag = next(n for n in got[0].asDict() if isinstance(got[0][n], bool))
    assert {r.event_id: r[flag] for r in got} == allowed


def test_kinds_of_bodies(spark):
    from pyspark.sql import functions as F

    from tessera.functions.register import kind_of_body

    rows = [
        (["62.01", "73.11"], "Szpital", False, "events"),
        (["73.20", None], "Szpital", False, "health"),
        (["49.32"], None, None, "utilities"),
        (["49.41"], None, None, "sole"),
        ([], "Zielonogórskie Wodociągi i Kanalizacja Spółka z o.o.", True, "utilities"),
        (None, "Zakład Lecznictwa", None, "health"),
        (None, "NZOZ Zdrowie", None, "health"),
        (None, "Dworzec PKS", None, "utilities"),
        (None, "PKSy", None, "sole"),
        (None, "\u0141MPK", None, "sole"),
        (None, "Ochotnicza Straż Pożarna", True, "associations"),
        (None, "Klub Sportowy SA", None, "associations"),
        (None, "Hotel pod Lipą", None, "events"),
        (None, "Hotelik", None, "sole"),
        (None, "REM-BUD Jan", None, "construction"),
        (None, "Budka", None, "sole"),
        (None, "Kowalski i Nowak s. c.", None, "civil"),
        (None, "Spółka cywilna Lis", None, "civil"),
        (None, "Alfa sp. z o.o.", True, "private"),
        (None, "Alfa S.A.", None, "private"),
        (None, "Alfa S.A. w likwidacji", None, "sole"),
        (None, "Alfa sp. k.", None, "private"),
        (None, "Izba Rolnicza", None, "private"),
        (None, "Gmina Lipa", None, "budget"),
        (None, "Dawna Gmina Lipa", None, "sole"),
        (None, "Zespół Szkół", None, "budget"),
        (None, "Ośrodek Pomocy Społecznej", None, "budget"),
        (None, "Jan Kowalski", True, "budget"),
        (None, None, None, "sole"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, codes array<string>, name string, budget boolean, kind string")
    got = df.withColumn("got", kind_of_body(F.col("codes"), F.col("name"), F.col("budget"))).orderBy("i").collect()
    assert [(r.name, r.got) for r in got] == [(r.name, r.kind) for r in got]


def test_stems_and_terms(spark):
    from pyspark.sql import functions as F

    from tessera.functions.text import normalize_text, org_terms, party_terms, stem

    words = {"przedsiebiorstwa": "przedsiebiorstw", "wodociagami": "wodociag", "teatrowie": "teatr", "domu": "domu", "domow": "domow", "komunalnego": "komunaln", "kowalowie": "kowal", "": "", "nowego": "nowego", "mlynach": "mlyn", "lasach": "lasach"}
    df = spark.createDataFrame(list(words.items()), "w string, s string")
    assert {r.w: r.got for r in df.withColumn("got", stem(F.col("w"))).collect()} == words
    rows = [
        ("Przedsiębiorstwo Gospodarki  Komunalnej i Mieszkaniowej Sp. z o.o.", ["gospodark", "komunaln", "mieszkani", "przedsiebiorstwo"], "PiS", ["pis", "prawo i sprawiedliwosc"]),
        ("Spółka Akcyjna Miejskiego Centrum", [], "PO", ["koalicja obywatelska"]),
        ("", [], "Komitet Wyborczy PO", []),
        (None, [], None, []),
        ("Teatr Teatru", ["teatr"], "KW Polska 2050 i Konfederacja", ["konfederacja", "polska 2050"]),
    ]
    df = spark.createDataFrame([(i, r[0], r[2]) for i, r in enumerate(rows)], "i int, org string, party string")
    got = df.select("i", org_terms(normalize_text("org")).alias("o"), party_terms(normalize_text("party")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [r[3] for r in rows]
    assert [r.o for r in got] == [r[1] for r in rows]
