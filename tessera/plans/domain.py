"""The register domain mapped onto the star-schema tables: people, posts, candidacies, places, articles, graph."""

from __future__ import annotations

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

CODE2 = "lpad(cast(n_regionkey as string), 2, '0')"
CODE4 = f"{CODE2} || lpad(cast(n_nationkey as string), 2, '0')"

#: Name -> SQL.  A view may use those before it.
VIEWS = {
    # places with hierarchical codes: two digits for a region, four for a nation
    "place_codes": lambda e: f"select n_nationkey as place, n_name as place_name, {CODE2} as code2, {CODE4} as code4 from nation",
    "region_nodes": lambda e: f"""select code2 as id, 'region' as kind, cast(null as string) as parent from (select distinct code2 from place_codes) r
        union all select code4, 'county', code2 from place_codes
        union all select p.code4 || lpad(cast(s_suppkey as string), 3, '0'), 'commune', p.code4 from supplier join place_codes p on s_nationkey = p.place""",
    # people in the company register
    "register_people": lambda e: """select c_custkey as id, 'First' || cast(c_custkey % 37 as string) as first_name, 'Last' || cast(c_custkey % 211 as string) as last_name,
        case when c_custkey % 4 = 0 then null when c_custkey % 7 = 0 then '' else 'Mid' || cast(c_custkey % 5 as string) end as second_name,
        cast(1940 + c_custkey % 50 as int) as birth_year,
        case when c_custkey % 9 = 0 then cast(1940 + c_custkey % 50 as string) || '-00-00' else cast(1940 + c_custkey % 50 as string) || '-0' || cast(1 + c_custkey % 9 as string) || '-1' || cast(c_custkey % 10 as string) end as birth_date,
        c_nationkey as place from customer""",
    # candidates: some with another year of birth, some without a middle name
    "candidates": lambda e: """select o_orderkey as cand, o_custkey as person, 'First' || cast(o_custkey % 37 as string) as first_name, 'Last' || cast(o_custkey % 211 as string) as last_name,
        case when o_orderkey % 3 = 0 then null else 'Mid' || cast(o_custkey % 5 as string) end as second_name,
        case when o_orderkey % 11 = 0 then null else cast(1940 + o_custkey % 50 + (o_orderkey % 3) - 1 as int) end as birth_year,
        cast(year(o_orderdate) as int) as election_year, o_orderpriority as committee, case o_orderstatus when 'O' then 'local' when 'F' then 'national' else 'regional' end as election_type,
        p.code2 as code2, p.code4 as code4, o_totalprice as votes
        from orders join customer on o_custkey = c_custkey join place_codes p on c_nationkey = p.place""",
    # contests a candidate stood in, some known only down to the region
    "contests": lambda e: "select person, election_year, election_type, case when cand % 4 = 0 then code2 when cand % 9 = 0 then '99' || code2 else code4 end as code from candidates",
    # encyclopedia people
    "wiki_people": lambda e: """select p_partkey as id, 'First' || cast(p_partkey % 37 as string) || ' Last' || cast(p_partkey % 211 as string) || case when p_partkey % 5 = 0 then ' (politician)' else '' end as full_name,
        cast(1940 + p_partkey % 50 as int) as birth_year,
        case when p_partkey % 3 = 0 then cast(1940 + p_partkey % 50 as string) || '-00-00' else cast(1940 + p_partkey % 50 as string) || '-0' || cast(1 + p_partkey % 9 as string) || '-1' || cast(p_partkey % 10 as string) end as birth_iso,
        p_type as infobox, p_size as content_score, p_retailprice as price from part""",
    # posts: a person at a company from its first to its last delivery; open where that is late
    "posts": lambda e: """select o_custkey as person, l_suppkey as company, cast(min(l_shipdate) as date) as start_date,
        case when max(l_shipdate) >= timestamp '2001-06-01 00:00:00' then null else cast(max(l_shipdate) as date) end as end_date, count(*) as n_lines
        from orders join lineitem on o_orderkey = l_orderkey group by o_custkey, l_suppkey""",
    # companies with their place; every third is public
    "companies": lambda e: """select s_suppkey as company, s_name as company_name, lpad(cast(s_suppkey as string), 10, '0') as krs, lpad(cast(1000000000 + s_suppkey * 7919 as string), 10, '0') as nip,
        lpad(cast(100000000 + s_suppkey * 104729 as string), 9, '0') as regon, p.code2, p.code4, p.place_name as city, s_suppkey % 3 = 0 as is_public,
        case s_suppkey % 4 when 0 then '84.11' when 1 then '36.00' when 2 then '62.01' else '35.14' end as activity, s_acctbal as balance
        from supplier join place_codes p on s_nationkey = p.place""",
    # ownership among companies: number n belongs to n / 3; places own the roots
    "owners": lambda e: "select cast(floor(company / 3) as bigint) as parent, cast(company as bigint) as child from companies where company > 2",
    # votes: every tenth voter is a pipeline
    "votes": lambda e: "select event_id as vote, user_id as voter, event_id % 200 as node, event_type as category, value as amount, user_id % 10 = 0 as by_model, cast(ts as date) as day, ts from events",
    # nodes and edges of the graph
    "nodes": lambda e: """select 'p' || cast(c_custkey as string) as id, 'person' as kind, c_name as name, c_custkey % 5 <> 0 as published, c_custkey % 17 = 0 as deleted, c_mktsegment as party, c_acctbal as score from customer
        union all select 'c' || cast(s_suppkey as string), 'place', s_name, s_suppkey % 6 <> 0, false, cast(null as string), s_acctbal from supplier
        union all select 'r' || cast(n_nationkey as string), 'region', n_name, true, false, cast(null as string), cast(0 as double) from nation""",
    "edges": lambda e: """select 'e' || cast(person as string) || '_' || cast(company as string) as id, 'p' || cast(person as string) as source, 'c' || cast(company as string) as target, 'employed' as kind,
        start_date, end_date, (person + company) % 4 <> 0 as published, n_lines from posts
        union all select 'o' || cast(s_suppkey as string), 'r' || cast(s_nationkey as string), 'c' || cast(s_suppkey as string), 'owns', cast(null as date), cast(null as date), true, cast(1 as bigint) from supplier""",
    # snapshots of a user's state, and scrapes and updates by day
    "snapshots": lambda e: "select user_id as krs, cast(ts as date) as day, max(event_id) as number, count(*) as n_people, cast(sum(event_id % 2) as bigint) as state from events group by user_id, cast(ts as date)",
    "scrapes": lambda e: "select krs, day, case when number % 3 = 0 then 'api' else 'register' end as method, number from snapshots where krs % 2 = 0 or n_people > 2",
    "updates": lambda e: "select user_id as krs, cast(ts as date) as day, min(event_id) as change from events where event_type = 'purchase' group by user_id, cast(ts as date)",
    # articles
    "articles": lambda e: "select page_id as article, url, html, page_id % 4 as model_score from pages",
    "notes": lambda e: "select event_id as note, user_id, event_id % 300 as node, event_type as kind, case when event_id % 5 = 0 then null when event_id % 5 = 1 then 'done' else 'open' end as status, cast(floor(value) as bigint) % 4 as sources, event_id % 7 = 0 as deferred, ts from events",
    "revisions": lambda e: "select event_id as rev, event_id % 400 as node, user_id, value, event_type, event_id % 3 = 0 as approved, ts from events",
    "queue": lambda e: "select event_id as id, 'host' || cast(user_id % 25 as string) as host, user_id % 64 as bucket, cast(floor(value) as bigint) % 101 as priority, event_type = 'purchase' as done, cast(event_id % 4 as int) as retries, ts from events",
    # contracts: an order with its suppliers as parties
    "contracts": lambda e: "select o_orderkey as contract, o_totalprice as amount, cast(o_orderdate as date) as day, o_orderstatus as status from orders",
    "parties": lambda e: "select l_orderkey as contract, l_linenumber as seq, l_suppkey as supplier, lpad(cast(1000000000 + l_suppkey * 7919 as string), 10, '0') as nip, case when l_partkey % 6 = 0 then 'person' else 'firm' end as kind from lineitem",
}
