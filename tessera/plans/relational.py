"""Projections, joins, aggregations, windows, sorting and set operations as portable SQL."""

from __future__ import annotations

from tessera.plans.registry import both

# --- projections and predicates

both("p1_register_person_normalise", lambda e: """select id, lower(first_name) as first_name, lower(last_name) as last_name, lower(coalesce(second_name, '')) as second_name,
    cast(substring(birth_date, 1, 4) as int) as birth_year from register_people where first_name is not null and last_name is not null and birth_date is not null""")
both("p2_encyclopedia_person_normalise", lambda e: f"""select id, lower(trim({e.rx_replace('full_name', '[(][^)]*[)]', '')})) as full_name,
    lower({e.rx_group('full_name', '^([^ ]+)', 1)}) as first_name, lower({e.rx_group(e.rx_replace('full_name', ' [(].*$', ''), '([^ ]+)$', 1)}) as last_name,
    case when birth_iso like '%-00' then null else birth_iso end as birth_date, case when infobox in ('ECONOMY', 'STANDARD') then true else false end as is_politician,
    round(atan(content_score), 9) as score from wiki_people""")
both("p3_candidate_normalise", lambda e: f"""select cand, lower(first_name) as first_name, lower(last_name) as last_name, substring(code4, 1, 2) as region, substring(code4, 1, 4) as county,
    {e.join(e.filter(e.array("case when cand % 2 = 0 then code2 end", "code4"), 'c', 'c is not null'), '|')} as codes from candidates""")
both("p4_site_person_distinct", lambda e: "select distinct lower(trim(last_name)) as last_name, lower(trim(first_name)) as first_name from register_people")
both("p5_middle_name_derived", lambda e: """select id, coalesce(second_name, trim(replace(replace(first_name || ' ' || 'Extra' || cast(id % 3 as string) || ' ' || last_name, first_name, ''), last_name, ''))) as middle from register_people""")
both("p6_select_except", lambda e: f"select {e.drop('committee', 'votes')} from candidates")
both("p7_employment_relevance", lambda e: """select person, count(*) filter (where is_public and start_date >= date '1998-01-01' and end_date is null) as relevant, count(*) as n_posts
    from posts p join companies c on p.company = c.company group by person""")
both("p8_election_relevance", lambda e: f"select person, count(*) filter (where {e.starts('code4', chr(39) + '01' + chr(39))} and cast(election_year as string) >= '1998') as relevant from candidates group by person")
both("p9_combined_relevance", lambda e: """select p.person, n_posts, n_elections, case when n_posts = 0 then null else round(cast(n_elections as double) / n_posts, 9) end as ratio,
    n_posts * n_elections + case when p.person % 10 = 0 then 1 else 0 end > 3 or p.person in (1, 2, 3) as relevant
    from (select person, count(*) as n_posts from posts group by person) p join (select person, count(*) as n_elections from candidates group by person) c on p.person = c.person""")
both("p10_boolean_parse", lambda e: """select event_id, case when lower(trim(v)) in ('true', '1', 'yes', 't', 'tak') then true when lower(trim(v)) in ('false', '0', 'no', 'f', 'nie', '') then false end as flag
    from (select event_id, case event_id % 6 when 0 then ' TRUE ' when 1 then '0' when 2 then 'Tak' when 3 then '' when 4 then 'maybe' else 'no' end as v from events) x""")
both("p11_structural_filter", lambda e: """select n.id, n.name from nodes n where n.kind = 'person' and (n.party in ('BUILDING', 'MACHINERY') or n.party is null)
    and n.id in (select source from edges where target in (select 'c' || cast(company as string) from companies where code2 = '01'))
    and n.id in (select source from edges where target in (select 'c' || cast(company as string) from companies where is_public))""")
both("p12_parties_overlap_or_empty", lambda e: f"""select id from (select id, case when score < 0 then {e.filter(e.array("'x'"), 'z', "z <> 'x'")} else {e.array("coalesce(party, 'none')", "kind")} end as parties from nodes) n
    where {e.size('parties')} = 0 or {e.overlap('parties', e.array("'BUILDING'", "'region'"))}""")
both("p13_target_overlap", lambda e: f"select contract from (select contract, {e.set('supplier')} as targets from parties group by contract) x where {e.overlap('targets', e.array('cast(1 as bigint)', 'cast(5 as bigint)', 'cast(9 as bigint)'))}")
both("p14_scalar_filters", lambda e: "select person, company from posts where end_date is null and start_date >= date '1999-01-01' and n_lines >= 1")
both("p15_visibility_gate", lambda e: "select id, kind from nodes where coalesce(published, false) and not coalesce(deleted, false)")
both("p16_hide_voted_three_way", lambda e: """select n.id, case when v.node is null then 'unvoted' when v.mine then 'mine' else 'others' end as voted
    from nodes n left join (select 'p' || cast(node as string) as node, bool_or(voter = 7) as mine from votes group by node) v on n.id = v.node where n.kind = 'person'""")
both("p17_notes_filter", lambda e: f"select note from notes where kind in ('click', 'view') and status is null and not deferred and ({e.contains('cast(node as string)', chr(39) + '1' + chr(39))} or {e.contains('kind', chr(39) + 'ck' + chr(39))})")
both("p18_extractions_by_article", lambda e: f"select node as article, {e.text(e.list('note'))} as notes, count(*) as n from notes where kind = 'view' and coalesce(status, '') <> 'done' group by node")
both("p19_output_reshape", lambda e: f"select cast(person as string) as person_id, krs, cast(start_date as string) as employed_start, coalesce(cast(end_date as string), '') as employed_end from posts p join companies c on p.company = c.company")
both("p20_nested_trim", lambda e: f"select event_id, s.a.b as b, s.c as c from (select event_id, {e.struct(a=e.struct(b='event_type', d='value'), c='user_id')} as s from events) x")
both("p21_projection_pushdown", lambda e: "select l_orderkey, l_quantity from lineitem where l_shipdate >= timestamp '2001-01-01 00:00:00' and l_quantity > 45")
both("p22_proposal_status", lambda e: """select rev, case when approved then 'approved' when event_type = 'error' then 'rejected' when value > 100 then 'pending' else 'draft' end as status from revisions""")
both("p23_places_by_ownership", lambda e: "select company, case when company in (select child from owners) then 'owned' when company in (select parent from owners) then 'owner' else 'unknown' end as ownership from companies")
both("p24_display_name", lambda e: f"""select company, case when upper(company_name) like '%7%' then {e.rx_replace('company_name', '#0*', ' ')} else company_name || ' (' || city || ')' end as display from companies""")
both("p25_null_stripping", lambda e: f"select id, {e.join(e.filter(e.array('first_name', 'second_name', 'last_name'), 'x', 'x is not null and x <> ' + chr(39) * 2), ' ')} as name from register_people")
both("p26_company_payload", lambda e: """select c.krs, coalesce(nullif(company_name, ''), 'company ' || c.krs) as name, case when is_public then code4 end as teryt from companies c where c.company in (select company from posts where end_date is null)""")
both("p27_region_payload", lambda e: """select id, case length(id) when 2 then 1 when 4 then 2 else 3 end as level, case length(id) when 2 then 'region ' || id when 4 then 'county ' || id else 'commune ' || id end as name,
    case when length(id) = 2 then null when length(id) = 4 then 'edge_' || substring(id, 1, 2) || '_' || id else 'edge_' || substring(id, 1, 4) || '_' || id end as parent_edge from region_nodes""")
both("p28_person_payload", lambda e: f"""select r.id, coalesce(nullif(trim(r.first_name), ''), 'unknown') as name, {e.join('x.krs', ',')} as companies from register_people r
    join (select person, {e.set('krs')} as krs from posts p join companies c on p.company = c.company group by person) x on x.person = r.id""")

# --- joins

both("j1_tolerant_person_match", lambda e: """select r.id, c.cand, case when coalesce(r.second_name, '') = '' or coalesce(c.second_name, '') = '' then 1 else 0 end as tier
    from register_people r join candidates c on r.first_name = c.first_name and r.last_name = c.last_name
    where (abs(r.birth_year - c.birth_year) <= 1 or c.birth_year is null) and (r.second_name = c.second_name or coalesce(r.second_name, '') = '' or coalesce(c.second_name, '') = '')""")
both("j2_left_using", lambda e: "select person, n, cand from (select person, count(*) as n from posts group by person) p left join (select person, max(cand) as cand from candidates where election_type = 'local' group by person) c using (person)")
both("j3_dimension_twice", lambda e: """with f as (select first_name as name, count(*) as n from register_people group by first_name union all select second_name, count(*) from register_people where second_name <> '' group by second_name)
    select r.id, a.n as first_n, b.n as second_n from register_people r left join f a on r.first_name = a.name left join f b on r.second_name = b.name""")
both("j4_composite_key_list_element", lambda e: f"""with w as (select person, {e.list('code2')} as codes, max(last_name) as last_name from candidates group by person),
    s as (select last_name, code2, count(*) as n from candidates group by last_name, code2)
    select w.person, s.n from w left join s on w.last_name = s.last_name and {e.at('w.codes', 1)} = s.code2""")
both("j7_full_outer_null_safe", lambda e: """with a as (select first_name, second_name, count(*) as n from register_people where id % 2 = 0 group by first_name, second_name),
    b as (select first_name, second_name, count(*) as m from register_people where id % 2 = 1 or id % 3 = 0 group by first_name, second_name)
    select coalesce(a.first_name, b.first_name) as first_name, coalesce(a.second_name, b.second_name) as second_name, a.n, b.m from a full outer join b on a.first_name = b.first_name and a.second_name is not distinct from b.second_name""")
both("j8_contradictory_candidacies", lambda e: f"""select distinct a.person from (select distinct person, election_year, election_type, code from contests) a join (select distinct person, election_year, election_type, code from contests) b
    on a.person = b.person and a.election_year = b.election_year and a.election_type = b.election_type where not {e.starts('a.code', 'b.code')} and not {e.starts('b.code', 'a.code')}""")
both("j10_inequality_after_equi", lambda e: """select s.krs, s.day as scraped, u.day as updated from (select krs, max(day) as day from scrapes group by krs) s
    join (select krs, max(day) as day from updates group by krs) u on s.krs = u.krs where u.day > s.day and u.day < date '2024-02-01'""")
both("j11_flag_ambiguous", lambda e: f"""with amb as (select person from candidates group by person having count(distinct election_type) > 2)
    select c.person, a.person is not null as ambiguous, count(case when a.person is null then c.cand end) as kept from candidates c left join amb a on c.person = a.person group by c.person, a.person""")
both("j12_share_of_total", lambda e: "select first_name, n, round(n / total, 9) as p from (select first_name, count(*) as n from register_people group by first_name) a cross join (select cast(count(*) as double) as total from register_people) t")
both("j13_max_joined_back", lambda e: """select v.node, v.category, v.amount, v.vote from votes v join (select node, category, max(amount) as top from votes group by node, category) m on v.node = m.node and v.category = m.category and v.amount = m.top""")
both("j14_semi_and_anti", lambda e: """select company, 'submitted' as side from companies where company in (select company from posts where end_date is null)
    union all select company, 'missing' from companies c where not exists (select 1 from owners o where o.child = c.company)""")
both("j22_multi_source_precedence", lambda e: """with keys as (select krs from companies where company % 2 = 0 union select krs from companies where company % 3 = 0 union select krs from companies)
    select k.krs, coalesce(a.company_name, b.company_name, 'unknown') as name, coalesce(b.city, a.city) as city, a.krs is not null as in_a, b.krs is not null as in_b from keys k
    left join (select * from companies where company % 2 = 0) a on k.krs = a.krs left join (select * from companies where company % 3 = 0) b on k.krs = b.krs""")
both("j23_lookup_with_dominant_fallback", lambda e: """with shares as (select code2, activity, count(*) as n, sum(count(*)) over (partition by code2) as total from companies group by code2, activity),
    dom as (select code2, activity from (select *, row_number() over (partition by code2 order by n desc, activity) as rn from shares) s where rn = 1 and n > 0.3 * total)
    select c.company, coalesce(x.activity, d.activity) as activity from companies c left join (select company, activity from companies where company % 2 = 0) x on c.company = x.company left join dom d on c.code2 = d.code2""")
both("j25_bidirectional_prefix", lambda e: f"""select r.id, p.id as other from (select id, last_name, x as code from register_people r join place_codes c on r.place = c.place {e.unnest(e.array('c.code2', 'c.code4'))}) r join (select distinct last_name, case when person % 2 = 0 then code2 else code4 end as code, person as id from candidates) p
    on r.last_name = p.last_name and r.code = p.code""")
both("j26_identifier_cross_map", lambda e: """select p.contract, p.seq, coalesce(a.krs, b.krs, 'other_' || cast(p.supplier as string)) as key from parties p left join (select nip, krs from companies where company % 2 = 0) a on p.nip = a.nip
    left join (select company, krs from companies where company % 3 = 0) b on p.supplier = b.company""")
both("j28_article_merge", lambda e: """select a.article, f.n as facts, s.model_score, m.people from articles a join (select node as article, count(*) as n from notes group by node) f on a.article = f.article
    left join (select article, model_score from articles where model_score > 1) s on a.article = s.article left join (select node as article, count(distinct user_id) as people from notes where kind = 'click' group by node) m on a.article = m.article""")
both("j29_edge_endpoints", lambda e: """select x.id, s.name as source_name, t.name as target_name, coalesce(s.published, false) and coalesce(t.published, false) as both_published from edges x left join nodes s on x.source = s.id left join nodes t on x.target = t.id""")
both("j30_edges_either_endpoint", lambda e: "select distinct x.id from edges x where x.source in ('p10', 'p20', 'r3') or x.target in ('c1', 'c2', 'c3')")
both("j31_topic_neighbours", lambda e: """with mentioned as (select distinct 'p' || cast(node as string) as id from notes where kind = 'signup'), near as (select distinct x.target as id from edges x join mentioned m on x.source = m.id)
    select n.id, n.name from nodes n where n.id in (select id from near) or n.id in (select id from mentioned)""")
both("j32_topic_links", lambda e: f"select article, {e.text(e.set('kind'))} as topics from (select a.article, n.kind from articles a join notes n on n.node = a.article where not n.deferred) x group by article")
both("j33_most_specific_region", lambda e: f"""select company, id from (select c.company, r.id, row_number() over (partition by c.company order by length(r.id) desc, r.id) as rn
    from (select company, x as code from companies {e.unnest(e.array('code2', 'code4', "code4 || lpad(cast(company as string), 3, '0')"))}) c join region_nodes r on r.id = c.code) x where rn = 1""")
both("j34_places_in_regions", lambda e: """select distinct target as place from edges where kind = 'owns' and source in ('r1', 'r2', 'r7') and target not in (select id from nodes where kind = 'region')""")
both("j35_region_expansion", lambda e: "select a.id as region, b.id as inner_id from region_nodes a join region_nodes b on a.kind = 'region' and substring(b.id, 1, 2) = a.id")
both("j36_revision_describe", lambda e: """select r.rev, n.name as target, c.c_name as author, prev.value as approved_value, r.value is distinct from prev.value as changed from revisions r left join nodes n on n.id = 'p' || cast(r.node as string)
    left join customer c on c.c_custkey = r.user_id left join (select node, max_by(value, rev) as value from revisions where approved group by node) prev on prev.node = r.node""")
both("j37_latest_name_fallback", lambda e: """select r.node, coalesce(n.name, r.latest) as name from (select node, max_by(event_type, rev) as latest from revisions group by node) r left join (select * from nodes where published) n on n.id = 'p' || cast(r.node as string)""")
both("j38_orphans", lambda e: "select x.id from edges x left join nodes n on x.target = n.id and not n.deleted and n.published where n.id is null")
both("j39_contract_parties", lambda e: f"""select c.contract, c.amount, p.parties, p.parties is null as stub from contracts c left join (select contract, {e.text(e.sorted("array_agg(" + e.struct(seq='seq', nip='nip') + ")"), "cast(z.seq as string) || ':' || z.nip")} as parties from parties group by contract) p on c.contract = p.contract""")
both("j40_register_overlap", lambda e: """select 'both' as side, count(distinct p.nip) as n from parties p join (select nip from companies where company % 2 = 0) c on p.nip = c.nip
    union all select 'only_contracts', count(distinct nip) from parties where nip not in (select nip from companies where company % 2 = 0)""")
both("j41_two_name_paths", lambda e: "select id from register_people where last_name in (select last_name from candidates where code2 = '01') union select id from register_people where first_name in (select first_name from candidates where code2 = '02' and votes > 490000)")

# --- aggregations

both("a1_nested_aggregate", lambda e: f"""select person, {e.text(e.sorted("array_agg(" + e.struct(year='election_year', code='code4', cand='cand') + ")"), "cast(z.year as string) || ':' || z.code || ':' || cast(z.cand as string)")} as elections, {e.text(e.set('committee'))} as committees, max(first_name) as first_name from candidates group by person""")
both("a2_merge_lists", lambda e: f"""select coalesce(a.person, b.person) as person, {e.text(e.union(f"coalesce(a.xs, {e.filter(e.array('cast(0 as bigint)'), 'z', 'z > 0')})", f"coalesce(b.xs, {e.filter(e.array('cast(0 as bigint)'), 'z', 'z > 0')})"))} as xs
    from (select person, {e.set('company')} as xs from posts where end_date is null group by person) a full outer join (select person, {e.set('company')} as xs from posts where n_lines > 1 group by person) b on a.person = b.person""")
both("a3_sum_over_union", lambda e: "select name, cast(sum(n) as bigint) as n from (select first_name as name, count(*) as n from register_people group by first_name union all select first_name, count(*) from candidates group by first_name) x group by name")
both("a4_avg_group_by_all", lambda e: "select last_name, code2, round(avg(votes), 6) as mean from candidates group by all")
both("a5_max_by_three", lambda e: "select first_name, last_name, birth_year, max(votes) as top from candidates group by first_name, last_name, birth_year")
both("a6_columnwise_max", lambda e: "select krs, max(day) as day, max(number) as number, max(method) as method from scrapes group by krs")
both("a7_filtered_count", lambda e: "select host, count(*) filter (where done) as done, count(*) filter (where not done and retries < 3) as waiting, count(*) filter (where retries >= 3) as failed from queue group by host")
both("a8_pattern_census", lambda e: """select second_name is not null as has_second, birth_date like '%-00' as partial, id % 9 = 0 as rare, count(*) as n, second_name is not null and not birth_date like '%-00' as good from register_people group by all""")
both("a9_normalised_mean", lambda e: """select node, round(sum(case when amount - 100 < 0 then (amount - 100) / abs(lo) else (amount - 100) / abs(hi) end) / (count(*) + 2), 9) as score from votes cross join (select min(amount - 100) as lo, max(amount - 100) as hi from votes) g group by node""")
both("a10_votes_human_and_model", lambda e: """select node, category, round(coalesce(sum(amount) filter (where not by_model), 0) + coalesce(max(amount) filter (where by_model), 0), 6) as total, max(case when not by_model then day end) as latest_human from votes group by node, category""")
both("a11_edge_stats", lambda e: """select source, count(*) as all_edges, count(*) filter (where published) as approved, count(distinct target) as targets, count(distinct kind) as kinds from edges group by source""")
both("a13_current_and_latest", lambda e: "select person, bool_or(end_date is null or end_date > date '2001-01-01') as employed, cast(max(cast(start_date as string)) as string) as latest_start from posts group by person")
both("a14_node_stats", lambda e: """select n.id, coalesce(s.sources, 0) as note_sources, coalesce(v.votes, 0) as votes, coalesce(x.edges, 0) as edges, n.published and not n.deleted as approved from nodes n
    left join (select 'p' || cast(node as string) as id, cast(sum(sources) as bigint) as sources from notes group by node) s on n.id = s.id
    left join (select 'p' || cast(node as string) as id, count(*) as votes from votes group by node) v on n.id = v.id
    left join (select id, count(*) as edges from (select source as id from edges union all select target from edges) y group by id) x on n.id = x.id""")
both("a16_group_by_either_key", lambda e: f"select k, count(*) as n, count(distinct id) as edges from (select id, {e.array('source', 'target')} as ks from edges) y {e.unnest('ks', 'k')} group by k")
both("a17_people_buckets", lambda e: """select count(*) filter (where published) as approved, count(*) filter (where not published and score > 0) as reviewed, count(*) filter (where not published and score <= 0) as to_check, count(*) filter (where deleted) as deleted, count(*) as total from nodes where kind = 'person'""")
both("a18_publication_histogram", lambda e: f"""select cast(b.x as bigint) as bucket, count(p.person) as n, count(p.person) filter (where p.person % 2 = 0) as approved from (select x from (select 1 as one) o {e.unnest(e.seq('1', '5'))}) b
    left join (select person, least(5, cast(floor(sum(n_lines) / 20.0) as bigint) + 1) as bucket from posts group by person) p on p.bucket = b.x group by b.x""")
both("a19_breakdowns", lambda e: """select greatest(-5, least(5, cast(floor(total / 100) as bigint) - 10)) as score, count(*) as nodes, cast(sum(voters) as bigint) as voters from (select node, sum(amount) as total, count(distinct voter) as voters from votes group by node) x group by 1""")
both("a20_activity_series", lambda e: f"""select d.x as day, count(v.vote) as total, count(v.vote) filter (where category = 'click') as clicks, count(v.vote) filter (where category = 'error') as errors, count(distinct voter) as voters
    from (select x from (select min(day) as lo, max(day) as hi from votes) r {e.unnest(e.days_seq('lo', 'hi'))}) d left join votes v on v.day = d.x group by d.x""")
both("a21_domain_stats", lambda e: f"""select domain, count(*) as articles, count(distinct lang) as langs, {e.text(e.set('lang'))} as lang_set from (select {e.rx_group('url', '^https?://([^/]+)/', 1)} as domain, {e.rx_group('url', '^https?://[^/]+/([a-z]+)/', 1)} as lang from pages) x group by domain""")
both("a22_value_attribution", lambda e: """select p.nip, round(sum(c.amount / k.n), 4) as value, count(distinct p.contract) as contracts from parties p join contracts c on p.contract = c.contract join (select contract, count(*) as n from parties group by contract) k on k.contract = p.contract group by p.nip""")
both("a23_counterparty_kinds", lambda e: "select kind, count(*) as n, count(distinct nip) as held, round(sum(c.amount), 2) as value from parties p join contracts c on p.contract = c.contract group by kind")
both("a24_tag_ranges", lambda e: f"""select user_id, {e.text(e.sorted("array_agg(" + e.struct(n='-n', tag='kind', first='first', last='last') + ")"), "z.tag || ':' || cast(-z.n as string) || ':' || cast(z.first as string) || ':' || cast(z.last as string)")} as tags, cast(sum(n) as bigint) as total from (select user_id, kind, count(*) as n, min(cast(ts as date)) as first, max(cast(ts as date)) as last from notes group by user_id, kind) x group by user_id""")
both("a25_widespread_stems", lambda e: f"""select stem, count(distinct doc_id) as n from (select doc_id, {e.rx_replace('x', '(ing|ion|ed)$', '')} as stem from documents {e.unnest(e.split('lower(text)', '[^a-z]+'))}) y where length(stem) > 2 group by stem having count(distinct doc_id) > 50""")
both("a26_most_common", lambda e: "select last_name, count(*) as n from candidates group by last_name having count(*) >= 5 order by n desc, last_name limit 10")
both("a27_field_presence", lambda e: f"""select field, count(*) as n, count(v) filter (where v <> '') as filled, round(cast(count(v) filter (where v <> '') as double) / count(*), 9) as rate from
    (select 'second_name' as field, second_name as v from register_people union all select 'birth_date', birth_date from register_people union all select 'first_name', first_name from register_people) x group by field""")
both("a28_date_coverage", lambda e: """select kind, count(*) filter (where start_date is not null) as has_start, count(*) filter (where end_date is null and start_date is not null) as no_end, count(*) filter (where start_date is null and end_date is not null) as end_only, count(*) as n from edges group by kind""")
both("a29_snapshot_hash", lambda e: f"select krs, day, substring({e.sha256(e.join(e.map(e.set('user_event'), 'x', 'x'), ','))}, 1, 16) as people_hash from (select user_id as krs, cast(ts as date) as day, event_type as user_event from events) x group by krs, day")
both("a30_per_minute_json_sums", lambda e: f"select {e.minute('ts')} as minute, cast(sum(cast({e.json('props', 'k')} as bigint)) as bigint) as k, count(*) as n from events group by 1")
both("a31_per_worker_sums", lambda e: f"select user_id as worker, cast(sum(cast({e.json('props', 'k')} as bigint)) as bigint) as k, round(sum(value), 6) as value, count(*) as n from events group by user_id")
both("a32_counter_deltas", lambda e: f"select worker, minute, round(sum(greatest(0, delta)), 6) as delta from (select user_id as worker, {e.minute('ts')} as minute, value - lag(value) over (partition by user_id order by ts, event_id) as delta from events) x where delta is not null group by worker, minute")
both("a33_percent_of_total", lambda e: "select event_type, round(avg(value), 6) as mean, round(min_by(value, ts), 6) as first_value, round(100 * cast(count(*) as double) / sum(count(*)) over (), 6) as pct from events group by event_type")
both("a34_recall_and_lift", lambda e: """with best as (select node, max(case when by_model then amount end) as m, bool_or(not by_model and amount > 150) as truth from votes group by node)
    select cast(floor(coalesce(m, 0) / 50) as bigint) as band, count(*) as n, count(*) filter (where truth) as hits, round(cast(count(*) filter (where truth) as double) / count(*), 9) as rate, round((cast(count(*) filter (where truth) as double) / count(*)) / (select avg(case when truth then 1.0 else 0.0 end) from best), 6) as lift from best group by 1""")
both("a35_party_share_by_company", lambda e: """select company, c_mktsegment as party, count(*) as people, round(cast(count(*) as double) / sum(count(*)) over (partition by company), 9) as share from posts join customer on person = c_custkey group by company, c_mktsegment""")
both("a36_delay_histogram", lambda e: f"""select case when d <= 1 then '0-1' when d <= 3 then '2-3' when d <= 7 then '4-7' else '8+' end as bucket, count(*) as n from (select u.krs, u.day, min({e.days('u.day', 's.day')}) as d from updates u join scrapes s on s.krs = u.krs and s.day >= u.day group by u.krs, u.day) x group by 1""")
both("a37_roster_cutoff", lambda e: f"select company, {e.size(e.set('person'))} as people, {e.size(e.set('person'))} > 450 as oversized from posts group by company")
both("a39_counts_per_table", lambda e: "select 'orders' as name, count(*) as n from orders union all select 'lineitem', count(*) from lineitem union all select 'customer', count(*) from customer union all select 'events', count(*) from events")
both("a40_duplicate_keys", lambda e: "select first_name, place, count(*) as n from register_people group by first_name, place having count(*) > 1")

# --- windows

both("w2_best_tier_unless_ambiguous", lambda e: """select id, cand, tier from (select *, min(tier) over (partition by id) as best, count(*) over (partition by id, tier) as n from
    (select r.id, c.cand, case when r.second_name = c.second_name then 0 else 1 end as tier from register_people r join candidates c on r.first_name = c.first_name and r.last_name = c.last_name and c.birth_year = r.birth_year) x) y where tier = best and (tier = 0 or n = 1)""")
both("w3_reject_ambiguity", lambda e: "select id, first_name, last_name from (select *, count(*) over (partition by first_name, last_name) as n from register_people) x where n = 1")
both("w4_best_by_score_then_gap", lambda e: """select person, cand, votes from (select *, row_number() over (partition by person order by votes desc, abs(birth_year - 1965) asc nulls last, cand) as rn from candidates) x where rn = 1""")
both("w6_fill_from_partition", lambda e: """select cand, coalesce(birth_year, case when max(birth_year) over w - min(birth_year) over w <= 2 then max(birth_year) over w end) as birth_year from candidates window w as (partition by first_name, last_name, person)""")
both("w7_quota_per_domain", lambda e: "select id, host from (select q.*, row_number() over (partition by host order by priority, id) as rn from queue q where not done) x join (select host as h, count(*) as n from queue where done group by host) d on h = host where rn <= 100 - n")
both("w11_hash_change", lambda e: """select krs, max(day) as changed from (select krs, day, state, lag(state) over (partition by krs order by day) as before from snapshots) x where before is null or before <> state group by krs""")
both("w13_first_seen", lambda e: "select event_id, lower(event_type) as t, user_id from (select *, row_number() over (partition by lower(event_type), user_id order by event_id) as rn from events) x where rn = 1")
both("w14_running_mean", lambda e: "select event_id, cast(floor(sum(cast(round(value * 100) as bigint)) over w / count(*) over w) as bigint) as mean_cents from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)")
both("w15_dominant_value", lambda e: "select host, status from (select user_id as host, coalesce(status, 'none') as status, count(*) as n, sum(count(*)) over (partition by user_id) as total from notes group by user_id, coalesce(status, 'none')) x where n > 0.6 * total")
both("w16_survivor", lambda e: """select id from (select id, row_number() over (partition by source, kind order by published desc, n_lines desc, id) as rn from edges) x where rn = 1""")
both("w17_revisions_latest", lambda e: "select node, max_by(rev, rev) as latest, count(*) as total, bool_or(not approved) as has_unapproved from revisions group by node")

# --- sort, limit, paging

both("t1_many_keys", lambda e: "select person, election_year, cand from candidates order by election_year desc, code2 asc, code4 desc, votes desc, last_name asc, first_name asc, cand limit 100")
both("t2_priority_claim", lambda e: "select id from queue where not done and retries < 3 order by priority, id limit 1")
both("t4_nested_sort", lambda e: "select id, score from nodes order by score asc nulls first, id limit 50")
both("t5_offset_page", lambda e: "select id, (select count(*) from nodes) as total from nodes order by id limit 20 offset 40")
both("t6_cursor_scan", lambda e: "select id from edges where id > 'e20' and not published order by id limit 25")
both("t7_nulls_last", lambda e: "select note, status from notes order by status desc nulls last, note limit 60")
both("t8_prefix_search", lambda e: f"select name, n from (select last_name as name, count(*) as n from register_people where {e.starts('lower(last_name)', chr(39) + 'last1' + chr(39))} group by last_name) x order by n desc, name limit 10")
both("t9_head_sample", lambda e: "select krs, day from scrapes order by day, krs limit 30")
both("t10_topk_per_domain", lambda e: f"""select page_id, domain from (select page_id, domain, row_number() over (partition by domain order by length(url) desc, page_id) as rn from (select page_id, url, {e.rx_group('url', '://([^/]+)/', 1)} as domain from pages) p) x where rn <= 3""")
both("t12_distinct", lambda e: "select distinct first_name, last_name from candidates")

# --- sets

both("u1_union_all", lambda e: "select first_name as name from register_people union all select last_name from candidates")
both("u2_concat_keep_first", lambda e: "select url, source from (select url, source, row_number() over (partition by url order by source) as rn from (select url, 1 as source from pages where page_id % 2 = 0 union all select url, 2 from pages) x) y where rn = 1")
both("u3_set_algebra", lambda e: """select 'union' as op, k from (select company as k from companies where company % 2 = 0 union select company from companies where company % 2 = 1 or company % 3 = 0) a union all select 'minus', k from (select company as k from companies where company % 2 = 0 except select company from companies where company % 2 = 1 or company % 3 = 0) b
    union all select 'one side', k from (select company as k from companies where company % 2 = 0 union all select company from companies where company % 2 = 1 or company % 3 = 0) c group by k having count(*) = 1""")
both("u4_intersection", lambda e: "select company from companies where is_public intersect select company from companies where code2 in ('01', '02')")
both("u8_added_and_removed", lambda e: f"""select a.krs, {e.text(e.except_('b.xs', 'a.xs'))} as added, {e.text(e.except_('a.xs', 'b.xs'))} as removed from (select user_id as krs, {e.set('event_type')} as xs from events where ts < timestamp '2024-01-16 00:00:00' group by user_id) a
    join (select user_id as krs, {e.set('event_type')} as xs from events where ts >= timestamp '2024-01-16 00:00:00' group by user_id) b on a.krs = b.krs""")
