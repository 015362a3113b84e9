"""Scalar functions over columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import ids, pages, register, scoring, text
from tessera.plans.registry import both, query


@query("f1_normalize_text", lambda e: "select doc_id, md5(lower(strip_accents(text))) as plain from documents where text is not null")
def f1(t):
    docs = t["documents"].where("text is not null")
    return docs.select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("plain"))


@query("f2_remove_diacritics", lambda e: "select n_nationkey, translate('Łódź ' || n_name || ' Żółć', 'ąćęłńóśźżĄĆĘŁŃÓŚŹŻ', 'acelnoszzACELNOSZZ') as plain from nation")
def f2(t):
    return t["nation"].select("n_nationkey", text.without_polish_marks(F.concat(F.lit("Łódź "), "n_name", F.lit(" Żółć"))).alias("plain"))


@query("f3_jaro_winkler", lambda e: "select a.p_partkey as a, b.p_partkey as b, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) as sim from part a join part b on b.p_partkey = a.p_partkey + 1")
def f3(t):
    p = t["part"].select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"))
    q = t["part"].select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))
    pairs = p.join(q, F.col("a") + 1 == F.col("b"))
    return pairs.select("a", "b", F.round(text.jaro_winkler("x", "y"), 6).alias("sim"))


@query("j5_conditional_fuzzy_match", lambda e: """select r.id, w.id as wiki from (select id, first_name, last_name, birth_date, birth_year from register_people) r
    join (select id, regexp_extract(full_name, '^([^ ]+)', 1) as f, regexp_extract(full_name, '^[^ ]+ ([^ ]+)', 1) as l, birth_iso, birth_year from wiki_people) w on r.last_name = w.l
    where case when w.birth_iso not like '%-00' then r.birth_date = w.birth_iso and jaro_winkler_similarity(r.first_name, w.f) > 0.85 else r.birth_year = w.birth_year and r.first_name = w.f end""")
def j5(t):
    r = t["register_people"]
    w = t["wiki_people"].select(F.col("id").alias("wiki"), F.regexp_extract("full_name", "^([^ ]+)", 1).alias("f"), F.regexp_extract("full_name", "^[^ ]+ ([^ ]+)", 1).alias("last_name"), "birth_iso", F.col("birth_year").alias("y"))
    full = ~F.col("birth_iso").like("%-00")
    # Each branch of the condition is a join on keys of its own.
    by_day = r.join(w.where(full), (r.last_name == w.last_name) & (F.col("birth_date") == F.col("birth_iso"))).where(text.jaro_winkler("first_name", "f") > 0.85)
    by_year = r.join(w.where(~full), (r.last_name == w.last_name) & (F.col("birth_year") == F.col("y")) & (F.col("first_name") == F.col("f")))
    return by_day.select("id", "wiki").union(by_year.select("id", "wiki"))


@query("j6_theta_fuzzy", lambda e: "select a.company, n.n_nationkey as place from companies a left join nation n on jaro_winkler_similarity(a.city, n.n_name) > 0.95")
def j6(t):
    # A theta join has no key: the places are a fixed dimension of a few rows, each compared once per distinct city.
    n = t["nation"].select(F.col("n_nationkey").alias("place"), "n_name")
    cities = t["companies"].select("city").distinct().join(F.broadcast(n)).where(text.jaro_winkler("city", "n_name") > 0.95).select("city", "place")
    return t["companies"].join(cities, "city", "left").select("company", "place")


@query("f4_sequence_ratio")
def f4(t):
    return t["part"].select("p_partkey", F.round(text.sequence_ratio("p_name", "p_type"), 6).alias("ratio"), F.size(text.sequence_edits("p_name", "p_type")).alias("edits"))


@query("j24_exact_then_fuzzy")
def j24(t):
    """Register people and candidates of one place and first name: the same last name, else the most similar one.

    Names are compared once for each distinct pair, and only what the best pair needs is joined back."""
    from tessera.operators import temporal

    key = ["place", "first_name"]
    a = t.sql("select distinct place, first_name, last_name from register_people")
    b = t.sql("select c_nationkey as place, first_name, last_name as cand, min(cand) as other from candidates join customer on c_custkey = person group by c_nationkey, first_name, last_name")
    score = F.when(F.col("last_name") == F.col("cand"), 2.0).otherwise(text.sequence_ratio("last_name", "cand") + 0.1)
    best = temporal.latest_per_key(a.join(b, key).withColumn("s", score).where("s >= 0.75"), [*key, "last_name"], F.desc("s"), F.asc("other"))
    return t["register_people"].join(best, [*key, "last_name"]).select("id", "other", F.round("s", 6).alias("s"))


both("f5_regex_trim", lambda e: f"select p_partkey, trim(upper({e.rx_replace('p_name', '[aeiou]+', '_')})) as s, {e.rx_group('p_name', '^([a-z]+) ', 1)} as first_word from part")
both("f6_prefix_slice_pad", lambda e: f"select company, substring(krs, 1, 4) as head, lpad(cast(company as string), 10, '0') = krs as same, {e.starts('krs', chr(39) + '00' + chr(39))} as zero from companies")
both("f7_name_formats", lambda e: f"""select id, case when id % 3 = 0 then {e.rx_group("last_name || ', ' || first_name", ', (.*)$', 1)} when id % 3 = 1 then {e.rx_group("first_name || ' ' || last_name", '^([^ ]+) ', 1)} else {e.rx_group("last_name || ' ' || first_name", ' ([^ ]+)$', 1)} end as given from register_people""")


@query("f8_prefix_chunks", lambda e: "select p_partkey, array_to_string(list_sort(list_distinct(flatten(list_transform(string_split(lower(p_name), ' '), lambda w: list_transform(range(1, length(w) + 1), lambda n: substring(w, 1, n)))))), '|') as chunks from part")
def f8(t):
    return t["part"].select("p_partkey", F.array_join(text.prefixes_of_words(F.col("p_name")), "|").alias("chunks"))


@query("f9_slug", lambda e: "select p_partkey, regexp_replace(regexp_replace(lower(translate(p_name || ' ' || p_type || ' Łąka!', 'ąćęłńóśźżĄĆĘŁŃÓŚŹŻ', 'acelnoszzACELNOSZZ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from part")
def f9(t):
    return t["part"].select("p_partkey", text.slug(F.concat("p_name", F.lit(" "), "p_type", F.lit(" Łąka!"))).alias("slug"))


#: Organisations and parties as registers and files spell them.
_ORGS = """select p_partkey, case p_partkey % 6 when 0 then 'Przedsiębiorstwa Gospodarki Komunalnej ' || p_name when 1 then 'Fundacja  ' || p_name || ' Miejskiego Teatru' when 2 then 'Wodociągami Łódzkich Zakładów Sp. z o.o.'
    when 3 then 'Polska Spółka Węglowa ' || p_type when 4 then null else p_name end as org,
    case p_partkey % 11 when 0 then 'PiS' when 1 then 'PO' when 2 then 'PSL' when 3 then 'KW Prawo i Sprawiedliwość' when 4 then 'Sojusz Lewicy Demokratycznej' when 5 then 'KKW Trzecia Droga Polska 2050 - Polskie Stronnictwo Ludowe'
        when 6 then 'Nowa Lewica' when 7 then 'KW Ligi Polskich Rodzin' when 8 then p_brand when 9 then 'Polska 2050' end as party from part"""


@query("f10_stem", lambda e: f"""with w as (select p_partkey, party, unnest(string_split_regex(coalesce(org, ''), ' +')) as w from (select p_partkey, replace(lower(strip_accents(org)), 'ł', 'l') as org, replace(lower(strip_accents(party)), 'ł', 'l') as party from ({_ORGS}) o) n),
    st as (select p_partkey, party, w, left(w, length(w) - coalesce(length(list_filter(string_split('{' '.join(text.ENDINGS)}', ' '), lambda e: ends_with(w, e) and length(w) - length(e) >= 4)[1]), 0)) as s from w),
    o as (select p_partkey, party, coalesce(string_agg(distinct s, '|' order by s) filter (where length(s) >= 5 and not list_contains(string_split('{' '.join(text.COMMON_ORG_WORDS)}', ' '), w) and not list_contains(string_split('{' '.join(text.COMMON_ORG_WORDS)}', ' '), s)), '') as stems from st group by p_partkey, party)
    select p_partkey, stems, case when party = 'pis' then 'pis|prawo i sprawiedliwosc' when party = 'po' then 'koalicja obywatelska' when party = 'psl' then 'polskie stronnictwo ludowe|psl' when party = 'nowa lewica' then 'nowa lewica' when party = 'polska 2050' then 'pl2050|polska 2050'
        when party like '%prawo i%' then 'pis|prawo i sprawiedliwosc' when party like 'sojusz%' then 'sld|sojusz lewicy demokratycznej' when party like '%trzecia%' then 'polska 2050|polskie stronnictwo ludowe|psl|trzecia droga'
        when party like '%ligi%' then 'liga polskich rodzin|ligi polskich rodzin' else '' end as terms from o""")
def f10(t):
    named = t.sql(_ORGS).select("p_partkey", text.normalize_text("org").alias("org"), text.normalize_text("party").alias("party"))
    return named.select("p_partkey", F.array_join(text.org_terms(F.col("org")), "|").alias("stems"), F.array_join(text.party_terms(F.col("party")), "|").alias("terms"))


@query("f11_mention_index", lambda e: """with w as (select doc_id, generate_subscripts(ws, 1) as pos, unnest(ws) as a from (select doc_id, string_split_regex(text, '[^A-Za-z]+') as ws from documents) d),
    g as (select w.doc_id, w.a || ' ' || v.a as name from w join w v on v.doc_id = w.doc_id and v.pos = w.pos + 1 where regexp_matches(w.a, '^[A-Z]')),
    ix as (select name from g group by name having count(distinct doc_id) >= 2) select doc_id, count(*) as mentions from g where name in (select name from ix) group by doc_id""")
def f11(t):
    w = t["documents"].select("doc_id", F.split("text", "[^A-Za-z]+").alias("ws"))
    grams = w.select("doc_id", F.explode(F.filter(F.arrays_zip(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))).alias("a"), F.slice("ws", 2, F.size("ws")).alias("b")), lambda p: p["b"].isNotNull() & p["a"].rlike("^[A-Z]"))).alias("g"))
    grams = grams.select("doc_id", F.concat("g.a", F.lit(" "), "g.b").alias("name"))
    index = grams.groupBy("name").agg(F.count_distinct("doc_id").alias("n")).where("n >= 2")
    return grams.join(index, "name", "left_semi").groupBy("doc_id").agg(F.count("*").alias("mentions"))


both("f12_context_window", lambda e: f"select doc_id, substring(text, greatest(cast({e.instr('text', chr(39) + 'the' + chr(39))} as int) - 20, 1), 43) as around from documents where {e.instr('text', chr(39) + 'the' + chr(39))} > 0")


@query("f13_verbatim_span")
def f13(t):
    d = t["documents"].where("text is not null")
    quote = F.concat(F.substring("text", 50, 40), F.lit(" ... "), F.substring("text", 120, 30))
    return d.select("doc_id", text.verbatim_span(quote, "text").alias("s")).select("doc_id", "s.start", "s.stop", F.round("s.score", 4).alias("score"))


both("f14_tag_atoms", lambda e: f"""select event_id, {e.join(e.filter(e.map(e.split("event_type || ',Tag ' || cast(user_id % 9 as string) || ';x'", '[,;]'), 'z', 'lower(trim(z))'), 'y', "y in ('click', 'view', 'x') or " + e.starts('y', "'tag'")), '|')} as tags from events""")
#: Committee names as files spell them, and what each stands for; a name nobody has classified has no party.
_COMMITTEES = """select o_orderkey, case o_orderkey % 5 when 0 then '  KW   ' || o_orderpriority when 1 then 'kw ' || lower(o_orderpriority) when 2 then 'KKW ' || o_orderpriority || chr(10) when 3 then 'KWW Local - ' || o_orderpriority else o_orderpriority end as committee from orders"""
both("f15_committee_map", lambda e: f"""select o_orderkey, c.norm, m.parties from (select o_orderkey, trim({e.rx_replace('lower(committee)', '[ ' + chr(92) + 'n' + chr(92) + 't]+', ' ')}) as norm from ({_COMMITTEES}) y) c
    left join (values ('kw 1-urgent', 'A'), ('kw 2-high', 'B'), ('kkw 1-urgent', 'A|B'), ('kkw 3-medium', 'C'), ('5-low', 'D')) as m(name, parties) on m.name = c.norm""")

#: Bodies with a code of their own or none, and names that state a sector, a legal form, an office or nothing.
_BODIES = """select company, case when company % 3 <> 1 then case company % 11 when 0 then '86.10' when 2 then '90.01' when 3 then '41.20' when 5 then '94.99' when 6 then '73.12' when 8 then '73.20' else activity end end as activity,
    case when company % 15 = 5 then 'Urząd ' else '' end || company_name || case company % 15 when 0 then ' Szpital' when 1 then ' Wodociągi sp. z o.o.' when 2 then ' Fundacja' when 3 then ' s.c.' when 4 then ' Spółka' when 6 then ' SA' when 7 then ' Urząd'
        when 8 then ' Catering' when 9 then ' Roboty drogowe' when 10 then ' Spółka Cywilna' when 11 then ' Biblioteka' when 12 then ' Instytut' when 13 then ' Klub SA' else '' end as name, company % 8 = 7 as budget from companies"""


@query("f16_classify_by_code", lambda e: f"""select company, case when left(activity, 3) in ('86.', '87.', '21.') then 'health' when left(activity, 3) in ('35.', '36.', '37.', '38.', '39.') or left(activity, 4) = '49.3' then 'utilities' when left(activity, 3) in ('94.', '88.') then 'associations'
    when left(activity, 3) in ('90.', '93.', '79.', '55.', '56.', '59.') or left(activity, 4) in ('82.3', '73.1') then 'events' when left(activity, 3) in ('41.', '42.', '43.') then 'construction'
    when name like '%Szpital%' then 'health' when name like '%Wodociągi%' then 'utilities' when name like '%Fundacja%' or name like '% Klub %' then 'associations' when name like '%Catering%' then 'events' when name like '%drogowe%' then 'construction'
    when name like '% s.c.' or name like '%Spółka Cywilna%' then 'civil' when name like '%Spółka%' or name like '% SA' or name like '%Instytut' then 'private' when budget or name like 'Urząd%' or name like '%Biblioteka%' then 'budget' else 'sole' end as kind from ({_BODIES}) x""")
def f16(t):
    return t.sql(_BODIES).select("company", register.kind_of_body(F.array("activity"), F.col("name"), F.col("budget")).alias("kind"))


both("f17_categories_from_codes", lambda e: f"select company, {e.join(e.distinct(e.filter(e.array('case when ' + e.starts('activity', chr(39) + '35' + chr(39)) + ' then ' + chr(39) + 'energy' + chr(39) + ' end', 'case when ' + e.starts('activity', chr(39) + '36' + chr(39)) + ' then ' + chr(39) + 'water' + chr(39) + ' end', 'case when is_public then ' + chr(39) + 'public' + chr(39) + ' end'), 'x', 'x is not null')), '|')} as categories from companies")


@query("f18_model_answer_json", lambda e: "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def f18(t):
    answer = F.concat(F.lit("<think>{\"k\": 0}</think>\n```json\nSure: "), "props", F.lit("\n```"))
    return t["events"].select("event_id", F.from_json(text.first_object(answer), "k bigint").getField("k").alias("k"))


@query("f21_url_normalise", lambda e: """select page_id, lower(regexp_extract(u, '^([^:]+)', 1)) || '://' || regexp_replace(lower(regexp_extract(u, '://([^/?#]*)', 1)), '^www[.]', '') || regexp_replace(regexp_extract(u, '://[^/?#]*(.*)$', 1), '/+$', '') as url
    from (select page_id, case when page_id % 3 = 0 then 'https://' || regexp_extract(url, '://(.*)$', 1) else replace(url, '://', '://WWW.') || '/' end as u from pages) x""")
def f21(t):
    given = F.when(F.col("page_id") % 3 == 0, F.regexp_extract("url", "://(.*)$", 1)).otherwise(F.concat(F.replace("url", F.lit("://"), F.lit("://WWW.")), F.lit("/")))
    return t["pages"].select("page_id", ids.normal_url(given).alias("url"))


@query("f22_host_function", lambda e: "select page_id, regexp_extract(url, '://([^/]+)/', 1) as host from pages")
def f22(t):
    return t["pages"].select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"))


#: Pages as captured in several layouts: a base address, links of every kind, linked data as an object, a list or a
#: @graph, and content under different elements.  d is the page's date.
_BODY = "regexp_extract(html, '<article>(.*)</article>', 1)"
_LINKED = """case page_id % 4 when 0 then '{"@type": "NewsArticle", "headline": "Title ' || page_id || '", "datePublished": "' || d || 'T10:00:00+02:00"}'
    when 1 then '{"@context": "x", "@graph": [{"@type": "WebSite", "name": "Site"}, {"@type": ["Thing", "Article"], "headline": "Title  ' || page_id || ' &amp; more"}, {"@type": "WebPage", "datePublished": "' || d || '"}]}'
    when 2 then '[{"@type": "Organization", "name": "Site ' || page_id || '"}, {"dateModified": "never", "dateCreated": "' || d || '"}]' else '{broken' end"""
_CAPTURED = f"""select page_id, url, d, '<!DOCTYPE html><html><head>' || case when page_id % 3 = 0 then '<base href="https://WWW.Base.example/dir/page">' else '' end ||
    '<script type="application/ld+json">' || {_LINKED} || '</script><title>t</title></head><body><nav><a href="/One?x=1#y">1</a><a href="two/">2</a><a href="#top">3</a><a href="mailto:a@b.c">4</a><A HREF=''https://www.Other.example/Path/''>5</A><a href="/One">6</a></nav>' ||
    case page_id % 5 when 0 then '<article class="entry"><h2>Heading</h2><p>Words of ' || page_id || '<p>and more</article>' when 1 then '<main><div class="post-body lead"><p>Words&nbsp;of ' || page_id || '</p></div></main>'
    when 2 then '<div id="content"><script>var a = "</p>";</script>Words of ' || page_id || '</div>' when 3 then '<div><p>Words of ' || page_id || '</p></div>' else '<article></article>' end || '</body></html>' as html
    from (select page_id, url, '2024-0' || cast(1 + page_id % 9 as string) || '-1' || cast(page_id % 10 as string) as d from pages) g"""


@query("f23_link_extraction", lambda e: """select page_id, array_to_string(list_sort(list_distinct([base || '/One', case when page_id % 3 = 0 then base || '/dir/two' else base || dir || 'two' end, 'https://other.example/Path'])), ' ') as links from (select page_id,
    regexp_extract(case when page_id % 3 = 0 then 'https://x' else url end, '^([a-z]+)', 1) || '://' || case when page_id % 3 = 0 then 'base.example' else regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www[.]', '') end as base, regexp_extract(url, '://[^/?#]*(/(?:[^?#]*/)?)', 1) as dir from pages) x""")
def f23(t):
    return pages.page_links(t.sql(_CAPTURED)).select("page_id", F.array_join("links", " ").alias("links"))


@query("f23_page_links", lambda e: """select page_id, count(distinct regexp_replace(regexp_replace(href, '[?#].*$', ''), '/+$', '')) as links from
    (select page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) as href from pages) x group by page_id""")
def f23_pages(t):
    """Distinct links of the pages as they are."""
    return pages.page_links(t["pages"].select("page_id", "html", "url")).select("page_id", F.size("links").cast("long").alias("links"))


@query("f24_title_extraction", lambda e: """select page_id, case page_id % 4 when 0 then 'Title ' || page_id when 1 then 'Title ' || page_id || ' & more' when 2 then 'Site ' || page_id end as title,
    case when page_id % 4 <> 3 then make_date(2024, cast(1 + page_id % 9 as int), cast(10 + page_id % 10 as int)) end as day from pages""")
def f24(t):
    """Title and date from linked data, wherever in it they are."""
    return pages.read_pages(t.sql(_CAPTURED).select("page_id", "html")).select("page_id", "title", "day")


@query("f25_selector_content", lambda e: """select page_id, case page_id % 5 when 0 then 'Heading Words of ' || page_id || ' and more' when 4 then '1 2 3 4 5 6' when 1 then 'Words of ' || page_id else '1 2 3 4 5 6 Words of ' || page_id end as content,
    case when page_id % 5 < 2 then 'selector' else 'fallback:body' end as method from pages""")
def f25(t):
    """Content by each site's selector, else by the ladder.  The ladder ends at enough characters; here all are short, and
    the longest wins."""
    given = t.sql(_CAPTURED).select("page_id", "html", F.when(F.col("page_id") % 5 == 0, "article.entry").when(F.col("page_id") % 5 == 1, "main > div.post-body").when(F.col("page_id") % 5 == 2, "section.none").alias("selector"))
    read = pages.read_pages(given, selector="selector")
    # A page whose menu is longer than its content shows why a selector is worth having: the body then wins.
    return read.select("page_id", "content", "method")


@query("f25_page_content", lambda e: f"""select page_id, {e.rx_group('html', '<h1>([^<]*)</h1>', 1)} <> '' as has_text, 'ok' as status from pages""")
def f25_pages(t):
    read = pages.read_pages(t["pages"].select("page_id", "html"))
    return read.select("page_id", (F.length("content") > 0).alias("has_text"), "status")


_SITES = """select page_id, url || case page_id % 6 when 0 then '' when 1 then '/dlugi-tytul-artykulu-o-sprawie-' || page_id when 2 then '/tag/x' when 3 then '/plik.PDF' when 4 then '/2024/05/krotki-tytul-tu/' || (100000 + page_id) else '/12_strona.html' end as url
    from (select page_id, case when page_id % 7 = 0 then 'https://single.example' else regexp_replace(url, '[?#].*$', '') end as url from pages) g"""


@query("f26_article_path_test", lambda e: rf"""select page_id, case when len(s) = 0 then false when regexp_matches(lower(last), '[.](pdf|jpe?g|png|webp|gif|zip|docx?)$') then false
    when len(list_filter(s, lambda x: list_contains(['tag', 'tagi', 'kategoria', 'autor', 'strona', 'page', 'feed', 'rss', 'search'], lower(regexp_replace(regexp_replace(x, '^[0-9]+[_-]', ''), '[.][^.]*$', ''))))) > 0 then false
    when len(s) = 1 then (length(regexp_replace(last, '[.][^.]*$', '')) > 15 and length(regexp_replace(last, '[^-]', '', 'g')) >= 2) or regexp_matches(last, '[0-9]{{5,}}') else true end as is_article,
    case when length(last) > 25 and length(regexp_replace(last, '[^-]', '', 'g')) >= 3 then 3 when length(last) > 12 and length(regexp_replace(last, '[^-]', '', 'g')) >= 2 then 2 else 0 end
    + case when regexp_matches(path, '[0-9]{{5,}}') then 2 else 0 end + case when regexp_matches(path, '/20[0-9]{{2}}/[0-9]{{2}}/') then 2 else 0 end + least(greatest(len(s) - 1, 0), 2) as score
    from (select page_id, s, coalesce(s[len(s)], '') as last, '/' || array_to_string(s, '/') as path from (select page_id, list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as s from ({_SITES}) u) v) w""")
def f26(t):
    u = t.sql(_SITES)
    return u.select("page_id", pages.is_article_path(F.col("url")).alias("is_article"), pages.article_score(F.col("url")).cast("long").alias("score"))


_VOTES = "select page_id, regexp_extract(url, '://([^/?#]+)', 1) as domain, case page_id % 5 when 0 then 'article' when 1 then 'div.text' when 2 then 'article' when 3 then '' else 'div.entry' end as selector from pages"


@query("f26_selector_vote", lambda e: f"""select domain, selector, votes from (select *, row_number() over (partition by domain order by selector in ('body', 'html', 'div', 'main', 'article'), votes desc, selector) as rn
    from (select domain, selector, count(*) as votes from ({_VOTES}) v where selector <> '' group by domain, selector) x) y where rn = 1""")
def f26_vote(t):
    return pages.majority(t.sql(_VOTES), "domain", "selector")


@query("f26_outline", lambda e: """select page_id, case when html like '%<b>%' then true else false end as bold, true as has_article from pages""")
def f26_outline(t):
    o = pages.outlines(t["pages"].select("page_id", "html"))
    return o.join(t["pages"].select("page_id", F.contains("html", F.lit("<b>")).alias("bold")), "page_id").select("page_id", "bold", F.contains("outline", F.lit("article")).alias("has_article"))


_WORDS = ("spółka", "title", "afera")


@query("f27_keyword_priority", lambda e: rf"""select page_id, greatest(0, case when host = 'single.example' then 10 else 0 end + cast(contains(slug, 'spolka') as int) + cast(contains(slug, 'title') as int) + cast(contains(slug, 'afera') as int)
    - case when regexp_matches(path, '/tag/|/tagi/|/kategoria/|/autor/|/strona/|/page/|/feed|/rss') then 5 else 0 end - case when regexp_matches(path, '/sport/|/rozrywka/|/pogoda/|/moda/|/kuchnia/|/lifestyle/') then 3 else 0 end - case when regexp_matches(path, '[.](pdf|jpg|jpeg|png|webp|gif)$') then 10 else 0 end) as subject,
    case when regexp_matches(lower(url), '[.](pdf|jpg|jpeg|png|webp|gif)$') then 0 else 10 * cast(contains(lower(url), 'single.example') as int) + 10 * cast(contains(lower(url), '/fr/') as int) + cast(contains(lower(url), 'afera') as int) end as regional
    from (select page_id, url, regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www[.]', '') as host, lower('/' || array_to_string(s, '/')) as path,
      translate(lower(s[list_position(list_transform(s, lambda x: length(x)), list_max(list_transform(s, lambda x: length(x))))]), 'ąćęłńóśźż', 'acelnoszz') as slug
      from (select page_id, url, list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as s from (select page_id, url || case page_id % 3 when 0 then '/sport/spółka-afera-title' when 1 then '/Title-of-the-page' else '' end as url from ({_SITES}) z) u) v) w""")
def f27(t):
    """Scorers by name, from the registry."""
    u = t.sql(f"select page_id, url || case page_id % 3 when 0 then '/sport/spółka-afera-title' when 1 then '/Title-of-the-page' else '' end as url from ({_SITES}) z")
    subject = scoring.SCORERS["default"](F.col("url"), _WORDS, ("single.example",))
    regional = scoring.SCORERS["regional"](F.col("url"), ("afera",), ("single.example", "/fr/"))
    return u.select("page_id", subject.cast("int").alias("subject"), regional.cast("int").alias("regional"))


@query("f28_url_score_model")
def f28(t):
    """Character 3- to 5-grams of addresses, hashed and weighted, into a ridge regression."""
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.regression import LinearRegression

    u = F.concat(F.lit(" "), F.lower("url"), F.lit(" "))
    grams = F.flatten(F.transform(F.array(*map(F.lit, (3, 4, 5))), lambda n: F.transform(F.sequence(F.lit(1), F.length(u) - n + 1), lambda i: F.substring(u, i, n))))
    rows = t["pages"].select("page_id", (F.col("page_id") % 4).cast("double").alias("label"), grams.alias("grams"))
    tf = HashingTF(inputCol="grams", outputCol="tf", numFeatures=1 << 10).transform(rows)
    idf = IDF(inputCol="tf", outputCol="features").fit(tf).transform(tf)
    model = LinearRegression(regParam=1.0, elasticNetParam=0.0, maxIter=20, solver="l-bfgs").fit(idf.where("page_id % 5 <> 0"))
    return model.transform(idf).select("page_id", F.round("prediction", 2).alias("score"))


@query("f29_storage_path", lambda e: """select page_id, 'hostname=' || regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www[.]', '') || '/' || trim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') ||
    case page_id % 3 when 0 then '/' || repeat('p', 188) || '_' || substring(md5(repeat('p', 300)), 1, 10) when 1 then '/' || repeat('p', 200) else '/' || repeat('ż', 188) || '_' || substring(md5(repeat('ż', 190)), 1, 10) end || '/date=2024-05-01/html' as path from pages""")
def f29(t):
    tail = F.when(F.col("page_id") % 3 == 0, F.repeat(F.lit("p"), 300)).when(F.col("page_id") % 3 == 1, F.repeat(F.lit("p"), 200)).otherwise(F.repeat(F.lit("ż"), 190))
    url = F.concat(F.regexp_extract("url", "^([^?#]*)", 1), F.lit("/"), tail, F.lit("/?q=1#x"))
    return t["pages"].select("page_id", ids.storage_path(url, F.lit("2024-05-01"), F.lit("html")).alias("path"))


both("f30_host_bucket", lambda e: f"""select page_id, cast({'conv(h, 16, 10)' if e.name == 'spark' else "'0x' || h"} as bigint) % 64 as bucket
    from (select page_id, substring(md5({e.rx_replace("lower(" + e.rx_group('url', '://([^/?#:]+)', 1) + ")", '^www[.]', '')}), 1, 8) as h from pages) x""")


_DATES = """select id, case id % 12 when 0 then birth_iso when 1 then '[[3 maja]] [[' || birth_year || ']] r. Warszawa' when 2 then 'maj ' || birth_year when 3 then cast(birth_year as string) when 4 then 'ok. ' || birth_year when 5 then '{{data|' || birth_year || '-02-03}}'
    when 6 then '14 grudnia ' || birth_year || '<ref name="x">y</ref>' when 7 then 'przed ' || birth_year when 8 then '1 brumaire ' || birth_year when 9 then '' when 10 then 'październik ' || birth_year else birth_year || '/' || birth_year end as written, birth_iso, birth_year from wiki_people"""


@query("f31_partial_dates", lambda e: f"""select id, case id % 12 when 0 then birth_iso when 1 then birth_year || '-05-03' when 2 then birth_year || '-05-00' when 3 then birth_year || '-00-00' when 5 then birth_year || '-02-03' when 6 then birth_year || '-12-14' when 10 then birth_year || '-10-00' end as day from ({_DATES}) x""")
def f31(t):
    return t.sql(_DATES).select("id", register.infobox_date(F.col("written")).alias("day"))


@query("f32_date_formats", lambda e: "select o_orderkey, cast(o_orderdate as date) as day from orders")
def f32(t):
    d = F.to_date("o_orderdate")
    months = F.element_at(F.array(*map(F.lit, ids.MONTHS)), F.month(d))
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "dd.MM.yyyy")).when(F.col("o_orderkey") % 3 == 1, F.concat_ws(" ", F.dayofmonth(d), months, F.year(d))).otherwise(d.cast("string"))
    return t["orders"].select("o_orderkey", ids.parsed_date(written).alias("day"))


both("f33_dotted_to_iso", lambda e: f"""select event_id, case when {e.rx('s', '^[0-9]{2}[.][0-9]{2}[.][0-9]{4}$')} then {e.rx_replace('s', '^([0-9]{2})[.]([0-9]{2})[.]([0-9]{4})$', '$3-$2-$1')} else s end as iso
    from (select event_id, case when event_id % 2 = 0 then lpad(cast(1 + event_id % 28 as string), 2, '0') || '.0' || cast(1 + event_id % 9 as string) || '.2024' else 'unknown ' || cast(event_id as string) end as s from events) x""")
both("f34_business_days", lambda e: f"select day, {e.size(e.filter(e.days_seq(e.plus_days('day', '1'), e.plus_days('day', '7')), 'd', e.dow('d') + ' <= 5'))} as n from (select distinct day from updates) u")
both("f35_years_employed", lambda e: f"select person, company, cast(year(start_date) as int) as y, round({e.days('start_date', 'end_date')} / 365.0e0, 6) as years from posts where end_date is not null")
both("f36_back_off", lambda e: f"select krs, {e.at(e.array('7', '14', '28', '56', '90'), 'cast(least(n_people, 5) as int)')} as wait from snapshots")


@query("f37_unique_probability", lambda e: """select c_custkey, round(case when p = 1 then 0 when n / 40 < 50 then power(1 - p, n / 40) else exp(-(n / 40) * p) end, 9) as p from
    (select c_custkey, coalesce(p1, 1) * case when c_custkey % 2 = 0 then coalesce(p2, 1) else 1 end as p, coalesce(n, 50000) as n from
    (select c_custkey, case when c_custkey % 11 <> 0 then 1.0e0 / (1 + c_custkey % 30) end as p1, case when c_custkey % 4 <> 0 then 1.0e0 / (1 + c_custkey % 70) end as p2, case when c_custkey % 13 <> 0 then cast(c_custkey as double) * 3 end as n from customer) x) y""")
def f37(t):
    k = F.col("c_custkey")
    p1, p2, n = F.when(k % 11 != 0, 1 / (1 + k % 30)), F.when(k % 4 != 0, 1 / (1 + k % 70)), F.when(k % 13 != 0, k.cast("double") * 3)
    return t["customer"].select("c_custkey", F.round(ids.unique_probability(p1, p2, k % 2 == 0, n), 9).alias("p"))


@query("f38_odds", lambda e: "select n_nationkey, case when n_nationkey = 0 then cast('inf' as double) else round(1 / (1 - 1.0e0 / (1 + n_nationkey)), 9) end as odds from nation")
def f38(t):
    return t["nation"].select("n_nationkey", F.round(ids.odds(1.0 / (1 + F.col("n_nationkey"))), 9).alias("odds"))


both("f39_election_score", lambda e: "select person, round(1 - power(2.0e0 / 3, count(*)), 9) as score from candidates group by person")
both("f40_list_functions", lambda e: f"select person, {e.size('xs')} as n, {e.at('xs', 1)} as first, {e.at('xs', 9)} as ninth, {e.size(e.filter('xs', 'x', 'x > 50'))} as big, {e.size(e.distinct(e.concat('xs', 'xs')))} as kinds from (select person, {e.set('company')} as xs from posts group by person) x" if e.name == "spark" else f"select person, {e.size('xs')} as n, {e.at('xs', 1)} as first, {e.at('xs', 9)} as ninth, {e.size(e.filter('xs', 'x', 'x > 50'))} as big, {e.size(e.distinct('list_concat(xs, xs)'))} as kinds from (select person, {e.set('company')} as xs from posts group by person) x")
both("f41_code_helpers", lambda e: f"select id, cast(length(id) as bigint) as digits, case when length(id) > 2 then substring(id, 1, case length(id) when 4 then 2 else 4 end) end as parent, {e.starts('id', 'substring(id, 1, 2)')} as inside from region_nodes")


@query("f42_check_digits", lambda e: """select company, (6*d1+5*d2+7*d3+2*d4+3*d5+4*d6+5*d7+6*d8+7*d9) % 11 = d10 as nip_ok from (select company, """ + ", ".join(f"cast(substring(nip, {i}, 1) as int) as d{i}" for i in range(1, 11)) + " from companies) x")
def f42(t):
    return t["companies"].select("company", ids.nip_ok(F.col("nip")).alias("nip_ok"))


@query("f42_regon_check", lambda e: """select company, (8*d1+9*d2+2*d3+3*d4+4*d5+5*d6+6*d7+7*d8) % 11 % 10 = d9 as ok from (select company, """ + ", ".join(f"cast(substring(regon, {i}, 1) as int) as d{i}" for i in range(1, 10)) + " from companies) x")
def f42b(t):
    return t["companies"].select("company", ids.regon_ok(F.col("regon")).alias("ok"))


both("f43_identifier_stems", lambda e: f"select contract, {e.join(e.set('substring(nip, 1, 9)'), ',')} as ids from parties group by contract")
both("f44_json_access", lambda e: f"select event_id, cast({e.json('props', 'k')} as bigint) as k, {e.json('props', 'missing')} as missing from events")


@query("f45_canonical_json", lambda e: "select event_id, cast(json_extract_string(props, '$.k') as bigint) % 2 = 0 as same from events")
def f45(t):
    flip = F.when(F.get_json_object("props", "$.k").cast("bigint") % 2 == 0, F.concat(F.lit('{ "b":1,"k" :'), F.get_json_object("props", "$.k"), F.lit("}"))).otherwise(F.lit('{"k": -1}'))
    one = F.from_json(F.replace("props", F.lit("{"), F.lit('{"b": 1, ')), "map<string,string>")
    entries = lambda m: F.to_json(F.array_sort(F.map_entries(m)))
    return t["events"].select("event_id", (entries(one) == entries(F.from_json(flip, "map<string,string>"))).alias("same"))


both("f46_edge_identity", lambda e: "select id, substring(md5(source || '|' || kind || '|' || target || '|' || coalesce(cast(start_date as string), '')), 1, 16) as ident, case when start_date is null and end_date is null then 'enriches' when published then 'same' else 'conflict' end as relation from edges")
both("f47_content_hash", lambda e: f"select doc_id, {e.sha256('coalesce(text, ' + chr(39) * 2 + ')')} as sha, md5(coalesce(text, '')) as md from documents")
both("f48_header_values", lambda e: "select event_id, case event_type when 'click' then 'M' when 'view' then 'K' end as sex, case when event_type in ('signup', 'purchase') then true when event_type = 'error' then false end as elected from events")
both("f49_register_json", lambda e: f"select event_id, {e.json('j', 'dane.nip')} as nip, cast({e.json('j', 'dane.n')} as bigint) as n, {e.json('j', 'dane.name')} as name from (select event_id, '{{\"dane\": {{\"nip\": \"' || cast(1000 + user_id as string) || '\", \"n\": ' || cast(event_id % 10 as string) || '}}}}' as j from events) x")


@query("f50_declared_paths", lambda e: """select company, surname, given, role from (
    select company, 'Board' || company as surname, 'Ann' as given, 'reprezentacja: PREZES' as role from companies union all select company, 'Second|Part', 'Bo', 'reprezentacja' from companies where company % 2 = 0
    union all select company, 'Proxy' || company, 'Cy', 'prokurent: SAMOISTNA' from companies where company % 3 = 0 union all select company, 'Single', 'Di', 'jedyny_akcjonariusz' from companies where company % 5 = 0
    union all select company, 'Closer', 'Ed', 'likwidator' from companies where company % 7 = 0) x where company % 11 <> 0""")
def f50(t):
    return register.register_people(_records(t), "record").select("company", "surname", "given", "role")


def _records(t):
    """Register answers: people on several of the declared paths and on one that isn't, companies among them, and answers
    that are no extract."""
    c = F.col("company")

    def person(surname, given, second=None, **more):
        name = F.struct(surname.alias("nazwiskoICzlon"), F.lit(second).cast("string").alias("nazwiskoIICzlon"))
        return F.struct(name.alias("nazwisko"), F.struct(F.lit(given).alias("imie")).alias("imiona"), *(F.lit(v).cast("string").alias(k) for k, v in more.items()))

    board = F.array(person(F.concat(F.lit("Board"), c.cast("string")), "Ann", funkcjaWOrganie="PREZES"), F.when(c % 2 == 0, person(F.lit("Second"), "Bo", "Part", funkcjaWOrganie="")))
    firm = F.array(F.struct(F.lit("Firm").alias("nazwa"), F.lit("1").alias("krs")))
    body = F.struct(
        F.struct(firm.alias("wspolnicySpzoo"), F.when(c % 5 == 0, person(F.lit("Single"), "Di")).alias("jedynyAkcjonariusz")).alias("dzial1"),
        F.struct(F.struct(board.alias("sklad")).alias("reprezentacja"), F.when(c % 3 == 0, F.array(person(F.concat(F.lit("Proxy"), c.cast("string")), "Cy", rodzajProkury="SAMOISTNA"))).alias("prokurenci")).alias("dzial2"),
        F.struct(F.when(c % 4 == 0, F.array(person(F.lit("New"), "Gus"))).alias("nowyOrgan")).alias("dzial3"),
        F.struct(F.when(c % 7 == 0, F.struct(F.array(person(F.lit("Closer"), "Ed")).alias("likwidatorzy"))).alias("likwidacja")).alias("dzial6"),
    )
    whole = F.to_json(F.struct(F.struct(body.alias("dane")).alias("odpis")))
    return t["companies"].select("company", F.when(c % 11 == 0, F.lit('{"status": 404}')).otherwise(whole).alias("record"))


@query("f50_unread_paths", lambda e: "select 'dzial3.nowyOrgan[]' as path, count(*) as n from companies where company % 4 = 0 and company % 11 <> 0 having count(*) > 0")
def f50_unread(t):
    return register.unread(_records(t), "record")


_ARTICLES = """select id, case id % 4 when 0 then 'Intro {{Polityk infobox | imię i nazwisko = ' || full_name || ' | data urodzenia = 3 maja ' || birth_year || ' | partia = [[Party A|A]] {{x|y}} }} text' when 1 then '{{Firma infobox|nazwa=F|rejestr=KRS|numer rejestru=' || id || '|udziałowcy=[[Skarb Państwa]], [[Miasto]]}}'
    when 2 then '{{Przedsiębiorstwo infobox|rejestr=KRS|udziałowcy=osoby fizyczne}}' else 'No box [[Skarb Państwa]]' end as wiki, birth_year from wiki_people"""


@query("f51_content_score", lambda e: f"""select id, case id % 4 when 0 then 'person' when 1 then 'company' when 2 then 'company' end as about, case when id % 4 = 0 then birth_year || '-05-03' end as birth, case id % 4 when 0 then 'A {{{{x|y}}}}' end as party,
    case id % 4 when 1 then 'Skarb Państwa|Miasto' else '' end as owners, case id % 4 when 2 then 'osoby fizyczne' end as owner_text, case id % 4 when 0 then 1 when 1 then 2 when 2 then 1 else 0 end as score from ({_ARTICLES}) x""")
def f51(t):
    return register.infoboxes(t.sql(_ARTICLES).select("id", "wiki"), "wiki", ("Party A", "Skarb Państwa")).select("id", "about", "birth", "party", F.coalesce(F.array_join("owners", "|"), F.lit("")).alias("owners"), "owner_text", "score")


both("f52_narrative", lambda e: f"select person, {e.join(e.list('cast(start_date as string) || ' + chr(39) + ' company ' + chr(39) + ' || cast(company as string)'), '; ')} as career, min({e.days('start_date', 'end_date')}) as shortest from posts group by person")
both("f53_region_levels", lambda e: "select id, kind, coalesce(parent, 'PL') as parent, cast(case kind when 'region' then 1 when 'county' then 2 else 3 end as bigint) as level from region_nodes")
both("t11_collated_sort", lambda e: f"select name, cast(row_number() over (order by {'name collate pl' if e.name == 'spark' else 'name collate pl'}) as bigint) as pos from (select 'łata' as name union all select 'lato' union all select 'mak' union all select 'zebra' union all select 'żaba' union all select 'ala' union all select 'ąę') x")
