"""What public registers and encyclopedias say, read from their own formats: people in a register's JSON, infoboxes,
kinds of bodies, lines of facts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the register's format: section, part, inner part, what a person there is, and the field that says more.
PERSON_PATHS = (
    ("dzial1", "wspolnicySpzoo", None, "wspolnik", ""),
    ("dzial1", "wspolnicyPartnerzy", None, "wspolnik_partner", ""),
    ("dzial1", "komitetZalozycielski", None, "komitet_zalozycielski", ""),
    ("dzial1", "jedynyAkcjonariusz", None, "jedyny_akcjonariusz", ""),
    ("dzial2", "reprezentacja", "sklad", "reprezentacja", "funkcjaWOrganie"),
    ("dzial2", "organNadzoru", "sklad", "nadzor", "funkcjaWOrganie"),
    ("dzial2", "prokurenci", None, "prokurent", "rodzajProkury"),
    ("dzial2", "pelnomocnicy", None, "pelnomocnik", ""),
    ("dzial2", "osobyReprezentujacePZ", None, "osoba_pz", ""),
    ("dzial2", "reprezentacjaIBIGBPPSPZOZ", None, "kierownik_pzoz", ""),
    ("dzial5", "kurator", None, "kurator", ""),
    ("dzial6", "likwidacja", "likwidatorzy", "likwidator", ""),
    ("dzial6", "postepowanieUpadlosciowe", "daneSyndyka", "syndyk", ""),
    ("dzial6", "postepowanieUpadlosciowe", "daneOsobyReprezentujacejUpadlego", "reprezentant_upadlego", ""),
    ("dzial6", "zarzadKomisarycznyPrzymusowyPowierzenieZarzadzania", "zarzadcyPrzedstawiciele", "zarzadca_komisaryczny", ""),
    ("dzial6", "postepowanieRestrukturyzacyjneNaprawczePrzymusowaRestrukturyzacja", "nadzorcaZarzadcaReprezentujacyAdministratorPelnomocnik", "nadzorca_restrukturyzacyjny", ""),
    ("dzial6", "postepowanieRestrukturyzacyjneNaprawczePrzymusowaRestrukturyzacjaUporzadkowanaLikwidacja", "nadzorcaZarzadcaReprezentujacyAdministratorZastepcaPelnomocnikZarzadcaNadzwyczajny", "nadzorca_restrukturyzacyjny", ""),
)
SURNAME_PARTS = ("nazwiskoICzlon", "nazwiskoIICzlon")


def _under(x, key: str) -> Iterator:
    """What stands under a key of an object, one by one: a list's elements, or the one thing."""
    got = x.get(key) if isinstance(x, dict) else None
    yield from got if isinstance(got, list) else [got] if isinstance(got, dict) else []


def _field(x, part: str, key: str) -> str:
    box = x.get(part)
    return str(box.get(key) or "") if isinstance(box, dict) else ""


def _body(record: str | None) -> dict:
    try:
        data = json.loads(record or "")
        found = data["odpis"]["dane"]
    except (ValueError, KeyError, TypeError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def people_of(record: str | None) -> list[dict]:
    """The people that a register's answer names on the declared paths, once each; none for any other answer."""
    body, seen = _body(record), set()
    for section, part, inner, role, more in PERSON_PATHS:
        entries = _under(body.get(section), part)
        for e in (x for c in entries for x in _under(c, inner)) if inner else entries:
            if not isinstance(e, dict):
                continue
            surname = "|".join(s for k in SURNAME_PARTS if (s := _field(e, "nazwisko", k)))
            one = (surname, _field(e, "imiona", "imie"), _field(e, "imiona", "imieDrugie"), _field(e, "identyfikator", "pesel"), _field(e, "identyfikator", "dataUrodzenia"))
            if any((surname, one[1], one[3], one[4])):
                detail = str(e.get(more) or "") if more else ""
                seen.add((*one, f"{role}: {detail}" if detail else role))
    return [dict(zip(("surname", "given", "second_given", "pesel", "born", "role"), p)) for p in sorted(seen)]


def unread_paths(record: str | None) -> list[str]:
    """Places in an answer where a person stands that no declared path reads."""
    parts = {(s, p) for s, p, *_ in PERSON_PATHS}
    found: set[str] = set()
    todo = [(v, k, (k,)) for k, v in _body(record).items()]
    while todo:
        x, name, keys = todo.pop()
        if isinstance(x, list):
            todo += [(y, f"{name}[]", keys) for y in x]
        elif isinstance(x, dict):
            if isinstance(x.get("nazwisko"), dict) or isinstance(x.get("imiona"), dict):
                if keys[:2] not in parts:
                    found.add(name)
            else:
                todo += [(v, f"{name}.{k}", (*keys, k)) for k, v in x.items()]
    return sorted(found)


def register_people(df: DataFrame, record: str) -> DataFrame:
    """df's first column with a row for each person of its record (a JSON text)."""
    key = df.columns[0]
    names = ["surname", "given", "second_given", "pesel", "born", "role"]

    def run(batches):
        for b in batches:
            rows = [(i, p) for i, r in zip(b.column(key).to_pylist(), b.column(record).to_pylist()) for p in people_of(r)]
            yield pa.record_batch([pa.array([i for i, _ in rows], b.schema.field(key).type), *(pa.array([p[n] for _, p in rows], pa.string()) for n in names)], names=[key, *names])

    return df.select(key, record).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} string" for n in names))


def unread(df: DataFrame, record: str) -> DataFrame:
    """(path, n): places that no declared path reads, with how many records have them."""

    def run(batches):
        for b in batches:
            paths = [p for r in b.column(record).to_pylist() for p in unread_paths(r)]
            yield pa.record_batch([pa.array(paths, pa.string())], names=["path"])

    return df.select(record).mapInArrow(run, "path string").groupBy("path").agg(F.count("*").alias("n"))


# --- encyclopedia

#: Months as names and in the genitive, and what makes a date too vague to keep.
MONTH_NAMES = ("styczeń", "luty", "marzec", "kwiecień", "maj", "czerwiec", "lipiec", "sierpień", "wrzesień", "październik", "listopad", "grudzień")
VAGUE = ("n.e", "(", "ok.", "lub", "/", "przed", "ochrz.", "między")
PERSON_BOXES = ("Biogram", "Polityk", "Naukowiec", "Duchowny", "Artysta", "Sportowiec", "Pisarz", "Dziennikarz", "Menedżer")


def infobox_date(c: Column) -> Column:
    """An infobox's date as ISO text, 00 for a day or month that it doesn't tell; null where it is vague or none."""
    from tessera.functions.ids import MONTHS

    s = F.regexp_replace(F.regexp_replace(c, r"\[|\]|\{\{data\||\}\}", ""), r"(?s)<ref.*$", "")
    s = F.regexp_replace(s, r"(?s) r\..*$", "")
    vague = F.lit(False)
    for v in VAGUE:
        vague = vague | F.contains(s, F.lit(v))
    month = lambda names, word: F.array_position(F.array(*map(F.lit, names)), word)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    part = lambda p, g: F.regexp_extract(s, p, g)
    full, half = r"(?U)^(\d+) (\w+) (\d{4})$", r"(?U)^(\w+) (\d{4})$"
    day_month, alone = month(MONTHS, part(full, 2)), month(MONTH_NAMES, part(half, 1))
    return (
        F.when(vague, None)
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s)
        .when(s.rlike(full), F.when(day_month > 0, F.concat_ws("-", part(full, 3), two(day_month), two(part(full, 1).cast("int")))))
        .when(s.rlike(half), F.when(alone > 0, F.concat_ws("-", part(half, 2), two(alone), F.lit("00"))))
        .when(s.rlike(r"^\d+$"), F.concat(s, F.lit("-00-00")))
    )


_box = re.compile(r"\{\{\s*([^{}|]*?)\s+infobox\s*\|")
_link = re.compile(r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]")


def infobox(wiki: str | None) -> tuple[str, dict[str, str], dict[str, list[str]]] | None:
    """(kind, fields, links of fields) of a text's first infobox; braces and links within values are kept together."""
    text = wiki or ""
    m = _box.search(text)
    if not m:
        return None
    parts, depth, start, i = [], 0, m.end(), m.end()
    while i < len(text):
        two = text[i : i + 2]
        if two in ("{{", "[["):
            depth, i = depth + 1, i + 2
        elif two in ("}}", "]]") and depth:
            depth, i = depth - 1, i + 2
        elif two == "}}" or text[i] == "|" and not depth:
            parts.append(text[start:i])
            i += 1
            start = i
            if two == "}}":
                break
        else:
            i += 1
    fields, linked = {}, {}
    for p in parts:
        name, eq, value = p.partition("=")
        if eq:
            linked[name.strip()] = [a.strip() for a, _ in _link.findall(value)]
            fields[name.strip()] = _link.sub(lambda x: x[2] or x[1], value).strip()
    return m[1], fields, linked


INFOBOX = "kind string, about string, birth string, party string, owners array<string>, owner_text string, score int"


def infoboxes(df: DataFrame, wiki: str, subject: Sequence[str] = (), keyword: str = "udziałowcy") -> DataFrame:
    """df's first column with what its text's infobox says, and a score: links into subject, and one more where the owners'
    field is filled."""
    key = df.columns[0]
    wanted = frozenset(subject)

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(wiki).to_pylist():
                kind, fields, linked = infobox(t) or (None, {}, {})
                person = "imię i nazwisko" in fields or "polityk" in fields or "osoba" in fields or kind in PERSON_BOXES
                company = "rejestr" in fields
                about = None if person == company else "person" if person else "company"
                owners = linked.get(keyword, [])
                score = len(wanted & {x for v in linked.values() for x in v}) + bool(fields.get(keyword))
                out.append((kind, about, fields.get("data urodzenia", ""), fields.get("partia"), owners, None if owners else fields.get(keyword) or None, score))
            kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.string(), pa.int32()]
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.record_batch([b.column(key), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[key, "kind", "about", "birth", "party", "owners", "owner_text", "score"])

    read = df.select(key, wiki).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {INFOBOX}")
    return read.withColumn("birth", F.when(F.col("birth") != "", infobox_date(F.col("birth"))))


# --- kinds of bodies

#: Fixed values: (kind, beginnings of activity codes, pattern of names), in the order in which they are tried; names of
#: civil partnerships, of forms that the court register holds, and of budget units.
KINDS = (
    (
        "health",
        ("86.", "87.", "21."),
        r"SZPITAL|PRZYCHODNIA|ZAK[ŁL]AD[ÓO]?W? (OPIEKI ZDROWOTNEJ|LECZNICTWA)|SPZ[OZ]|\bZOZ\b|NZOZ|CENTRUM MEDYCZNE|MEDYCZN|HOSPICJUM|SANATORIUM|UZDROWISKO|KRWIODAWSTWA|APTEKA|STOMATOLOG|REHABILITAC",
    ),
    (
        "utilities",
        ("35.", "36.", "37.", "38.", "39.", "49.3"),
        r"WODOCI[ĄA]G|KANALIZAC|CIEP[ŁL]OWN|ENERGETYK|GOSPODARKI KOMUNALNEJ|GOSPODARKA KOMUNALNA|OCZYSZCZANIA|ZAK[ŁL]AD KOMUNALNY|USŁUG KOMUNALNYCH|\bMPK\b|\bPKS\b|\bMPWIK\b|\bPEC\b|KOMUNIKACJI MIEJSKIEJ|WODNO-KANALIZAC",
    ),
    ("associations", ("94.", "88."), r"STOWARZYSZ|FUNDACJ|OCHOTNICZA STRA[ŻZ]|\bOSP\b|\bKLUB\b|ZWI[ĄA]ZEK|KO[ŁL]O GOSPOD|PARAFIA|CARITAS|POLSKI CZERWONY KRZY[ŻZ]"),
    (
        "events",
        ("82.3", "90.", "93.", "79.", "55.", "56.", "59.", "73.1"),
        r"AGENCJA ARTYSTYCZNA|IMPREZ|KONCERT|FESTIWAL|\bTARGI\b|\bEVENT|ROZRYWK|ARTYSTYCZN|CATERING|GASTRONOM|RESTAURACJ|HOTEL\b|NAG[ŁL]O[ŚS]NIEN|SCENOTECHNI|WIDOWISK|ANIMACJ|ESTRAD",
    ),
    ("construction", ("41.", "42.", "43."), r"BUDOWNICTW|BUDOWLAN|\bBUD\b|DROGOW|INSTALAC|REMONT|DEKARS|BRUK"),
)
CIVIL = r"SP[ÓO][ŁL]KA CYWILNA|\bS\.?\s*C\.?\s*$|\bS\.?\s*C\.?[ ,]"
COMPANY = (
    r"SP[ÓO]?[ŁL]KA|SP\.?\s*Z\s*O\.?\s*O|\bZ\s*O\.?\s*O\.?|SP\.?\s*J\b|SP\.?\s*K\b|AKCYJN|\bS\.?\s*A\.?$|FUNDACJ|STOWARZYSZ|SP[ÓO][ŁL]DZIELN|PRZEDSI[ĘE]BIORSTWO PA[ŃN]STWOWE"
    r"|OCHOTNICZA STRA[ŻZ]|\bKLUB\b|ZWI[ĄA]ZEK|IZBA\b|INSTYTUT\b|SPZ[OZ]|SAMODZIELNY PUBLICZNY|ZAK[ŁL]AD[ÓO]?W? (OPIEKI ZDROWOTNEJ|LECZNICTWA)|SZPITAL|CENTRUM KRWIODAWSTWA|TOWARZYSTWO"
    r"|PRZYCHODNIA|HOSPICJUM|SANATORIUM|UZDROWISKO|AGENCJA\b"
)
OFFICE = (
    r"^GMINA|^MIASTO|^URZ[ĄA]D|^POWIAT|^WOJEW[ÓO]DZTWO|^STAROSTWO|SZKO[ŁL]A|PRZEDSZKOLE|ZESP[ÓO][ŁL] SZK|OŚRODEK POMOCY|BIBLIOTEKA|DOM KULTURY|CENTRUM USŁUG|KOMENDA|NADLE[ŚS]NICTWO"
    r"|S[ĄA]D |PROKURATURA|MINISTERSTWO"
)


def kind_of_body(codes: Column, name: Column, budget: Column) -> Column:
    """A body's kind: by its own activity codes (an array), else by its name, the sector before the legal form (a
    municipal company may be filed as a budget unit); what has no form at all is one person's business.

    Names match in any case, words by Unicode letters.  Null codes, names and budget say nothing."""
    n = F.upper(F.coalesce(name, F.lit("")))
    has = lambda pattern: n.rlike(f"(?U){pattern}")
    out = F.when(F.lit(False), F.lit(""))
    for kind, heads, _ in KINDS:
        hit = F.exists(codes, lambda c: F.coalesce(c.rlike("^(" + "|".join(re.escape(h) for h in heads) + ")"), F.lit(False)))
        out = out.when(F.coalesce(hit, F.lit(False)), kind)
    for kind, _, pattern in KINDS:
        out = out.when(has(pattern), kind)
    return out.when(has(CIVIL), "civil").when(has(COMPANY), "private").when(F.coalesce(budget, F.lit(False)) | has(OFFICE), "budget").otherwise("sole")


# --- lines of facts

#: Kinds of facts, and words that show a candidacy instead of a post.
FACT_TYPES = ("employment", "party_membership", "personal_relation", "affair_involvement")
NEEDED = {"employment": ("person", "organization"), "party_membership": ("person", "party"), "personal_relation": ("subject", "object"), "affair_involvement": ("person", "affair")}
CANDIDACY = ("kww", "komitet wyborczy", "kandydat", "wybor", "wyborc")


def fact_lines(answer: Column) -> Column:
    """An answer's facts: an array of maps, one for each line of the form `- kind | key=value | ...`.

    Lines of no known kind are left out, and facts that lack a needed value; an employment that names a candidacy is none."""
    parts = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^[-*] ", ""), r"\|"), lambda p: F.trim(p))
    clean = lambda v: F.regexp_replace(F.trim(v), "^[\"']+|[\"']+$", "")
    kind = lambda ps: F.get(F.filter(F.transform(ps, lambda p: F.lower(p)), lambda p: p.isin(*FACT_TYPES)), 0)
    pairs = lambda ps: F.transform(F.filter(ps, lambda p: F.contains(p, F.lit("="))), lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("k"), clean(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    # The last of equal keys counts.
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda x: x["k"] == e["k"]))
    fact = lambda ps: F.map_concat(F.create_map(F.lit("fact_type"), kind(ps)), F.map_from_entries(F.filter(last(pairs(ps)), lambda e: e["k"] != "fact_type")))

    def whole(m: Column) -> Column:
        ok = F.lit(False)
        filled = lambda k: F.coalesce(F.element_at(m, F.lit(k)), F.lit("")) != ""
        for t, keys in NEEDED.items():
            ok = ok | (F.element_at(m, F.lit("fact_type")) == t) & filled(keys[0]) & filled(keys[1])
        said = F.lower(F.concat_ws(" ", F.element_at(m, F.lit("organization")), F.element_at(m, F.lit("role"))))
        return ok & ~((F.element_at(m, F.lit("fact_type")) == "employment") & said.rlike("|".join(CANDIDACY)))

    lines = F.filter(F.transform(F.split(answer, "\n"), parts), lambda ps: kind(ps).isNotNull())
    return F.filter(F.transform(lines, fact), whole)
