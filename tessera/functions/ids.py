"""Identifiers, dates, codes and addresses as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The weights of the public check digits.
NIP = (6, 5, 7, 2, 3, 4, 5, 6, 7)
REGON9 = (8, 9, 2, 3, 4, 5, 6, 7)
REGON14 = (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8)
MONTHS = ("stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia")


def _weighted(c: Column, weights: Sequence[int]) -> Column:
    digit = lambda i: F.substring(c, i + 1, 1).cast("int")
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + digit(i) * w
    return total % 11


def _valid(c: Column, weights: Sequence[int], ten_is_zero: bool) -> Column:
    n = len(weights) + 1
    check = _weighted(c, weights)
    check = check % 10 if ten_is_zero else check
    return F.when(c.rlike(f"^[0-9]{{{n}}}$"), check == F.substring(c, n, 1).cast("int")).otherwise(F.lit(False))


def nip_ok(c: Column) -> Column:
    return _valid(c, NIP, False)


def regon_ok(c: Column) -> Column:
    return F.when(F.length(c) == 14, _valid(F.substring(c, 1, 9), REGON9, True) & _valid(c, REGON14, True)).otherwise(_valid(c, REGON9, True))


def zfill(c: Column, n: int) -> Column:
    """Zeros in front up to n characters; longer values stay whole."""
    return F.when(F.length(c) >= n, c).otherwise(F.lpad(c, n, "0"))


def parsed_date(c: Column) -> Column:
    """A date in ISO, dotted or written form; null if it is none."""
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(c, r"\d{1,2}\s+(\S+)\s+\d{4}", 1)))
    written = F.when(month > 0, F.concat_ws("-", F.regexp_extract(c, r"(\d{4})", 1), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(c, r"(\d{1,2})\s", 1), 2, "0")))
    dotted = F.regexp_replace(F.regexp_extract(c, r"^\s*(\d{2}\.\d{2}\.\d{4})", 1), r"(\d{2})\.(\d{2})\.(\d{4})", "$3-$2-$1")
    return F.coalesce(F.to_date(c.try_cast("date")), dotted.try_cast("date"), written.try_cast("date"))


def normal_url(c: Column) -> Column:
    """https where no scheme is given, lower-case host without www., no slash at the end."""
    full = F.when(c.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.trim(c)).otherwise(F.concat(F.lit("https://"), F.trim(c)))
    host = F.regexp_replace(F.lower(F.regexp_extract(full, "://([^/?#]*)", 1)), r"^www\.", "")
    rest = F.regexp_replace(F.regexp_extract(full, "://[^/?#]*(.*)$", 1), "/+$", "")
    return F.concat(F.lower(F.regexp_extract(full, "^([^:]+)", 1)), F.lit("://"), host, rest)


def host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(c, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]+)", 1)), r"^www\.", "")


#: Fixed values of stored paths: bytes a segment may have, digits of its hash, and characters kept free for both.
SEGMENT_BYTES, HASH_DIGITS, MARGIN = 200, 10, 12


def storage_path(url: Column, day: Column, suffix: Column | None = None) -> Column:
    """hostname=.../path/date=...[/suffix] of a page; index for the root.  A segment of too many bytes is cut and ends in
    a part of its hash, so that no file name grows too long."""
    path = F.regexp_replace(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    base = [F.concat(F.lit("hostname="), host(url)), F.when(path == "", F.lit("index")).otherwise(path), F.concat(F.lit("date="), day)]
    whole = F.concat_ws("/", *base, *([suffix] if suffix is not None else []))
    short = lambda p: F.concat(F.substring(p, 1, SEGMENT_BYTES - MARGIN), F.lit("_"), F.substring(F.md5(p.cast("binary")), 1, HASH_DIGITS))
    parts = F.filter(F.split(whole, "/"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.when(F.octet_length(p) > SEGMENT_BYTES, short(p)).otherwise(p)), "/")


def unique_probability(p1: Column, p2: Column, second_matches: Column, n: Column) -> Column:
    """That no other bearer of the last name matches by chance: p1 and p2 are the shares of the first and the second name
    (unknown, or a second name that doesn't match: 1), n the region's bearers (unknown: 50,000), of whom one in 40
    counts.  Few bearers: the power itself; many: its Poisson limit; 0 where the names tell nothing."""
    known = lambda c: F.coalesce(F.nanvl(c, F.lit(1.0)), F.lit(1.0))
    p = known(p1) * F.when(F.coalesce(second_matches, F.lit(False)), known(p2)).otherwise(F.lit(1.0))
    bearers = F.coalesce(n.cast("double"), F.lit(50000.0)) / 40
    return F.when(p == 1, F.lit(0.0)).when(bearers < 50, F.pow(1 - p, bearers)).otherwise(F.exp(-bearers * p))


def odds(x: Column) -> Column:
    """1 / (1 - x), infinite at 1."""
    return F.when(x == 1, F.lit(float("inf"))).otherwise(1 / (1 - x))
