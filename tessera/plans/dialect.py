"""One query text for two engines: the few functions that Spark SQL and DuckDB spell differently."""

from __future__ import annotations


class Spark:
    name = "spark"

    def days(self, a, b):
        """Days from a to b."""
        return f"cast(datediff({b}, {a}) as bigint)"

    def rx_replace(self, s, p, r):
        return f"regexp_replace({s}, r'{p}', '{r}')"

    def rx_group(self, s, p, g):
        return f"regexp_extract({s}, r'{p}', {g})"

    def rx(self, s, p):
        return f"({s} rlike r'{p}')"

    def set(self, x):
        return f"array_sort(collect_set({x}))"

    def list(self, x):
        return f"array_sort(collect_list({x}))"

    def size(self, x):
        return f"cast(size({x}) as bigint)"

    def array(self, *xs):
        return f"array({', '.join(xs)})"

    def split(self, s, d):
        return f"split({s}, r'{d}')"

    def json(self, s, k):
        return f"get_json_object({s}, '$.{k}')"

    def unnest(self, a, name="x", alias="u"):
        return f"lateral view explode({a}) {alias} as {name}"

    def filter(self, a, var, cond):
        return f"filter({a}, {var} -> {cond})"

    def map(self, a, var, expr):
        return f"transform({a}, {var} -> {expr})"

    def sorted(self, a):
        return f"array_sort({a})"

    def distinct(self, a):
        return f"array_sort(array_distinct({a}))"

    def join(self, a, sep):
        return f"array_join({a}, '{sep}')"

    def text(self, a, expr="z"):
        """A list as text, its elements (z) by an expression; the form in which results hold lists."""
        return self.join(self.map(a, "z", f"cast({expr} as string)"), ",")

    def sha256(self, s):
        return f"sha2({s}, 256)"

    def at(self, a, i):
        """1-based; null past the end."""
        return f"get({a}, {i} - 1)"

    def overlap(self, a, b):
        return f"arrays_overlap({a}, {b})"

    def seq(self, a, b):
        return f"sequence({a}, {b})"

    def days_seq(self, a, b):
        return f"sequence({a}, {b}, interval 1 day)"

    def try_date(self, s):
        return f"try_cast({s} as date)"

    def concat(self, *xs):
        return f"concat({', '.join(xs)})"

    def starts(self, s, p):
        return f"startswith({s}, {p})"

    def contains(self, s, p):
        return f"contains({s}, {p})"

    def instr(self, s, p):
        return f"cast(instr({s}, {p}) as bigint)"

    def struct(self, **kw):
        return "struct(" + ", ".join(f"{v} as {k}" for k, v in kw.items()) + ")"

    def except_(self, a, b):
        return f"array_sort(array_except({a}, {b}))"

    def intersect(self, a, b):
        return f"array_sort(array_intersect({a}, {b}))"

    def union(self, a, b):
        return f"array_sort(array_union({a}, {b}))"

    def lower_hex(self, x):
        return f"lower(hex({x}))"

    def drop(self, *cols):
        return f"* except ({', '.join(cols)})"

    def plus_days(self, d, n):
        return f"date_add({d}, {n})"

    def minute(self, ts):
        return f"date_format(date_trunc('minute', {ts}), 'yyyy-MM-dd HH:mm')"

    def dow(self, d):
        """1 Monday to 7 Sunday."""
        return f"cast(weekday({d}) + 1 as bigint)"


class Duck(Spark):
    name = "duckdb"

    def days(self, a, b):
        return f"date_diff('day', cast({a} as date), cast({b} as date))"

    def rx_replace(self, s, p, r):
        return f"regexp_replace({s}, '{p}', '{r.replace('$', chr(92))}', 'g')"

    def rx_group(self, s, p, g):
        return f"regexp_extract({s}, '{p}', {g})"

    def rx(self, s, p):
        return f"regexp_matches({s}, '{p}')"

    def set(self, x):
        return f"coalesce(list_sort(list(distinct {x}) filter (where {x} is not null)), [])"

    def list(self, x):
        return f"coalesce(list_sort(list({x}) filter (where {x} is not null)), [])"

    def size(self, x):
        return f"len({x})"

    def array(self, *xs):
        return f"[{', '.join(xs)}]"

    def split(self, s, d):
        return f"string_split_regex({s}, '{d}')"

    def json(self, s, k):
        return f"json_extract_string({s}, '$.{k}')"

    def unnest(self, a, name="x", alias="u"):
        return f", lateral (select unnest({a}) as {name}) {alias}"

    def filter(self, a, var, cond):
        return f"list_filter({a}, lambda {var}: {cond})"

    def map(self, a, var, expr):
        return f"list_transform({a}, lambda {var}: {expr})"

    def sorted(self, a):
        return f"list_sort({a})"

    def distinct(self, a):
        return f"list_sort(list_distinct({a}))"

    def join(self, a, sep):
        return f"array_to_string({a}, '{sep}')"

    def sha256(self, s):
        return f"sha256({s})"

    def at(self, a, i):
        return f"list_extract({a}, {i})"

    def overlap(self, a, b):
        return f"list_has_any({a}, {b})"

    def seq(self, a, b):
        return f"range({a}, {b} + 1)"

    def days_seq(self, a, b):
        return f"list_transform(range(cast({a} as timestamp), cast({b} as timestamp) + interval 1 day, interval 1 day), lambda x: cast(x as date))"

    def starts(self, s, p):
        return f"starts_with({s}, {p})"

    def instr(self, s, p):
        return f"instr({s}, {p})"

    def struct(self, **kw):
        return "{" + ", ".join(f"'{k}': {v}" for k, v in kw.items()) + "}"

    def except_(self, a, b):
        return f"list_sort(list_filter({a}, lambda z: not list_contains({b}, z)))"

    def intersect(self, a, b):
        return f"list_sort(list_intersect({a}, {b}))"

    def union(self, a, b):
        return f"list_sort(list_distinct(list_concat({a}, {b})))"

    def drop(self, *cols):
        return f"* exclude ({', '.join(cols)})"

    def plus_days(self, d, n):
        return f"cast({d} + {n} * interval 1 day as date)"

    def minute(self, ts):
        return f"strftime(date_trunc('minute', {ts}), '%Y-%m-%d %H:%M')"

    def dow(self, d):
        return f"isodow({d})"


SPARK, DUCK = Spark(), Duck()
