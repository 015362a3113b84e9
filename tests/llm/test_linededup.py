import hashlib

from tessera.llm.linededup import dedup_lines

from .data import DOCS, frame

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BLANKS))
    held = {}
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(held.get(key(x), ())) < 3 or max(held[key(x)]) == i]
        out.append((str(i), len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def test_matches_brute_force(spark):
    rows = [*DOCS, *((300 + i, f"common line that many documents hold\nown {i} line of this one document", "h") for i in range(40))]
    got = dedup_lines(frame(spark, rows))
    assert "source" in got.columns and got.schema["n_lines"].dataType.simpleString() == "bigint"
    found = sorted((str(r.doc_id), r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect())
    assert found == brute(rows)
    assert sum(r[2] for r in found) > 40


def test_empty_table(spark):
    assert dedup_lines(frame(spark, [])).collect() == []


def test_own_names_of_the_operator_pass_through(spark):
    from pyspark.sql import functions as F

    df = frame(spark)
    for name in ("_gone", "_gone_id", "__id"):
        df = df.withColumn(name, F.lit(name))
    got = dedup_lines(df).collect()
    assert len(got) == len(DOCS) and all(r[n] == n for r in got for n in ("_gone", "_gone_id", "__id"))
