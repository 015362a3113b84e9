"""Small fixtures with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards make toxic brew in cold cellars near old mills".split()


def sentence(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


BASE = sentence(1, 120)
LINE = "This very line is long enough to count"
DOCS = [
    (1, BASE, "a"),
    (2, BASE, "a"),
    (3, BASE + " tail", "b"),
    (3, BASE + " tail", "b"),
    (4, None, None),
    (5, "", "b"),
    (6, " \t\n ", "c"),
    (7, f"{LINE}\nshort\n  {LINE.upper()}\x0b\n" + sentence(3, 30), "c"),
    (8, f"{LINE}\nother", "c"),
    (9, f"x\n{LINE}", None),
    (10, sentence(4, 30_000), "d"),
    (None, f"{LINE}\nno id", "d"),
    (11, "ünï ßtraße 漢字 \U0001f600 don't  stop\r\n\r\n", "d"),
    (12, "a" * 900, "d"),
]
SCHEMA = "doc_id long, text string, source string, size long, fp string, k long, n_lines string"


def frame(spark, rows=DOCS):
    """documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, s, 99, "x", 5, "y") for i, t, s in rows], SCHEMA)
