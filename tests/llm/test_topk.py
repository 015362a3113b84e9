import math

from pyspark.sql import functions as F

from tessera.llm import topk


def brute(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 20 == 0}):
        mine = min(v for i, v in ok if i == q)
        s = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in ok if i != q)[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 5)
    rows = [(i, [math.sin(i * 7 + j * j) / 2 for j in range(16)]) for i in range(300)]
    rows += [(301 + i, rows[20][1]) for i in range(30)]  # ties
    rows += [(20, rows[20][1]), (400, None), (401, [None] * 16), (402, [float("nan")] * 16), (403, [float("inf")] * 16), (None, rows[1][1]), (420, []), (440, [0.3, -0.2])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, query_id string").repartition(6)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    for k in (1, 20):
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=k).collect())) == brute(rows, k)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [0.5]), (1, [1.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0).collect())) == [(0, 1, 1, 32 * 64)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
