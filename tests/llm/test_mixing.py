from collections import defaultdict

from tessera.llm.mixing import mix, mixture

from .data import DOCS, frame, sentence

ROWS = [*DOCS, *((400 + i, sentence(i, 20 + i % 30), "hot" if i % 2 else f"s{i % 5}") for i in range(400))]


def share(sizes, cap=3):
    """Targets by resharing until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in done]
        left, w = total - sum(done.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > cap * sizes[s]]
        if not over:
            return done | {s: left * weight[s] / w for s in free}
        done |= {s: cap * sizes[s] for s in over}


def test_targets_epochs_and_rest(spark):
    got = mix(frame(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    sizes, taken, target, most = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r.size == len((r.text or "").encode().split())
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r.size)
        assert r.taken <= 3 * r.size
    want = share(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1
    for r in got:
        assert r.copies in (r.epochs, r.epochs + 1) and r.source_size == sizes[r.source]


def test_reruns_agree_and_copies_are_made(spark):
    df = frame(spark, ROWS)
    pick = lambda d: sorted((str(r.doc_id), r.text or "", r.taken) for r in mix(d).collect())
    assert pick(df) == pick(df.repartition(7))
    assert mixture(df).count() == sum(r.copies for r in mix(df).collect()) and mixture(df).columns == df.columns


def test_empty_table(spark):
    assert mix(frame(spark, [])).collect() == []


def test_own_names_of_the_operator_pass_through(spark):
    from pyspark.sql import functions as F

    df = frame(spark, ROWS)
    for name in ("_key", "_range", "_src", "_no_src", "_upto", "_copies", "_sum", "_before"):
        df = df.withColumn(name, F.lit(f"KEEP{name}"))
    for r in mix(df).collect():
        assert all(r[n] == f"KEEP{n}" for n in r.asDict() if n.startswith("_"))
    assert mixture(df).columns == df.columns
