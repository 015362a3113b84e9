import numpy as np

from tessera.llm.simhash import bucket_links, duplicates, fingerprint, keep_one, near_duplicates, similarity, sketch

from .data import BASE, DOCS, frame, sentence


def brute(rows):
    fps = [fingerprint(t) for _, t, _ in rows]
    comp = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    least = {c: min((i for (i, _, _), k in zip(rows, comp) if k == c and i is not None), default=None) for c in comp}
    return sorted((str(i), np.uint64(f).astype(np.int64).item(), least[c]) for (i, _, _), f, c in zip(rows, fps, comp))


def test_components_match_brute_force(spark):
    words = BASE.split()
    near = [(100 + i, " ".join([*words[:i], "changed", *words[i + 1 :]]), "n") for i in range(0, 110, 4)]
    rows = [*DOCS, *near, *((200 + i, sentence(50 + i, 40), "z") for i in range(30))]
    got = sorted((str(r.doc_id), r.fp, r.component_id) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).collect() == []


def test_all_links_within_radius_are_found():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(centre.tolist())
    for c in centre.tolist():
        for n in range(1, 6):
            fps.add(c ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    fps = np.array(sorted(fps), np.uint64)
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {int(f): i for i, f in enumerate(fps)}
    for prefix in (2, 5):
        up[:] = range(len(fps))
        for b in range(1 << prefix):
            for x, y in zip(*bucket_links(fps, b, prefix)):
                assert (int(x) ^ int(y)).bit_count() <= 4 * len(fps)
                up[find(where[int(x)])] = find(where[int(y)])
        for i in range(len(fps)):
            for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
                assert find(i) == find(int(j))


def jaccard(a, b, width=5):
    runs = lambda t: {tuple(w[i : i + width]) for w in [t.lower().split()] for i in range(max(1, len(w) - width + 1))}
    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y)


def test_sketch_estimates_similarity():
    for n in (0, 1, 3, 6):
        w = sentence(7, 400).split()
        for i in range(n):
            w[30 + 50 * i] = "changed"
        a, b = sentence(7, 400), " ".join(w)
        assert abs(similarity(sketch(a), sketch(b)) - jaccard(a, b)) < 0.07
    assert similarity(sketch(""), sketch(None)) == 1.0


def test_keep_one_of_near_copies(spark):
    rows = [*DOCS]
    for g in range(8):
        base = sentence(100 + g, 150 + 40 * g).split()
        for k in range(6):
            w = list(base)
            w[17 + k] = "edited"
            rows.append((1000 + 10 * g + k, " ".join(w), "g"))
    rows += [(2000 + i, sentence(500 + i, 60), "alone") for i in range(40)]
    kept = keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    ids = sorted((str(r.doc_id), r.text) for r in kept.collect())
    want = {str(i) for i in [1, 4, 7, 8, 9, 10, None, 11, 12, *range(1000, 1080, 10), *range(2000, 2040)]}
    got = [i for i, _ in ids]
    assert len(got) == len(set(got))
    # "\t\n " has no words either but differs from the empty text: its sketch is the same, so it goes with doc 4.
    assert set(got) == want
    assert keep_one(frame(spark, [])).collect() == []


def test_appended_and_replaced_passages_are_found(spark):
    """Other words in one place move many bits of a SimHash of words."""
    rows = []
    for g in range(40):
        base = sentence(3000 + g, 400).split()
        other = sentence(4000 + g, 60).split()
        edited = base + other if g % 2 else base[:150] + other[:30] + base[180:]
        assert jaccard(" ".join(base), " ".join(edited)) > 0.82
        rows += [(2 * g, " ".join(base), "g"), (2 * g + 1, " ".join(edited), "g")]
    got = {(r.doc_id, r.root) for r in duplicates(frame(spark, rows)).collect()}
    assert got == {(2 * g + 1, 2 * g) for g in range(40)}


def test_leaves_of_a_failed_star_are_compared(spark):
    """Each group of minima that two near copies share holds a smaller id below the threshold to both."""
    rows, pairs = [], set()
    for g in range(6):
        base = sentence(5000 + g, 300).split()
        for v in range(60):
            at = 4 * v
            rows.append((1000 * g + v, " ".join(base[:at] + sentence(6000 + 60 * g + v, 60).split() + base[at + 60 :]), "g"))
        other = base[:120] + sentence(9000 + g, 22).split() + base[142:]
        assert jaccard(rows[-1][1], " ".join(base)) < 0.7 and jaccard(" ".join(base), " ".join(other)) > 0.82
        rows += [(1000 * g + 100, " ".join(base), "g"), (1000 * g + 101, " ".join(other), "g")]
        pairs.add((1000 * g + 101, 1000 * g + 100))
    got = {(r.doc_id, r.root) for r in duplicates(frame(spark, rows)).collect()}
    assert {p for p in got if p[0] % 1000 > 99} == pairs


def test_pairs_about_the_threshold_are_compared_exactly(spark):
    """Similarities within a sketch's error of 0.8 on both sides."""
    rows, want = [], set()
    for g in range(60):
        base = sentence(7000 + g, 404).split()
        n = 40 + g % 10
        other = base[: 404 - n] + sentence(8000 + g, n).split()
        rows += [(2 * g, " ".join(base), "g"), (2 * g + 1, " ".join(other), "g")]
        if jaccard(rows[-1][1], rows[-2][1]) >= 0.8:
            want.add((2 * g + 1, 2 * g))
    assert 10 < len(want) < 50
    assert {(r.doc_id, r.root) for r in duplicates(frame(spark, rows)).collect()} == want


def test_keep_one_with_repeated_ids_and_clashing_names(spark):
    """Rows that repeat an id with other texts: the same one stays, however the rows are dealt out."""
    from pyspark.sql import functions as F

    rows = [(i % 20, sentence(300 + i, 50), f"s{i}") for i in range(60)] + [(100 + i, sentence(300 + i, 50) + " end", "late") for i in range(60)]
    df = frame(spark, rows).withColumn("_gone", F.lit("own")).withColumn("_n", F.lit(1))
    pick = lambda d: sorted((r.doc_id, r.text, r.source, r._gone) for r in keep_one(d).collect())
    got = pick(df)
    assert got == pick(df.repartition(7)) and len({r[0] for r in got}) == len(got)
    # The 20 texts that stay for their ids lose their copies; the other 40 texts are only in the late rows.
    assert len(got) == 20 + 40 and all(r[3] == "own" for r in got)


def test_flagged_never_misses(spark):
    from tessera.llm.common import flagged

    df = spark.range(0, 5000).selectExpr("id", "'x' as _at").union(spark.createDataFrame([(None, "n")], "id long, _at string"))
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "i")
    rows = flagged(df, "id", ids, "i", "may").collect()
    assert len(rows) == 5001 and rows[0]._at == "x"
    assert all(r.may for r in rows if r.id is not None and r.id % 7 == 0) and sum(r.may for r in rows) < 800
    assert not any(r.may for r in flagged(df, "id", ids.limit(0), "i", "may").collect())


def test_no_stage_has_a_branch_for_each_hash_function(spark):
    """The driver holds the tasks and metrics of a stage: their number must not grow with the functions."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in names}
    sc = spark.sparkContext
    sc.setJobGroup("tasks", "tasks of duplicates()")
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        base = sentence(1, 80)
        rows = [(i, sentence(i, 80) if i > 5 else f"{base} {i}", "s") for i in range(20)]
        assert {(r.doc_id, r.root) for r in duplicates(frame(spark, rows)).collect()} == {(i, 0) for i in range(1, 6)}
        status = sc.statusTracker()
        infos = [status.getStageInfo(s) for j in status.getJobIdsForGroup("tasks") for s in status.getJobInfo(j).stageIds]
        assert max(i.numTasks for i in infos if i) <= 4 * 7
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc._jsc.clearJobGroup()
