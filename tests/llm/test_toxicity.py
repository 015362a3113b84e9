import math
import random

from pyspark.sql import functions as F

from tessera.llm.toxicity import COST, Model, passages, score, score_text, segments, train

from .data import DOCS, frame


def brute(words, weights, cost):
    """Maximal-scoring segments by definition: take the best (shortest, leftmost), then left and right of it."""
    s = [weights.get(w, -cost) for w in words]

    def best(a, b):
        top = None
        for i in range(a, b):
            t = 0.0
            for j in range(i, b):
                t += s[j]
                if t > 1e-9 and (top is None or (t, i - j) > (top[0] + 1e-9, top[1])):
                    top = (t, i - j, i, j + 1)
        return [] if top is None else best(a, top[2]) + [(top[2], top[3], top[0])] + best(top[3], b)

    return best(0, len(s))


def test_segments_are_the_maximal_ones():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice(["a", "b", "x", "y"]) for _ in range(rng.randint(0, 30))]
        weights = {"a": 1.25, "b": 2.75}
        got = [(a, b, round(s, 6)) for a, b, s in segments(words, weights, 0.9)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute(words, weights, 0.9)]


def test_score_by_definition():
    """Evidence is what the maximal segments exceed their expectation in clean text by, through the logistic curve."""
    rng = random.Random(9)
    # Weights that no number of other words makes up for exactly: which of two equal segments counts is another matter.
    vile, nast = math.pi, math.sqrt(3.3)
    model = Model({"vile": vile, "nasty": 1.5, "nast*": nast}, (0.8, 0.05), (-2.0, 1.1))
    weight = {"vile": vile, "nasty": nast, "nastier": nast, "nast": 0.0, "calm": 0.0, "day": 0.0}
    seen = set()
    for _ in range(200):
        words = rng.choices(list(weight), [1, 1, 1, 2, 4, 4], k=rng.randint(0, 40))
        named = {w: x for w, x in weight.items() if x}
        x = sum(max(0.0, 0.8 * s - math.log(0.05 * max(1, len(words)))) for _, _, s in brute(words, named, COST))
        assert abs(score_text(words, model) - 1 / (1 + math.exp(2.0 - 1.1 * x))) < 1e-9 or x > 25
        seen.add(x > 0)
    assert seen == {True, False}


def corpus():
    rng = random.Random(4)
    plain = [f"w{rng.randint(0, 400)}x" for _ in range(400)]
    rows = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 200))]
        toxic = i % 6 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(["vile", "rotten", "scumbag", "nastyish", "nastyful"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_and_passages(spark):
    rows = corpus()
    docs = frame(spark, [(i, t, "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(5000, 1), (None, 1), (1, None)], "doc_id long, y int")
    model = train(docs, labels)
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 5 == 0]
    assert sum((s >= 0.7) == y for s, y in held) >= 0.97 * len(held)
    found = {r.doc_id for r in passages(docs, model).collect()}
    assert len({i for i, _, y in rows if y} & found) > 140 and len(found) < 160
    assert train(docs, labels) == model


def test_awkward_rows(spark):
    model = Model({"vile": 3.0}, (2.0, 0.001), (-3.0, 1.0))
    out = score(frame(spark, [*DOCS, (77, "VILE, vile.", "z")]), model)
    got = {str(r.doc_id): r.score for r in out.collect()}
    assert got["4"] == got["5"] == got["6"] and got["77"] > 0.7 and all(0 <= s <= 1 for s in got.values())
    assert score(frame(spark, []), model).collect() == []
    one = train(frame(spark), spark.createDataFrame([(1, 0)], "doc_id long, y int"))
    assert {r.score < 0.01 for r in score(frame(spark), one).collect()} == {True}
    assert passages(frame(spark), model).where(F.col("first") >= 0).count() == 0
