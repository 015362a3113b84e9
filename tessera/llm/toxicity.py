"""Toxic passages by maximum-scoring segments.

Training: the log-odds of words and word beginnings between toxic and clean documents, with a Dirichlet prior (half a
document each, and more for what is frequent everywhere); those whose z-score stands out make the lexicon.  Scoring: a
token in the lexicon has its log-odds, any other a small cost; a linear-time scan finds every maximal-scoring segment.
Segment scores follow an extreme-value law in clean text: with lambda from sum(p * exp(lambda * s)) = 1, a segment of
score S is expected K * n * exp(-lambda * S) times in n tokens.  A document's evidence is the sum over its significant
segments of -log of that number; a logistic curve turns it into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, map_batches

#: Labelled rows that training reads at most, about: a hash of the id picks them where there are more.
SAMPLE = 20_000
#: Lexicon entries at most (highest z first); it is broadcast.
LEXICON = 20_000
MIN_DOCS = 4
MIN_Z = 4.0
PRIOR = 0.5
SPREAD = 0.03  # the prior's share that follows a feature's frequency, of all documents
COST = 0.5
STARTS = (4, 5)

_words = re.compile(r"[^\W\d_]+").findall


class Model(NamedTuple):
    weights: dict[str, float]
    law: tuple[float, float]  # lambda, K
    curve: tuple[float, float]  # intercept, slope


def tokens(text: str | None) -> list[str]:
    return _words((text or "").lower())


def _features(words: set[str]) -> set[str]:
    return words | {f"{w[:n]}*" for w in words for n in STARTS if len(w) > n}


def _weight(get, word: str) -> float:
    """The largest weight among the word's features; beginnings are shorter than the word, as in _features()."""
    n = len(word)
    return max(get(word, 0.0), get(word[:4] + "*", 0.0) if n > 4 else 0.0, get(word[:5] + "*", 0.0) if n > 5 else 0.0)


def segments(words: list[str], weights: dict[str, float], cost: float = COST) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (first token, end, score), in one pass over the tokens.

    Candidates stand on a stack with the total before and after each; a new one is joined to the last whose total
    before it is smaller, if that raises the score."""
    get = weights.get
    stack: list[tuple[int, int, float, float]] = []
    total, at = 0.0, 0
    for i, w in enumerate(words):
        s = _weight(get, w)
        if s <= 0:
            continue
        before = total - cost * (i - at)
        total, at = before + s, i + 1
        first, low, end = i, before, i + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= total:
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, end, low, total))
    return [(a, b, after - before) for a, b, before, after in stack]


def evidence(words: list[str], model_weights: dict[str, float], law: tuple[float, float]) -> float:
    lam, k = law
    n = max(1, len(words))
    return sum(x for _, _, s in segments(words, model_weights) if (x := lam * s - math.log(k * n)) > 0)


def _lexicon(train: DataFrame, n: np.ndarray) -> dict[str, float]:
    """Weights of the features that stand for label 1.  n: documents by label; each document counts a feature once."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = (Counter(), Counter())
        for t, y in zip(batch.column("text"), batch.column("y").to_pylist()):
            both[y].update(_features(set(tokens(t.as_py()))))
        names = list(both[0].keys() | both[1].keys())
        return pa.record_batch([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in both)], names=["name", "clean", "toxic"])

    c = map_batches(train.select("text", "y"), count, "name string, clean long, toxic long").groupBy("name").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    clean, toxic = float(n[0]), float(n[1])
    prior = PRIOR + SPREAD * (F.col("clean") + F.col("toxic"))
    low = lambda col, total: F.log((F.col(col) + prior) / (total * (1 + SPREAD) + clean * SPREAD + 1 - F.col(col)))
    scored = c.where(F.col("toxic") >= MIN_DOCS).withColumn("w", low("toxic", toxic) - low("clean", clean))
    scored = scored.withColumn("z", F.col("w") / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)))
    # A feature that clean documents have nearly as often as toxic ones says little, however sure that is.
    telling = (F.col("z") >= MIN_Z) & (F.col("toxic") / toxic >= 8 * (F.col("clean") + 0.5) / clean)
    return {r.name: min(8.0, r.w) for r in scored.where(telling).orderBy(F.desc("z"), "name").limit(LEXICON).select("name", "w").collect()}


def _law(counts: Counter, total: int, weights: dict[str, float]) -> tuple[float, float]:
    """lambda and K from how often clean text has tokens of each score (rounded); one token of each is added."""
    scores = np.array([-COST, *sorted({round(w, 1) for w in weights.values()})])
    hits = np.array([0.0, *(counts[s] + 1.0 / max(1, len(scores) - 1) for s in scores[1:].tolist())])
    p = hits / (total + 1)
    p[0] = 1 - p.sum()
    lo, hi = 1e-6, 50.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float((p * np.exp(np.minimum(mid * scores, 700))).sum()) < 1 else (lo, mid)
    return lo, max(1e-6, float(p[1:].sum()))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps, with a slight pull of the slope to zero."""
    b = np.zeros(2)
    a = np.stack([np.ones_like(x), x], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (y - p) - np.array([0, 0.01]) * b
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, 0.01])
        step = np.linalg.solve(h, g)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on docs(doc_id, text) with labels(doc_id, y in 0, 1).

    At most about `sample` labelled rows are read, picked by a hash of doc_id; of texts that share the least hash of
    their five-word runs (copies), one counts.  Without both labels the model scores everything 0 (or the one label).
    """
    y = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    share = min(1.0, sample / max(1, y.count()))
    y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share >= 1))

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = []
        for t in batch.column("text"):
            w = (t.as_py() or "").split()
            runs = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
            keys.append(min(xxhash.xxh3_64_intdigest(r) for r in runs) >> 1)
        return pa.record_batch([batch.column("doc_id"), batch.column("text"), batch.column("y"), pa.array(keys, pa.int64())], names=["doc_id", "text", "y", "key"])

    # The labelled rows are bounded by the sample; their texts are joined in without a shuffle of the others.
    rows = cut(map_batches(docs.join(F.broadcast(y), "doc_id").select("doc_id", "text", "y"), keyed, "doc_id long, text string, y int, key long"), "labelled")
    first = rows.groupBy("key", "y").agg(F.min("doc_id").alias("doc_id"))
    rows = rows.join(first, ["key", "y", "doc_id"]).select("text", "y")
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n = np.array([counts.get(0, 0), counts.get(1, 0)])
    if not n.all():
        return Model({}, (1.0, 1.0), (30.0 if n[1] else -30.0, 0.0))
    weights = _lexicon(rows, n)

    def hits(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, found = 0, Counter()
        for t in batch.column("text"):
            words = tokens(t.as_py())
            total += len(words)
            found.update(round(s, 1) for w in words if (s := _weight(weights.get, w)) > 0)
        return pa.record_batch([pa.array([total], pa.int64()), pa.array([[*found.keys()]], pa.list_(pa.float64())), pa.array([[*found.values()]], pa.list_(pa.int64()))], names=["total", "s", "n"])

    seen, total = Counter(), 0
    for r in map_batches(rows.where("y = 0").select("text"), hits, "total long, s array<double>, n array<long>").toLocalIterator():
        total += r.total
        seen.update(dict(zip(r.s, r.n)))
    law = _law(seen, total, weights)

    def evidences(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array([evidence(tokens(t.as_py()), weights, law) for t in batch.column("text")], pa.float64()), batch.column("y")], names=["x", "y"])

    got = map_batches(rows, evidences, "x double, y int").groupBy(F.round("x", 2).alias("x"), "y").count().collect()
    x = np.repeat([r.x for r in got], [r["count"] for r in got]) / 10
    labels_of = np.repeat([float(r.y) for r in got], [r["count"] for r in got])
    a, b = _curve(x, labels_of)
    return Model(weights, law, (a, max(0.0, b) / 10))


def score_text(words: list[str], model: Model) -> float:
    x = model.curve[0] + model.curve[1] * evidence(words, model.weights, model.law)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, the probability of label 1 from the text alone.

    A column of that name is replaced, all others pass through.  Null and empty texts get the score of no evidence."""
    names = [c for c in docs.columns if c != score_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        found = [score_text(tokens(t.as_py()), m) for t in batch.column(text_col)]
        return pa.record_batch([*(batch.column(c) for c in names), pa.array(found, pa.float64())], names=[*names, score_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != score_col)
    return map_batches(docs.select(*names), run, f"{schema}, `{score_col}` double")


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, first, end, segment_score, expected): the significant toxic passages as token ranges of the text.

    expected is how often clean text of that length has one that scores as high; only those below 1 are given."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        out = []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = tokens(t.as_py())
            for a, b, s in segments(words, m.weights):
                expected = m.law[1] * max(1, len(words)) * math.exp(-m.law[0] * s)
                if expected < 1:
                    out.append((i, a, b, s, expected))
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "first", "end", "segment_score", "expected"])

    return map_batches(docs.select(id_col, text_col), run, f"id {kind}, first long, end long, segment_score double, expected double").withColumnRenamed("id", id_col)
