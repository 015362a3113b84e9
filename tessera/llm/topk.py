"""Exact top-k inner products by a three-phase uniform threshold.

The components are split into slices; a vector's score is the sum of its slices' partial scores.  Phase 1: each block
of candidates takes the best partial scores of every slice, and the full scores behind them are gathered; a query's
k-th best of these is a safe cutoff.  Phase 2: the cutoffs are broadcast, and each block collects the entries with
some partial score of at least cutoff / slices (any vector that reaches the cutoff has one).  Phase 3: the full
scores of these are resolved exactly, and a block sends its best k that reach the cutoff.

Queries go out in blocks of a fixed size, each against all rows; nothing but the query block and its cutoffs is
broadcast, both bounded by QUERIES.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

QUERIES = 16_384  # queries in a block: 8 MB of 64 components as int64
STEP = 256  # queries whose scores a task holds at once
SLICES = 4
LOW = -(1 << 62)


def quantised(vec: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, as longs."""
    return F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vec: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vec.isNotNull() & ~F.exists(vec, bad)


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Rows of one length; shorter ones end in zeros."""
    if col.null_count == 0 and len(col) and pa.compute.all(pa.compute.equal(pa.compute.list_value_length(col), dims)).as_py():
        return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    out = np.zeros((len(col), dims), np.int64)
    for i, row in enumerate(col.to_pylist()):
        out[i, : len(row)] = row
    return out


def _exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the narrowest type in which every sum of products is a whole number."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
    return q.astype(kind), c.astype(kind)


def _partials(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    edges = np.linspace(0, q.shape[1], SLICES + 1).astype(int)
    return [q[:, i:j] @ c[:, i:j].T for i, j in zip(edges, edges[1:])]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, in any order."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]


def _block(candidates: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): at least the k best of every query of the block, at most k from a batch of rows."""
    sc = candidates.sparkSession.sparkContext
    dims = vectors.shape[1]
    queries = sc.broadcast((ids, vectors))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qv = queries.value
        kept = np.full((len(qid), k), LOW, np.int64)
        for batch in batches:
            cid = batch.column(0).to_numpy()
            qx, cx = _exact(qv, _matrix(batch.column(1), dims))
            for at in range(0, len(qid), STEP):
                parts = _partials(qx[at : at + STEP], cx)
                total = sum(parts).astype(np.int64)
                total[qid[at : at + STEP, None] == cid[None, :]] = LOW
                # What several slices name counts once: an entry is kept by its place.
                named = np.zeros(total.shape, bool)
                for p in parts:
                    np.put_along_axis(named, _best(p, k), True, axis=1)
                total[~named] = LOW
                pool = np.concatenate([kept[at : at + STEP], np.take_along_axis(total, _best(total, k), axis=1)], axis=1)
                kept[at : at + STEP] = np.sort(pool, axis=1)[:, -k:]
        part = TaskContext.get().partitionId() % 64
        yield pa.record_batch([pa.array(np.arange(len(qid), dtype=np.int32)), pa.array([part] * len(qid), pa.int32()), pa.array(list(kept), pa.list_(pa.int64()))], names=["q", "part", "scores"])

    best = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c)), asc=False), 1, k)
    lists = candidates.mapInArrow(gather, "q int, part int, scores array<long>")
    lists = lists.groupBy("q", "part").agg(best("scores").alias("scores")).groupBy("q").agg(best("scores").alias("scores"))
    cutoff = np.full(len(ids), LOW, np.int64)
    for row in lists.select("q", F.element_at("scores", -1).alias("low"), F.size("scores").alias("n")).collect():  # one number a query
        if row.n >= k:
            cutoff[row.q] = row.low
    known = sc.broadcast(cutoff)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qv = queries.value
        low = known.value
        for batch in batches:
            cid = batch.column(0).to_numpy()
            qx, cx = _exact(qv, _matrix(batch.column(1), dims))
            order = np.argsort(cid, kind="stable")
            cid, cx = cid[order], cx[order]
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for at in range(0, len(qid), STEP):
                parts = _partials(qx[at : at + STEP], cx)
                tau = low[at : at + STEP, None]
                share = tau / SLICES
                enough = np.logical_or.reduce([p >= share for p in parts])
                enough &= qid[at : at + STEP, None] != cid[None, :]
                r, c = np.nonzero(enough)
                score = sum(p[r, c] for p in parts).astype(np.int64)
                ok = score >= tau[r, 0]
                r, c, score = r[ok], c[ok], score[ok]
                # The best k of a query here, ties to the smaller id (rows are in order of id).
                by = np.lexsort((c, -score, r))
                r, c, score = r[by], c[by], score[by]
                first = np.searchsorted(r, r)
                ok = np.arange(len(r)) - first < k
                out.append((qid[at + r[ok]], cid[c[ok]], score[ok]))
            cols = [np.concatenate(x) for x in zip(*out)]
            if len(cols[0]):
                yield pa.record_batch([pa.array(x) for x in cols], names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(resolve, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with all other rows.

    Ties go to the smaller vec_id.  Rows with a null id, a null vector, or a component that is null or not finite take
    no part; a shorter vector counts as ending in zeros.  Rows that share an id are each candidates of other queries,
    and none of them of the query with that id, whose vector is then the smallest of theirs.  Scores must fit 64 bits.
    """
    good = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
    good = good.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col), scale).alias("v"), is_query.alias("is_query"))
    dims = good.agg(F.max(F.size("v"))).first()[0] or 0
    queries = good.where("is_query").groupBy("id").agg(F.min("v").alias("v"))
    rows = queries.toLocalIterator()
    candidates = good.select("id", "v")
    found = None
    blocks = 0
    while block := list(islice(rows, QUERIES)):
        ids = np.array([r.id for r in block], np.int64)
        q = np.zeros((len(block), dims), np.int64)
        for i, r in enumerate(block):
            q[i, : len(r.v)] = r.v
        part = _block(candidates, ids, q, k)
        blocks += 1
        part = cut(part, "topk") if blocks > 1 else part
        found = part if found is None else found.union(part)
    if found is None:
        found = candidates.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
