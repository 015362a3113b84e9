"""Line dedup with two Bloom filters: one of lines seen, one of lines seen in a second document.

Every task sets bits for the keys of its lines; filters of tasks merge bit by bit (what two of them saw goes to the
twice-seen filter), segment by segment.  Only lines whose bits are all in the twice-seen filter are shuffled, as
128-bit hashes, to be counted exactly and to choose the occurrence that stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, detached, free_prefix, map_batches

#: Bits of each filter, whatever the input: the broadcast filter has 16 MB at most.  With more lines than it can tell
#: apart more of them are suspected and shuffled; results stay exact.
FILTER_BITS = 1 << 27
SEGMENT_BITS = 1 << 16
BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3


def key_of(line: str, min_chars: int = MIN_CHARS) -> int | None:
    """128-bit hash of the line stripped of ASCII blanks with A-Z lower-cased; None if the key is too short to count."""
    line = line.strip(BLANKS)
    return xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass").lower()) if len(line) >= min_chars else None


def _keys(text: str | None, min_chars: int) -> set[int]:
    return {k for k in (key_of(x, min_chars) for x in (text or "").split("\n")) if k is not None}


def _halves(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(k.to_bytes(16, "little") for k in keys), np.uint64).reshape(-1, 2)
    return raw[:, 0], raw[:, 1]


def _bits(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Two filter positions for each key."""
    return np.stack([lo & np.uint64(FILTER_BITS - 1), hi & np.uint64(FILTER_BITS - 1)])


def marks(seen: np.ndarray) -> pa.RecordBatch:
    """(seg, once, twice): filter positions of a batch by segment, and those that come up more than once."""
    at, n = np.unique(seen, return_counts=True)
    seg, start = np.unique(at // SEGMENT_BITS, return_index=True)
    ends = [*start[1:].tolist(), len(at)]
    low = (at % SEGMENT_BITS).astype("<u2")
    once = [low[i:j].tobytes() for i, j in zip(start.tolist(), ends)]
    twice = [low[i:j][n[i:j] > 1].tobytes() for i, j in zip(start.tolist(), ends)]
    return pa.record_batch([pa.array(seg.astype(np.int32)), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["seg", "once", "twice"])


def filter_of(docs: DataFrame, local) -> bytes:
    """The filter of positions that two documents or more have, FILTER_BITS / 8 bytes.  local gives a batch's marks()."""

    def merged(key, t):
        once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
        for a, b in zip(t.column("once"), t.column("twice")):
            at = np.frombuffer(a.as_py(), "<u2")
            twice[at[once[at]]] = True
            once[at] = True
            twice[np.frombuffer(b.as_py(), "<u2")] = True
        return pa.table({"seg": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})

    parts = map_batches(docs.select("text"), local, "seg int, once binary, twice binary").groupBy("seg").applyInArrow(merged, "seg int, bits binary")
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    size = SEGMENT_BITS // 8
    for row in parts.toLocalIterator():
        out[row.seg * size : (row.seg + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def twice_seen(docs: DataFrame, min_chars: int = MIN_CHARS) -> bytes:
    """The filter of lines in two documents or more.  docs: (doc_id, text)."""

    def local(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys = [k for t in batch.column("text") for k in _keys(t.as_py(), min_chars)]
        if not keys:
            return None
        # A key's two positions may coincide; then they count once.
        bits = _bits(*_halves(keys))
        return marks(np.concatenate([bits[0], bits[1][bits[0] != bits[1]]]))

    return filter_of(docs, local)


def suspects(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, lo, hi): the keys, once for each document, that the twice-seen filter holds."""
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, min_chars))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        bits = np.frombuffer(shared.value, np.uint8)
        ids, keys = [], []
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            found = _keys(t.as_py(), min_chars)
            keys += found
            ids += [i] * len(found)
        if not keys:
            return None
        lo, hi = _halves(keys)
        at = _bits(lo, hi)
        ok = ((bits[at >> 3] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)
        return pa.record_batch([pa.array(np.array(ids, np.int64)[ok]), pa.array(lo[ok].view(np.int64)), pa.array(hi[ok].view(np.int64))], names=["doc_id", "lo", "hi"])

    return map_batches(docs.where("doc_id is not null"), run, "doc_id long, lo long, hi long")


def doomed(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, gone): for each document the first key halves of the lines that it loses."""
    found = cut(suspects(docs, min_chars), "lines")
    kept = found.groupBy("lo", "hi").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    kept = kept.select(detached("lo").alias("k"), F.col("hi").alias("k2"), "last")
    lost = found.select("doc_id", "lo", detached("lo").alias("k"), F.col("hi").alias("k2")).join(kept, ["k", "k2"])
    return lost.where("doc_id < last").groupBy("doc_id").agg(F.collect_set("lo").alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the repeated lines out of text, and n_lines and n_dropped (of lines; columns of these names are replaced).

    A line whose key has min_chars code points and stands in min_docs documents stays only in the largest doc_id that
    holds it, there with all its occurrences.  A null or empty text is one empty line and stays as it is.  Rows
    without a doc_id stay whole and don't count.  Rows that repeat a doc_id count as one document and are all treated
    alike.  Other columns pass through.
    """
    docs = docs.drop("n_lines", "n_dropped")
    lost = cut(doomed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_chars, min_docs), "gone")
    own = free_prefix(docs.columns)
    gone_id, gone_keys = f"{own}id", f"{own}gone"
    lost = lost.select(F.col("doc_id").alias(gone_id), F.col("gone").alias(gone_keys))
    # Both sides grow with the input: always a sort-merge join.
    joined = docs.join(lost.hint("merge"), F.col("doc_id") == F.col(gone_id), "left").drop(gone_id)
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lines, drops = [], [], []
        for t, gone in zip(batch.column("text"), batch.column(gone_keys)):
            t = t.as_py()
            if not gone.is_valid:
                texts.append(t)
                lines.append((t or "").count("\n") + 1)
                drops.append(0)
                continue
            gone = {g & 0xFFFFFFFFFFFFFFFF for g in gone.as_py()}
            all_lines = (t or "").split("\n")
            stay = [x for x in all_lines if (k := key_of(x, min_chars)) is None or k & 0xFFFFFFFFFFFFFFFF not in gone]
            texts.append("\n".join(stay))
            lines.append(len(all_lines))
            drops.append(len(all_lines) - len(stay))
        cols = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
        return pa.record_batch([*cols, pa.array(lines, pa.int64()), pa.array(drops, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(joined, run, f"{schema}, n_lines long, n_dropped long")
