"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace) resolves pre-tokens that are tokens.  Tier
two: the rest is merged by a heap of ranked pairs over linked bytes.  A bounded cache keeps what was resolved.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches

#: Pre-tokens that a worker's cache holds at most; it starts anew when full.
CACHE = 400_000
LOAD = 2  # keys in a bucket of the hash, on average
DIRECT = 1 << 63  # marks a displacement that is a slot


def read_ranks(path: str) -> dict[bytes, int]:
    """token -> rank of a tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: key -> value, None for others (the slot's key is compared).

    A key's bucket comes from one half of its 64-bit hash; the bucket's displacement sends its keys to free slots, as
    many as there are keys.  Large buckets are placed first; those of one key take what is left and name their slot.
    """

    def __init__(self, items: dict[bytes, int]):
        n = len(items)
        self.n = n
        self.buckets = max(1, n // LOAD)
        self.shift = array("Q", bytes(8 * self.buckets))
        self.keys: list[bytes] = [b""] * n
        self.values: list[int] = [-1] * n
        by: dict[int, list[tuple[int, bytes]]] = {}
        for k in items:
            h = xxhash.xxh3_64_intdigest(k)
            by.setdefault((h >> 32) % self.buckets, []).append((h, k))
        used = bytearray(n)
        left = 0
        for b, own in sorted(by.items(), key=lambda x: (-len(x[1]), x[0])):
            if len({h for h, _ in own}) < len(own):
                raise ValueError("two keys share a hash")
            if len(own) == 1:
                left = used.index(0, left)
                self.shift[b] = DIRECT | left
                used[left], self.keys[left], self.values[left] = 1, own[0][1], items[own[0][1]]
                continue
            d = 1
            while True:
                slots = [self._slot(h, d) for h, _ in own]
                if not any(used[s] for s in slots) and len(set(slots)) == len(slots):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, k) in zip(slots, own):
                used[s], self.keys[s], self.values[s] = 1, k, items[k]

    def _slot(self, h: int, d: int) -> int:
        if d & DIRECT:
            return d ^ DIRECT
        x = (h ^ d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        return ((x ^ x >> 31) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        s = self._slot(h, self.shift[(h >> 32) % self.buckets])
        return self.values[s] if self.keys[s] == key else None


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.hash = PerfectHash(ranks)
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the lowest-ranked neighbours, leftmost first, until none can be: a heap over linked bytes."""
        n = len(piece)
        rank = self.ranks.get
        prv = list(range(-1, n - 1))
        end = list(range(1, n + 1))  # a live part is piece[i:end[i]]; end[i] is 0 once it has gone
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != e:
                continue  # one of the two has changed since
            end[i], end[j] = e, 0
            if e < n:
                prv[e] = i
                if (r := rank(piece[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            p = prv[i]
            if p >= 0 and (r := rank(piece[p:e])) is not None:
                heapq.heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def resolve(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.hash.get(raw)
        ids = (whole,) if whole is not None else self.merge(raw)
        if len(raw) <= 64:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        got = self.cache.get
        return list(chain.from_iterable([got(p) or self.resolve(p) for p in self.split(text)]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """The worker's codec of a broadcast vocabulary (a bounded table: one entry for each token)."""
    key = f"{shared.value[0]}|{pattern}"
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value[1], pattern)
    return _codecs[key]


def _shared(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        name = hashlib.sha256(f.read()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast((name, read_ranks(path)))


def encode_column(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col, the token ids of the text (null and empty: none).

    A column of that name is replaced, all others pass through; every id is below the number of tokens."""
    names = [c for c in docs.columns if c != ids_col]
    shared = _shared(docs, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared, pattern)
        ids = [np.array(codec.encode(t.as_py() or ""), np.int32) for t in batch.column(text_col)]
        return pa.record_batch([*(batch.column(c) for c in names), pa.array(ids, pa.list_(pa.int32()))], names=[*names, ids_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != ids_col)
    return map_batches(docs.select(*names), run, f"{schema}, `{ids_col}` array<int>")


def decode_column(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with bytes_col, the bytes that the ids stand for (null: none).  A column of that name is replaced."""
    names = [c for c in df.columns if c != bytes_col]
    shared = _shared(df, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared, pattern)
        out = [codec.decode(i.as_py() or []) for i in batch.column(ids_col)]
        return pa.record_batch([*(batch.column(c) for c in names), pa.array(out, pa.binary())], names=[*names, bytes_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != bytes_col)
    return map_batches(df.select(*names), run, f"{schema}, `{bytes_col}` binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text is encoded and its ids decoded.

    Null and empty texts have no tokens and the hash of nothing.  Repeated rows and null ids stay; other columns are
    ignored.
    """
    shared = _shared(docs, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared, pattern)
        counts, ids_sha, back_sha = [], [], []
        for t in batch.column(1):
            ids = codec.encode(t.as_py() or "")
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            back_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(back_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
