"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at Hamming distance 4 or less share a variant that lies within 2 bits of both.  Every distinct
fingerprint therefore stands for all its variants within radius 2, and variants are dealt out by their first bits: a
fingerprint goes once to each bucket that holds some of its variants, and the bucket regenerates just those (the
same collisions as shipping all 2081 variants, at a fraction of the bytes).  Fingerprints that share a variant are
pairwise within the radius, so a star per variant keeps every link without making all pairs.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, cut, detached, flagged, free_prefix, map_batches

RADIUS = 4
SEED = 42
#: Variants that one bucket step holds in memory at once (8 bytes each).
STEP = 1 << 21
_RUN = np.uint64(0x9E3779B185EBCA87)


def shingle_hashes(text: str | None, width: int, seed: int = SEED) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        grams = [joined]
    else:
        ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))
        starts = [0, *(e + 1 for e in ends)]
        grams = [joined[i:j] for i, j in zip(starts, ends[width - 1 :])]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, len(grams))


def run_hashes(text: str | None, width: int) -> np.ndarray:
    """A hash for every run of `width` words, mixed from hashes of the words; one for a shorter text, none without words."""
    return run_hashes_of(words_of(text), width)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def run_hashes_of(words: list[bytes], width: int) -> np.ndarray:
    """The same of words."""
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - width + 1) if len(w) else 0
    h = np.zeros(n, np.uint64)
    for k in range(min(width, len(w))):
        h = (h ^ h >> np.uint64(32)) * _RUN + w[k : k + n]
    h ^= h >> np.uint64(31)
    h *= _RUN
    return h ^ h >> np.uint64(29)


def fingerprint(text: str | None, width: int = 4, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingle hashes; 0 for a text without words."""
    h = shingle_hashes(text, width, seed)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
        return pa.record_batch([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


def _masks(bits: int, radius: int) -> np.ndarray:
    out = [0]
    for r in range(1, radius + 1):
        out += [sum(1 << i for i in c) for c in combinations(range(bits), r)]
    return np.array(out, np.uint64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def bucket_links(fps: np.ndarray, bucket: int, prefix: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (a forest over fps) among the fingerprints that have a variant in this bucket of variants."""
    half = radius // 2
    away = np.bitwise_count((fps >> np.uint64(64 - prefix)) ^ np.uint64(bucket)).astype(np.int8)
    found: list[np.ndarray] = []
    todo = [(np.flatnonzero(away <= half), away[away <= half], 64 - prefix)]
    while todo:
        at, d, left = todo.pop()
        if len(at) < 2:
            continue
        need = sum(int((d == k).sum()) * sum(math.comb(left, r) for r in range(half - k + 1)) for k in range(half + 1))
        owner_bits = 64 - left
        if left > 1 and (len(at) > 1 << owner_bits or need > STEP):
            bit = (fps[at] >> np.uint64(left - 1)) & np.uint64(1)
            for side in (0, 1):
                dd = d + (bit != side)
                keep = dd <= half
                todo.append((at[keep], dd[keep], left - 1))
            continue
        low = fps[at] & np.uint64((1 << left) - 1)
        owner = np.arange(len(at), dtype=np.uint64)
        parts = []
        for k in range(half + 1):
            if (own := d == k).any():
                v = (low[own][:, None] ^ _masks(left, half - k)[None, :]) << np.uint64(owner_bits)
                parts.append((v | owner[own][:, None]).ravel())
        packed = np.sort(np.concatenate(parts))
        same = (packed[1:] ^ packed[:-1]) < np.uint64(1 << owner_bits)
        if not same.any():
            continue
        # The first of a run is its smallest owner; it is linked with each other one of the run.
        first = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(packed)), 0))[1:][same]
        low_mask = np.uint64((1 << owner_bits) - 1)
        x, y = at[(packed[first] & low_mask).astype(np.int64)], at[(packed[1:][same] & low_mask).astype(np.int64)]
        found.append(np.unique(x.astype(np.int64) << 32 | y))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    links = np.unique(np.concatenate(found))
    x, y = links >> 32, links & 0xFFFFFFFF
    ok = np.bitwise_count(fps[x] ^ fps[y]) <= radius
    root = np.array(_roots(len(fps), x[ok], y[ok]))
    leaf = np.flatnonzero(root != np.arange(len(fps)))
    return fps[root[leaf]], fps[leaf]


def prefix_bits(n: int) -> int:
    """Length of the prefix that deals out variants of n fingerprints: buckets grow in number with the input, so that
    each stays small, and a fingerprint goes to 56 buckets at 10 bits, 106 at 14 and 301 at 24."""
    return min(24, max(10, math.ceil(math.log2(max(n, 2))) - 10))


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between different fingerprints at the radius or less, with the same components as all of them.

    distinct has one row for each fingerprint fp (long); n is their count.  Null fingerprints are not allowed; an empty
    table gives an empty result.
    """
    prefix = prefix_bits(n)
    masks = _masks(prefix, radius // 2).astype(np.int64).tolist()
    top = F.shiftrightunsigned("fp", 64 - prefix)
    dealt = distinct.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("m")).select("fp", top.bitwiseXOR(F.col("m").cast("long")).alias("bucket"))

    def run(key, t):
        fps = np.sort(t.column("fp").to_numpy().view(np.uint64))
        a, b = bucket_links(fps, key[0].as_py(), prefix, radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return dealt.groupBy("bucket").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach, its own included.

    Null or blank texts have fingerprint 0 and are linked like any other.  Rows without a doc_id keep their row and
    get their component's smallest doc_id, null if no member has one.  Repeated rows stay.  Other columns are ignored.
    An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, width, id_col, text_col), "prints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct")
    found = connected_components(links(distinct.select("fp"), distinct.count(), radius), "a", "b")
    member = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    member = cut(member, "member")
    least = member.groupBy("root").agg(F.min("doc").alias("component_id")).select(detached("root").alias("k"), "component_id")
    named = cut(member.withColumn("k", detached("root")).join(least, "k").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


# --- near-duplicate documents by similarity

SIMILARITY = 0.8
FUNCTIONS = 4
#: Groups of minima of a text's shingle hashes, and minima in each: two texts of similarity s share a group with
#: probability 1 - (1 - s^MINIMA)^GROUPS, wherever they differ: 0.9995 at 0.8, 0.96 at 0.7.
GROUPS = 25
MINIMA = 6
BINS = 512
#: Where the sketch's estimate is this close to the threshold (4.5 standard errors), the shingles themselves decide.
BAND = 0.08
#: Texts of a block: two blocks of a group are compared in a task.
BLOCK = 1024
#: Words of fewer bytes say little about a text; they are used where it has fewer than MIN_WORDS others.
LONG = 4
MIN_WORDS = 8

_ODD = [np.uint64(0x9E3779B97F4A7C15 * (2 * j + 3) % (1 << 64) | 1) for j in range(FUNCTIONS + 1)]


def word_prints(text: str | None, functions: int = FUNCTIONS) -> list[int]:
    """SimHashes of the text's distinct words under several hash functions.

    Where single words are changed here and there, one in 45 differs at a similarity of 0.8 over runs of five words,
    which moves a few bits.  A passage of other words moves more: such pairs are found by group_prints()."""
    words = set((text or "").encode("utf-8", "surrogatepass").lower().split())
    some = [w for w in words if len(w) >= LONG]
    h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in (some if len(some) >= MIN_WORDS else words)], np.uint64)
    if not len(h):
        return [0] * functions
    out = []
    for j in range(functions):
        g = (h ^ _ODD[j]) * _ODD[j + 1]
        g ^= g >> np.uint64(29)
        g *= _ODD[0]
        g ^= g >> np.uint64(32)
        ones = np.unpackbits(g.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(g), bitorder="little").view("<i8")[0]))
    return out


_FLIPS, _TURNS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, GROUPS * MINIMA, 1), np.uint64) | np.uint64(1)


def group_prints(h: np.ndarray) -> np.ndarray:
    """A hash for each group of minima of the shingle hashes, each minimum under a function of its own; signed."""
    least = np.full(GROUPS * MINIMA, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 1 << 12):
        least = np.minimum(least, ((h[None, at : at + (1 << 12)] ^ _FLIPS) * _TURNS).min(1))
    least = least.reshape(GROUPS, MINIMA)
    out = np.arange(1, GROUPS + 1, dtype=np.uint64) * _RUN
    for k in range(MINIMA):
        out = (out ^ out >> np.uint64(32)) * _RUN + least[:, k]
    out ^= out >> np.uint64(31)
    out *= _RUN
    return (out ^ out >> np.uint64(29)).view(np.int64)


def sketch(text: str | None, width: int = 5) -> bytes:
    return binned(np.unique(run_hashes(text, width)))


def binned(h: np.ndarray) -> bytes:
    """A byte for each bin of the distinct shingle hashes: 0 if it is empty, else a digest of the bin's least hash."""
    out = np.zeros(BINS, np.uint8)
    bins, rest = (h & np.uint64(BINS - 1)).astype(np.int64), h >> np.uint64(9)
    order = np.lexsort((rest, bins))
    first = order[np.r_[True, np.diff(bins[order]) != 0]] if len(h) else order
    out[bins[first]] = 1 + (rest[first] % np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def similarity(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of two texts' shingles: the share of equal bins among those in use; 1 if none is."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    used = int(np.count_nonzero(x | y))
    return int(np.count_nonzero((x == y) & (x != 0))) / used if used else 1.0


def near(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether the Jaccard similarity of two sets of distinct hashes is threshold or more; two empty sets are equal."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= threshold * (len(x) + len(y) - both)


def _runs(docs: DataFrame, nodes: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(k, runs): the distinct shingle hashes of those nodes(node, th) that ids(node) names; k is the node, detached."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.as_py() or "" for t in batch.column("text")]
        th = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64).view(np.int64)
        return pa.record_batch([batch.column("node"), pa.array(th), pa.array([np.unique(run_hashes(t, width)).tobytes() for t in texts], pa.binary())], names=["node", "th", "runs"])

    ids = cut(ids.distinct(), "ids")
    texts = flagged(docs.withColumnRenamed("doc_id", "node"), "node", ids, "node", "wanted").where("wanted").drop("wanted")
    texts = texts.join(ids.hint("merge"), "node", "left_semi")
    found = map_batches(texts, run, "node long, th long, runs binary").join(nodes.select("node", "th").join(ids, "node", "left_semi"), ["node", "th"], "left_semi")
    return cut(found.select(detached("node").alias("k"), "runs").dropDuplicates(["k"]), "runs")


def _node_links(nodes: DataFrame, functions: int, n: int) -> DataFrame:
    """(a, b): links between nodes whose fingerprints under one function are within the radius, a forest in each bucket.

    The functions go through one plan side by side: a branch of a union for each would multiply the tasks of a stage and
    the metrics of each task, which the driver holds."""
    held = nodes.select("node", F.posexplode(F.array(*(f"fp{j}" for j in range(functions)))).alias("j", "fp"))
    first = held.groupBy("j", "fp").agg(F.min("node").alias("node"))
    same = held.withColumn("k", detached("fp")).join(first.select("j", detached("fp").alias("k"), F.col("node").alias("a")), ["j", "k"]).where("node <> a").select("a", F.col("node").alias("b"))
    prefix = prefix_bits(n)
    masks = _masks(prefix, RADIUS // 2).astype(np.int64).tolist()
    dealt = first.select("j", "fp", "node", F.explode(F.array(*map(F.lit, masks))).alias("m"))
    bucket = F.shiftrightunsigned("fp", 64 - prefix).bitwiseXOR(F.col("m").cast("long"))
    dealt = dealt.select("fp", "node", F.shiftleft(F.col("j").cast("long"), 32).bitwiseOR(bucket).alias("bucket"))

    def run(key, t):
        ids, fps = t.column("node").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(ids)
        at = {int(f): int(i) for f, i in zip(fps, ids)}
        a, b = bucket_links(fps[order], key[0].as_py() & 0xFFFFFFFF, prefix)
        return pa.table({"a": pa.array([at[int(x)] for x in a], pa.int64()), "b": pa.array([at[int(x)] for x in b], pa.int64())})

    return same.union(dealt.groupBy("bucket").applyInArrow(run, "a long, b long"))


def duplicates(docs: DataFrame, threshold: float = SIMILARITY, width: int = 5, functions: int = FUNCTIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, root): the documents that are not the smallest doc_id of their group, with that.

    Documents are grouped by equal texts, and by links between documents that share a group of minima of their shingles
    or whose word SimHash is within RADIUS bits under some hash function, and whose shingles have a similarity of
    threshold or more: a sketch of BINS bins tells clear pairs, the shingles themselves those within BAND of the threshold.
    Null and empty texts count as equal.  Rows without an id are left out; other columns are ignored."""
    prints = ", ".join(f"fp{j} long" for j in range(functions))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.as_py() or "" for t in batch.column("text")]
        th = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64).view(np.int64)
        fps = list(zip(*(word_prints(t, functions) for t in texts)))
        runs = [np.unique(run_hashes(t, width)) for t in texts]
        groups = pa.array([group_prints(h) for h in runs], pa.list_(pa.int64()))
        return pa.record_batch([batch.column("doc_id"), pa.array(th), *(pa.array(f, pa.int64()) for f in fps), pa.array(map(binned, runs), pa.binary()), groups], names=["doc_id", "th", *(f"fp{j}" for j in range(functions)), "sketch", "groups"])

    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(map_batches(given, run, f"doc_id long, th long, {prints}, sketch binary, groups array<long>"), "prints")
    # One node for each text; a text that is a hot copy is reduced before it is shuffled.
    first = cut(rows.groupBy("th").agg(F.min("doc_id").alias("node")), "texts")
    copies = rows.select("doc_id", "th", detached("th").alias("k")).join(first.select(detached("th").alias("k"), "node"), "k").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    nodes = rows.join(first.select(F.col("node").alias("doc_id"), F.col("th").alias("t")), ["doc_id"], "inner").where("th = t").drop("t").withColumnRenamed("doc_id", "node")
    # Rows that repeat an id with other texts: the text with the smallest hash stands for them.
    rest = [c for c in nodes.columns if c != "node"]
    nodes = cut(nodes.groupBy("node").agg(F.min_by(F.struct(*rest), "th").alias("r")).select("node", "r.*"), "nodes")
    n = nodes.count()
    held = nodes.select("node", F.explode("groups").alias("g"))
    least = held.groupBy("g").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select(detached("g").alias("k"), "a")
    held = cut(held.withColumn("k", detached("g")).join(least, "k").select("g", "node", "a"), "held")
    found = held.where("node <> a").select("a", F.col("node").alias("b"))
    found = found.union(_node_links(nodes, functions, n))
    found = cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    known = nodes.select(detached("node").alias("k"), "sketch")

    def both(pairs: DataFrame, known: DataFrame, col: str) -> DataFrame:
        out = pairs.withColumn("k", detached("a")).join(known.withColumnRenamed(col, "x"), "k").drop("k")
        return out.withColumn("k", detached("b")).join(known.withColumnRenamed(col, "y"), "k").select("a", "b", "x", "y")

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = np.array([similarity(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())])
        out = pa.record_batch([batch.column("a"), batch.column("b"), pa.array(s >= threshold + BAND)], names=["a", "b", "sure"])
        return out.filter(pa.array(s >= threshold - BAND))

    def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = [near(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        return pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    checked = cut(map_batches(both(found, known, "sketch"), check, "a long, b long, sure boolean"), "checked")
    close = checked.where("not sure").select("a", "b")
    runs = _runs(given, nodes, close.select(F.col("a").alias("node")).union(close.select("b")), width)
    links = checked.where("sure").select("a", "b").union(cut(map_batches(both(close, runs, "runs"), exact, "a long, b long"), "exact"))
    # A star links all of a group only if none of its pairs fails: what the verified links leave apart is compared in pairs.
    apart = _apart(held.select("g", "node"), links)
    links = links.union(_relinked(apart, _runs(given, nodes, apart.select("node"), width), threshold))
    groups = connected_components(links.union(copies), "a", "b")
    return groups.where("node <> root").select(F.col("node").alias("doc_id"), "root")


def _apart(held: DataFrame, links: DataFrame) -> DataFrame:
    """held(g, node, ...) with root and n where links leave g's nodes in several components: root is the node's, n counts g's rows."""
    rest = [c for c in held.columns if c not in ("g", "node")]
    roots = connected_components(links, "a", "b").select(detached("node").alias("k"), "root")
    rooted = cut(held.withColumn("k", detached("node")).join(roots, "k", "left").select("g", "node", *rest, F.coalesce("root", "node").alias("root")), "rooted")
    several = rooted.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high")
    return cut(rooted.withColumn("k", detached("g")).join(several.select(detached("g").alias("k"), "n"), "k").select("g", "node", *rest, "root", "n"), "apart")


def joined(root: np.ndarray, side: np.ndarray | None, close) -> list[tuple[int, int]]:
    """Places of pairs, a forest over the components root, that join all that any close pair joins.

    close(i, at) tells which of the places `at` are close to i.  With side, pairs of one side aren't compared."""
    root, out = root.copy(), []
    for i in range(len(root) - 1):
        at = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (True if side is None else side[i + 1 :] != side[i]))
        for j in at[close(i, at)].tolist() if len(at) else []:
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def _relinked(apart: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join the components of every two nodes of a group g that are near copies; known is from _runs().

    Large groups are cut into blocks, every two of which meet in a task."""
    blocks = F.ceil(F.col("n") / BLOCK)
    rows = apart.select("g", "node", "root", F.pmod(F.xxhash64("node"), blocks).alias("side"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("g", "node", "root", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    rows = rows.withColumn("k", detached("node")).join(known, "k").drop("k")

    def run(key, t):
        node, root, side = (t.column(c).to_numpy() for c in ("node", "root", "side"))
        runs = [np.frombuffer(r, np.uint64) for r in t.column("runs").to_pylist()]
        x = np.frombuffer(b"".join(map(binned, runs)), np.uint8).reshape(-1, BINS)

        def close(i: int, at: np.ndarray) -> np.ndarray:
            used = np.count_nonzero(x[at] | x[i], axis=1)
            same = np.count_nonzero((x[at] == x[i]) & (x[i] != 0), axis=1)
            share = np.where(used == 0, 1, same / np.maximum(used, 1))
            return np.array([abs(v - threshold) >= BAND and v >= threshold or abs(v - threshold) < BAND and near(runs[i], runs[j], threshold) for v, j in zip(share, at)], bool)

        pairs = joined(root, None if key[1] == key[2] else side, close)
        return pa.table({"a": pa.array([node[i] for i, _ in pairs], pa.int64()), "b": pa.array([node[j] for _, j in pairs], pa.int64())})

    return cut(rows.groupBy("g", "low", "high").applyInArrow(run, "a long, b long"), "relinked")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that duplicates() names.

    Of rows that repeat an id one stays, that with the smallest hash of all its columns: reruns agree.  Rows without an id
    stay.  All columns pass through, whatever their names; an empty table gives an empty result."""
    own = free_prefix(docs.columns)
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias(f"{own}n")).where(F.col(f"{own}n") > 1).limit(1).count()
    if again:
        one = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(f"{own}id")).agg(F.min_by(F.struct("*"), F.xxhash64(*docs.columns)).alias(f"{own}row"))
        docs = cut(one.select(f"{own}row.*").unionByName(docs.where(F.col(id_col).isNull())), "once")
    gone = cut(duplicates(docs, id_col=id_col, **options), "gone").select(F.col("doc_id").alias(f"{own}gone"))
    # Only rows that may be among them are shuffled to be told for sure.
    doubt = flagged(docs, id_col, gone, f"{own}gone", f"{own}doubt")
    asked = doubt.where(F.col(f"{own}doubt")).join(gone.hint("merge"), F.col(id_col).cast("long") == F.col(f"{own}gone"), "left_anti")
    return doubt.where(~F.col(f"{own}doubt")).union(asked).drop(f"{own}doubt")
