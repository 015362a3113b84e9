"""Removal of repeated byte strings with a distributed, common-prefix-aware merge sort of suffixes.

Which suffixes are sorted.  Every window of LENGTH bytes has an anchor, the place of the least hash among its
GRAM-byte strings; equal windows have it at the same offset.  So only suffixes that start at anchors matter (about one
byte in 180), and of these only such as share their first CORE bytes, or the CORE bytes up to the anchor's end, with
another anchor: any window reaches that far to one side.  Anchors whose whole surroundings occur twice are settled at
once, by 128 bits of hash; one of each such class goes on as a partner for others.

How they are sorted.  A task sorts the suffixes of its anchors and sends each bucket a front-coded run: the length of
the prefix shared with the one before, and the rest.  A bucket merges its runs with a loser tree that compares from the
known common prefix on and never looks at those bytes again.  The merged order and its common prefixes, together with
the same for what stands before the anchors, tell for every anchor which windows around it occur elsewhere.  Anchors
whose windows lie on their left are handled alike on reversed text.

Very frequent cores (more than HOT anchors) would make large buckets: their windows are compared one by one instead,
dealt out by hash.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, map_batches, partitions

LENGTH = 400
GRAM = 32
SPAN = LENGTH - GRAM + 1
SIDE = (LENGTH - GRAM) // 2
CORE = GRAM + SIDE
#: Anchors with one core that a bucket sorts; cores with more go by the hash of each window.
HOT = 20_000
#: Bits of the broadcast filter of such cores (16 MB); no more than an eighth of it is ever set.
FILTER_BITS = 1 << 27
CHUNK = 1 << 20
MATRIX = 1 << 19  # cells of a table of a group's classes

_ODD = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _slide(x: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """Least or greatest of every run of width elements, in a constant number of steps for each."""
    n = len(x)
    y = np.full(-(-n // width) * width, fill, x.dtype)
    y[:n] = x
    y = y.reshape(-1, width)
    ahead = op.accumulate(y, axis=1).ravel()
    back = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - width + 1], ahead[width - 1 : n])


def anchors(buf: bytes, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Places of the anchors of all windows that lie within one of the documents at these bounds."""
    n = len(buf)
    if all(b - a < LENGTH for a, b in bounds):
        return np.empty(0, np.int64)
    x = np.ndarray((n - 7,), "<u8", buf, strides=(1,))
    m = n - GRAM + 1
    h = x[:m] * _ODD[0]
    for k in range(1, GRAM // 8):
        h += x[8 * k : 8 * k + m] * _ODD[k]
        h ^= h >> np.uint64(31)
    h *= _ODD[4]
    h ^= h >> np.uint64(29)
    low = _slide(h, SPAN, np.minimum, np.iinfo(np.uint64).max)
    held = np.zeros(m + SPAN - 1, np.uint64)  # by window, SPAN - 1 ahead
    for a, b in bounds:
        if b - a >= LENGTH:
            held[SPAN - 1 + a : SPAN + b - LENGTH] = low[a : b - LENGTH + 1]
    return np.flatnonzero(_slide(held, SPAN, np.maximum, 0) == h)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]], list[int]]]:
    """The batch's texts, joined in pieces of about CHUNK bytes: (bytes, bounds, row numbers)."""
    parts: list[bytes] = []
    bounds: list[tuple[int, int]] = []
    rows: list[int] = []
    at = 0
    for i, t in enumerate(batch.column("text")):
        raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
        if len(raw) < LENGTH:
            continue
        parts.append(raw)
        bounds.append((at, at + len(raw)))
        rows.append(i)
        at += len(raw)
        if at >= CHUNK:
            yield b"".join(parts), bounds, rows
            parts, bounds, rows, at = [], [], [], 0
    if parts:
        yield b"".join(parts), bounds, rows


def _spots(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, int, int, int]]:
    """(row, bytes, document's start, end, anchor) of all anchors of a batch."""
    for buf, bounds, rows in _chunks(batch):
        places = anchors(buf, bounds)
        first = np.searchsorted(places, [a for a, _ in bounds]).tolist()
        last = np.searchsorted(places, [b for _, b in bounds]).tolist()
        places = places.tolist()
        for row, (a, b), i, j in zip(rows, bounds, first, last):
            for p in places[i:j]:
                yield row, buf, a, b, p


_h64 = xxhash.xxh3_64_intdigest


def _right_core(buf: bytes, a: int, b: int, p: int) -> int | None:
    return _h64(buf[p : p + CORE], 1) if p + CORE <= b else None


def _left_core(buf: bytes, a: int, b: int, p: int) -> int | None:
    return _h64(buf[p - SIDE : p + GRAM], 2) if p - SIDE >= a else None


def _whole(buf: bytes, a: int, b: int, p: int) -> tuple[int, int]:
    """Two independent hashes of an anchor's surroundings: only 128 bits tell them apart at 10^12 anchors."""
    i, j = max(a, p - LENGTH + GRAM), min(b, p + LENGTH)
    h = xxhash.xxh3_128_intdigest(buf[i:j], 3 + (p - i) * LENGTH + (j - p))
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x.nbytes for x in arrays)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(x.tobytes() for x in arrays))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    sizes = np.frombuffer(raw, "<u8", n, 8).astype(np.int64)
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [np.frombuffer(raw[e - s : e], k) for s, e, k in zip(sizes.tolist(), ends.tolist(), kinds)]


COUNTED = "seg int, kind int, id long, th long, blob binary"
TOLD = "id long, th long, hot binary, seen binary, own binary"


def _count(segments: int):
    """Map: the hashes of a batch's anchors, one entry for each, by segment; those met twice are told to their rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, rows = [], []
        for row, buf, a, b, p in _spots(batch):
            for h in (_right_core(buf, a, b, p), _left_core(buf, a, b, p), *_whole(buf, a, b, p)):
                if h is not None:
                    hashes.append(h)
                    rows.append(row)
        ids, ths = batch.column("id").to_pylist(), batch.column("th").to_pylist()
        out: list[tuple] = []
        if hashes:
            h, r = np.array(hashes, np.uint64), np.array(rows, np.uint32)
            order = np.lexsort((r, h))
            h, r = h[order], r[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            n = np.diff(np.r_[first, len(h)])
            many = np.repeat(n > 1, n)
            by_row = np.argsort(r[many], kind="stable")
            hm, rm = h[many][by_row], r[many][by_row]
            at = np.flatnonzero(np.r_[True, rm[1:] != rm[:-1]]) if len(rm) else []
            for i, j in zip(at, [*at[1:], len(rm)] if len(rm) else []):
                out.append((int(rm[i] % segments), 1, ids[rm[i]], ths[rm[i]], np.unique(hm[i:j]).tobytes()))
            h, r, n = h[first], r[first], n.astype(np.uint32)
            seg = (h % np.uint64(segments)).astype(np.int64)
            order = np.argsort(seg, kind="stable")
            h, r, n, seg = h[order], r[order], n[order], seg[order]
            cuts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]).tolist()
            all_ids, all_ths = np.array([i or 0 for i in ids], np.int64), np.array(ths, np.int64)
            for i, j in zip(cuts, [*cuts[1:], len(h)]):
                out.append((int(seg[i]), 0, None, None, _pack(h[i:j], all_ids[r[i:j]], all_ths[r[i:j]], n[i:j])))
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["seg", "kind", "id", "th", "blob"])

    return run


def _tell(hot_from: int):
    """Reduce: of a segment's hashes, tell a row those that occur elsewhere too, and those whose class it stands for."""

    def run(key, t):
        out: list[tuple] = []
        parts = []
        for kind, i, th, blob in zip(*(t.column(c).to_pylist() for c in ("kind", "id", "th", "blob"))):
            if kind:
                out.append((i, th, None, blob, None))
            else:
                parts.append(_unpack(blob, "<u8", "<i8", "<i8", "<u4"))
        if parts:
            h, ids, ths, n = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((ths, ids, h))
            h, ids, ths, n = h[order], ids[order], ths[order], n[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[first, len(h)])
            total = np.add.reduceat(n.astype(np.int64), first)
            again = np.repeat(total > 1, size)
            own = np.zeros(len(h), bool)
            own[first[total > 1]] = True
            tell = again & ((n == 1) | own)
            hot = h[first[total > hot_from]]
            if len(hot):
                out.append((None, None, (hot % np.uint64(FILTER_BITS)).astype("<u4").tobytes(), None, None))
            h, ids, ths, own = h[tell], ids[tell], ths[tell], own[tell]
            order = np.lexsort((ths, ids))
            h, ids, ths, own = h[order], ids[order], ths[order], own[order]
            at = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1])]).tolist() if len(h) else []
            for i, j in zip(at, [*at[1:], len(h)]):
                out.append((int(ids[i]), int(ths[i]), None, h[i:j].tobytes(), h[i:j][own[i:j]].tobytes()))
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "th", "hot", "seen", "own"])

    return run


# --- front-coded runs and their merge


class Item:
    """A suffix s at an anchor, with what stands before it, c, away from the anchor."""

    __slots__ = ("s", "c", "id", "th", "at", "left", "settled")

    def __init__(self, s, c, id, th, at, left, settled):
        self.s, self.c, self.id, self.th, self.at, self.left, self.settled = s, c, id, th, at, left, settled


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which the first `known` bytes needn't be read."""
    x, y = a[known:], b[known:]
    n = min(len(x), len(y))
    diff = int.from_bytes(x[:n], "little") ^ int.from_bytes(y[:n], "little")
    return known + (((diff & -diff).bit_length() - 1) >> 3 if diff else n)


def _front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    shared = [0, *(common(a, b) for a, b in zip(strings, strings[1:]))]
    return np.array(shared, "<u2"), np.array(list(map(len, strings)), "<u2"), b"".join(s[k:] for s, k in zip(strings, shared))


def write_run(items: list[Item]) -> bytes:
    """A front-coded run of items in order of their suffixes."""
    items.sort(key=lambda x: (x.s, x.c))
    shared, size, rest = _front_code([x.s for x in items])
    before = [x.c for x in items]
    return _pack(
        shared,
        size,
        np.frombuffer(rest, np.uint8),
        np.array(list(map(len, before)), "<u2"),
        np.frombuffer(b"".join(before), np.uint8),
        np.array([x.id for x in items], "<i8"),
        np.array([x.th for x in items], "<i8"),
        np.array([x.at for x in items], "<i8"),
        np.array([x.left * 2 + x.settled for x in items], np.uint8),
    )


def read_run(blob: bytes) -> Iterator[tuple[int, Item]]:
    """(shared prefix with the one before, item) in order."""
    shared, size, rest, csize, before, ids, ths, at, flags = _unpack(blob, "<u2", "<u2", "u1", "<u2", "u1", "<i8", "<i8", "<i8", "u1")
    rest, before = rest.tobytes(), before.tobytes()
    s, i, j = b"", 0, 0
    for k, n, m, a, b, c, f in zip(shared.tolist(), size.tolist(), csize.tolist(), ids.tolist(), ths.tolist(), at.tolist(), flags.tolist()):
        s = s[:k] + rest[i : i + n - k]
        i += n - k
        yield k, Item(s, before[j : j + m], a, b, c, f >> 1, f & 1)
        j += m


def merge_runs(runs: list[Iterator[tuple[int, Item]]]) -> Iterator[tuple[int, Item]]:
    """Merge with a loser tree.  Every contender knows its common prefix with the last one put out: the longer one
    wins unread; if they are equal, bytes are compared from there on, and the loser learns its prefix with the winner."""
    size = 1
    while size < len(runs):
        size *= 2
    head: list[Item | None] = [None] * size
    known = [-1] * size

    def advance(r: int) -> None:
        nxt = next(runs[r], None) if r < len(runs) else None
        known[r], head[r] = nxt if nxt else (-1, None)

    def beats(a: int, b: int) -> bool:
        if known[a] != known[b]:
            return known[a] > known[b]
        if known[a] < 0:
            return True
        x, y = head[a].s, head[b].s
        n = common(x, y, known[a])
        if n == len(x) or n < len(y) and x[n] < y[n]:
            known[b] = n
            return True
        known[a] = n
        return False

    for r in range(size):
        advance(r)
    loser = [0] * size
    winner = list(range(size, 2 * size))
    layer = list(range(size))
    at = size
    while at > 1:
        at //= 2
        nxt = []
        for i in range(at):
            a, b = layer[2 * i], layer[2 * i + 1]
            if beats(a, b):
                loser[at + i], w = b, a
            else:
                loser[at + i], w = a, b
            nxt.append(w)
        layer = nxt
    top = layer[0]
    del winner
    while head[top] is not None:
        yield known[top], head[top]
        advance(top)
        node = (size + top) // 2
        while node:
            if not beats(top, loser[node]):
                loser[node], top = top, loser[node]
            node //= 2


def covered(group: list[Item], shared: list[int]) -> Iterator[tuple[Item, int, int]]:
    """(item, start, end): bytes in windows that occur at another item of the group, all of which share a core.

    shared: common prefixes of neighbours, the first unused.  A window takes c bytes before the anchor and LENGTH - c
    from it on; it occurs elsewhere if another item agrees in both.  Which do is the same for all c between two places
    where either order's classes change."""
    n = len(group)

    def bytes_of(x: Item, least: int, most: int) -> tuple[Item, int, int]:
        return (x, x.at - LENGTH + least, x.at + most) if x.left else (x, x.at - most, x.at + LENGTH - least)

    if n <= 3:
        for i in range(n):
            for j in range(i + 1, n):
                s, c = min(shared[i + 1 : j + 1]), common(group[i].c, group[j].c)
                if s + c >= LENGTH:
                    for x in (group[i], group[j]):
                        if not x.settled:
                            yield bytes_of(x, LENGTH - s, c)
        return
    ss = np.array(shared)
    ss[0] = -1
    order = sorted(range(n), key=lambda i: group[i].c)
    cs = np.array([-1, *(common(group[i].c, group[j].c) for i, j in zip(order, order[1:]))])
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    turns = np.unique(np.concatenate([[0], cs[1:] + 1, LENGTH - ss[1:]]))
    turns = turns[(turns >= 0) & (turns <= SIDE)]
    loose = np.array([not x.settled for x in group])
    hits = np.zeros((len(turns) + 2, n), bool)  # by turn, with an empty one at either end
    step = max(1, MATRIX // n)
    for k in range(0, len(turns), step):
        lo = turns[k : k + step, None]
        both = np.cumsum(ss[None, :] < LENGTH - lo, axis=1) * (n + 1) + np.cumsum(cs[None, :] < lo, axis=1)[:, back]
        by = np.argsort(both, axis=1, kind="stable")
        line = np.take_along_axis(both, by, axis=1)
        same = line[:, 1:] == line[:, :-1]
        twice = np.zeros(line.shape, bool)
        twice[:, 1:] |= same
        twice[:, :-1] |= same
        np.put_along_axis(hits[k + 1 : k + 1 + len(lo)], by, twice, axis=1)
    hits &= loose
    first = np.argwhere((hits[1:] & ~hits[:-1]).T).tolist()
    last = np.argwhere((~hits[1:] & hits[:-1]).T).tolist()
    ends = [*turns.tolist(), SIDE + 1]
    for (i, a), (_, b) in zip(first, last):
        yield bytes_of(group[i], ends[a], ends[b] - 1)


FOUND = "id long, th long, ranges binary"
SENT = "bucket int, kind int, id long, th long, blob binary"


def _send_windows(h: np.ndarray, wh: np.ndarray, place: np.ndarray, buckets: int, ids: list, ths: list) -> Iterator[tuple]:
    """Rows for a batch's windows.  Where the batch has a window twice, all its places are found; one goes on."""
    order = np.lexsort((place, wh, h))
    h, wh, place = h[order], wh[order], place[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (wh[1:] != wh[:-1])]
    # One window may come from several anchors with the same core.
    once = new | np.r_[True, place[1:] != place[:-1]]
    h, wh, place, new = h[once], wh[once], place[once], new[once]
    row, at = (place >> np.uint64(40)).astype(np.int64), (place & np.uint64((1 << 40) - 1)).astype(np.int64)
    n = np.diff(np.r_[np.flatnonzero(new), len(h)])
    many = np.flatnonzero(np.repeat(n > 1, n))
    many = many[np.argsort(row[many], kind="stable")]
    cuts = np.flatnonzero(np.r_[True, np.diff(row[many]) != 0]).tolist() if len(many) else []
    for i, j in zip(cuts, [*cuts[1:], len(many)]):
        r = int(row[many[i]])
        ranges = np.array(union(np.stack([at[many[i:j]], at[many[i:j]] + LENGTH], 1)), "<i8")
        yield r % buckets, 1, ids[r], ths[r], ranges.tobytes()
    all_ids, all_ths = np.array(ids, np.int64), np.array(ths, np.int64)
    h, wh, row, at = h[new], wh[new], row[new], at[new]
    bucket = (wh % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    h, wh, row, at, bucket = h[order], wh[order], row[order], at[order], bucket[order]
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket) != 0]).tolist()
    for i, j in zip(cuts, [*cuts[1:], len(h)]):
        yield int(bucket[i]), 2, None, None, _pack(h[i:j], wh[i:j], all_ids[row[i:j]], all_ths[row[i:j]], at[i:j])


def _send(buckets: int, hot):
    """Map: runs of the anchors that are left, windows of hot cores, and the bytes around settled anchors."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.frombuffer(hot.value, np.uint8) if hot.value else None
        is_hot = lambda h: bits is not None and bits[(h % FILTER_BITS) >> 3] >> (h & 7) & 1
        ids, ths = batch.column("id").to_pylist(), batch.column("th").to_pylist()
        lists = [[b"".join(x or ()) for x in batch.column(c).to_pylist()] for c in ("seen", "own")]
        out: list[tuple] = []
        runs: dict[int, list[Item]] = {}
        windows = (array("Q"), array("Q"), array("Q"))  # core, window, row and place
        done: dict[int, list[int]] = {}
        row_now, seen, own = -1, frozenset(), frozenset()
        for row, buf, a, b, p in _spots(batch):
            if row != row_now:
                row_now = row
                seen, own = (frozenset(np.frombuffer(x[row], "<u8").tolist()) for x in lists)
            if not seen:
                continue
            r, l = _right_core(buf, a, b, p), _left_core(buf, a, b, p)
            if r not in seen and l not in seen:
                continue
            w, w2 = _whole(buf, a, b, p)
            settled = w in seen and w2 in seen
            if settled:
                i, j = max(a, p - LENGTH + GRAM), min(b, p + LENGTH)
                if j - i >= LENGTH:
                    done.setdefault(row, []).extend((i - a, j - a))
                if w not in own and w2 not in own:
                    continue
            for left, h in ((0, r), (1, l)):
                if h not in seen:
                    continue
                if is_hot(h):
                    # Windows of this side, one by one; l takes those that r hasn't.
                    for c in range(0, SIDE + 1) if not left else range(SIDE + 1, LENGTH - GRAM + 1):
                        s = p - c
                        if s >= a and s + LENGTH <= b:
                            windows[0].append(h)
                            windows[1].append(_h64(buf[s : s + LENGTH], 4))
                            windows[2].append(row << 40 | s - a)
                    continue
                if left:
                    s, c, at = buf[max(a, p + GRAM - LENGTH) : p + GRAM][::-1], buf[p + GRAM : min(b, p + GRAM + SIDE)], p + GRAM - a
                else:
                    s, c, at = buf[p : min(b, p + LENGTH)], buf[max(a, p - SIDE) : p][::-1], p - a
                runs.setdefault(h % buckets, []).append(Item(s, c, ids[row], ths[row], at, left, int(settled)))
        for row, ranges in done.items():
            out.append((row % buckets, 1, ids[row], ths[row], np.array(ranges, "<i8").tobytes()))
        for bucket, items in runs.items():
            out.append((bucket, 0, None, None, write_run(items)))
        if windows[0]:
            out += _send_windows(*(np.frombuffer(x, np.uint64) for x in windows), buckets, ids, ths)
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["bucket", "kind", "id", "th", "blob"])

    return run


def _merge(key, t):
    """Reduce: the repeated bytes that a bucket's runs and windows show, and those already found."""
    found: dict[tuple[int, int], list[int]] = {}
    out: list[tuple] = []
    runs, windows = [], []
    for kind, i, th, blob in zip(*(t.column(c).to_pylist() for c in ("kind", "id", "th", "blob"))):
        if kind == 1:
            out.append((i, th, blob))
        elif kind == 0:
            runs.append(read_run(blob))
        else:
            windows.append(_unpack(blob, "<u8", "<u8", "<i8", "<i8", "<i8"))

    def close(group: list[Item], shared: list[int]) -> None:
        for side in (0, 1):
            own = [k for k, x in enumerate(group) if x.left == side]
            if len(own) > 1:
                near = [0, *(min(shared[i + 1 : j + 1]) for i, j in zip(own, own[1:]))]
                for x, a, b in covered([group[k] for k in own], near):
                    found.setdefault((x.id, x.th), []).extend((a, b))

    group: list[Item] = []
    shared: list[int] = []
    for k, x in merge_runs(runs) if runs else ():
        if k < CORE and group:
            close(group, shared)
            group, shared = [], []
        group.append(x)
        shared.append(k)
    if group:
        close(group, shared)
    if windows:
        h, wh, ids, ths, at = (np.concatenate(x) for x in zip(*windows))
        order = np.lexsort((wh, h))
        h, wh, ids, ths, at = h[order], wh[order], ids[order], ths[order], at[order]
        same = (h[1:] == h[:-1]) & (wh[1:] == wh[:-1])
        for i in np.flatnonzero(np.r_[False, same] | np.r_[same, False]).tolist():
            found.setdefault((int(ids[i]), int(ths[i])), []).extend((int(at[i]), int(at[i]) + LENGTH))
    out += [(i, th, np.array(r, "<i8").tobytes()) for (i, th), r in found.items()]
    cols = list(zip(*out)) if out else [[]] * 3
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["id", "th", "ranges"])


def union(ranges: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of (start, end) pairs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, ranges.reshape(-1, 2).tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, ranges): for each document the byte ranges (pairs of longs) covered by strings that start elsewhere too.

    id and th are the document's id (null: 0) and a hash of its text; rows that share both are copies."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    buckets = 8 * partitions(spark)
    counted = map_batches(rows, _count(buckets), COUNTED)
    # Hot cores: no more than an eighth of the filter's bits, as counts add up to at most four for each anchor.
    size = rows.agg(F.sum(F.length(F.col("text").cast("binary")))).first()[0] or 0
    hot_from = max(HOT, size // 30 // (FILTER_BITS // 8))
    told = cut(counted.groupBy("seg").applyInArrow(_tell(hot_from), TOLD), "told")
    hot = np.zeros(FILTER_BITS // 8, np.uint8)
    any_hot = False
    for r in told.where("hot is not null").select("hot").toLocalIterator():
        at = np.frombuffer(r.hot, "<u4")
        np.bitwise_or.at(hot, at >> 3, (1 << (at & 7)).astype(np.uint8))
        any_hot = True
    shared = spark.sparkContext.broadcast(hot.tobytes() if any_hot else b"")
    lists = told.where("id is not null").groupBy("id", "th").agg(F.collect_list("seen").alias("seen"), F.collect_list("own").alias("own"))
    lists = lists.select(F.col("id").alias("i"), F.col("th").alias("t"), "seen", "own").hint("merge")
    sent = map_batches(rows.join(lists, (F.col("id") == F.col("i")) & (F.col("th") == F.col("t"))).select("id", "th", "text", "seen", "own"), _send(buckets, shared), SENT)
    found = sent.groupBy("bucket").applyInArrow(_merge, FOUND)
    return cut(found, "repeats").groupBy("id", "th").agg(F.collect_list("ranges").alias("ranges"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    th = F.xxhash64(F.coalesce(text_col, F.lit("")), F.col(id_col).isNull())
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), th.alias("th"), F.coalesce(text_col, F.lit("")).alias("text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' ids with n_bytes, n_removed, n_spans, kept (binary) and spans: each byte of the text (UTF-8, null: empty)
    goes that is covered by a LENGTH-byte string that starts anywhere else, the same document included.

    Strings never cross documents and are judged on the input.  Texts below LENGTH bytes stay whole.  Repeated rows are
    copies of each other; rows without an id take part.  Other columns are ignored; an empty table gives an empty
    result.
    """
    lost = repeated_bytes(docs, id_col, text_col).select(F.col("id").alias("i"), F.col("th").alias("t"), "ranges").hint("merge")
    whole = keyed(docs, id_col, text_col).withColumn("null_id", F.col("th") != F.xxhash64("text", F.lit(False)))
    joined = whole.join(lost, (F.col("id") == F.col("i")) & (F.col("th") == F.col("t")), "left").select("id", "null_id", "text", "ranges")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, gone, spans, kept = [], [], [], []
        for t, ranges in zip(batch.column("text"), batch.column("ranges")):
            raw = t.as_py().encode("utf-8", "surrogatepass")
            out = union(np.frombuffer(b"".join(ranges.as_py()), "<i8")) if ranges.is_valid else []
            at, parts = 0, []
            for a, b in out:
                parts.append(raw[at:a])
                at = b
            kept.append(b"".join([*parts, raw[at:]]))
            sizes.append(len(raw))
            gone.append(len(raw) - len(kept[-1]))
            spans.append([{"start": a, "end": b} for a, b in out])
        ids = [None if n else i for i, n in zip(batch.column("id").to_pylist(), batch.column("null_id").to_pylist())]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        cols = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(list(map(len, spans)), pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)]
        return pa.record_batch(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return map_batches(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>")


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
