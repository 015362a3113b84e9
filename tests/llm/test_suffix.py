import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix as S

from .data import DOCS, frame, sentence


def brute(texts):
    """Covered byte ranges of each text: the union of its 400-byte windows that occur more than once in all."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + S.LENGTH] for r in raw for i in range(len(r) - S.LENGTH + 1))
    out = []
    for r in raw:
        spans = [x for i in range(len(r) - S.LENGTH + 1) if seen[r[i : i + S.LENGTH]] > 1 for x in (i, i + S.LENGTH)]
        out.append(S.union(np.array(spans)) if spans else [])
    return out


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (60, 75, 82, 90, 120, 300)]
    texts = []
    for _ in range(60):
        parts = [prose(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 4)
            parts += [p[a : len(p) - rng.randint(0, len(p) // 4)], prose(rng.randint(0, 60))]
        texts.append(rng.choice([" ", "", "\n"]).join(parts))
    for i in range(12):  # copies with edits
        t = list(texts[i % 4] + prose(200))
        for _ in range(i % 5):
            t[rng.randrange(len(t))] = "Z"
        texts.append("".join(t))
    texts += [texts[3]] * 3 + ["a" * 399, "a" * 400, "b" * 401, "xy" * 700, "xy" * 450 + "q" + "xy" * 260, "é" * 350 + prose(40), "é" * 350, "", " "]
    return texts


@pytest.mark.parametrize("hot", [20_000, 3])
def test_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    texts = [t for _, t, _ in DOCS] + corpus()
    ids = [i for i, _, _ in DOCS] + list(range(1000, 1000 + len(texts) - len(DOCS)))
    df = frame(spark, [(i, t, "s") for i, t in zip(ids, texts)]).repartition(5)
    want = []
    for i, t, spans in zip(ids, texts, brute(texts)):
        raw = (t or "").encode()
        gone = sum(b - a for a, b in spans)
        want.append((str(i), len(raw), gone, len(spans), tuple(spans)))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, tuple(map(tuple, r.spans))) for r in S.remove_repeats(df).collect()]
    assert sorted(got) == sorted(want)
    assert sum(w[3] for w in want) > 40
    kept = {(str(r.doc_id), len(r.kept)) for r in S.remove_repeats(df).collect()}
    assert {(w[0], w[1] - w[2]) for w in want} == kept


def test_large_groups_agree_with_pairs():
    rng = random.Random(1)
    core = "".join(rng.choice("abc") for _ in range(S.CORE)).encode()
    tails = [bytes(rng.choice(b"ab") for _ in range(184)) for _ in range(4)]
    items = []
    for k in range(90):
        t, u = rng.choice(tails), rng.choice(tails)
        n, m = rng.randint(0, 184), rng.randint(0, 184)
        s = core + t[:n] + bytes(rng.choice(b"xyz") for _ in range(184 - n))
        c = u[:m] + bytes(rng.choice(b"xyz") for _ in range(184 - m))
        items.append(S.Item(s[: rng.choice((400, 300))], c[: rng.choice((184, 90))], k, 0, 1000, k % 2 * 0, 0))
    items.sort(key=lambda x: x.s)
    shared = [0, *(S.common(a.s, b.s) for a, b in zip(items, items[1:]))]
    want = {}
    for x in items:
        spans = []
        for y in items:
            s, c = S.common(x.s, y.s), S.common(x.c, y.c)
            if x is not y and s + c >= S.LENGTH:
                spans += [x.at - c, x.at + s]
        if spans:
            want[x.id] = S.union(np.array(spans))
    got = {}
    for x, a, b in S.covered(items, shared):
        got.setdefault(x.id, []).extend((a, b))
    assert {k: S.union(np.array(v)) for k, v in got.items()} == want and len(want) > 10


def test_runs_merge_in_order():
    rng = random.Random(2)
    runs, every = [], []
    for r in range(7):
        items = [S.Item(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))), b"", r, 0, i, 0, 0) for i in range(rng.randint(0, 60))]
        every += [x.s for x in items]
        runs.append(S.write_run(items))
    merged = list(S.merge_runs([S.read_run(b) for b in runs]))
    strings = [x.s for _, x in merged]
    assert strings == sorted(every)
    assert [k for k, _ in merged][1:] == [S.common(a, b) for a, b in zip(strings, strings[1:])]


def test_equal_windows_have_equal_anchors():
    a = sentence(9, 400).encode()
    for shift in (0, 1, 17, 300):
        b = sentence(10, 50).encode()[:shift] + a[200:1500] + b"end" * 100
        pa, pb = S.anchors(a, [(0, len(a))]), S.anchors(b, [(0, len(b))])
        inside = lambda p, off: {x - off for x in p.tolist() if off + 370 <= x <= off + 1300 - 400}
        assert inside(pa, 200) == inside(pb, shift) and len(pa) < len(a) / 100


def test_empty_table(spark):
    assert S.remove_repeats(frame(spark, [])).collect() == []
