import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.bpe import Codec, PerfectHash, decode_column, encode_column, read_ranks, round_trip

from .data import DOCS, frame

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = Codec(RANKS, P.PATTERN)


def test_perfect_hash():
    table = PerfectHash(RANKS)
    assert all(table.get(k) == v for k, v in RANKS.items())
    assert len(table.keys) == len(RANKS) and table.get(b"\xff\xfe no token") is None
    assert PerfectHash({}).get(b"x") is None


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_encodes_as_the_library_does(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = OURS.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


def test_round_trip(spark):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(frame(spark), PATH, P.PATTERN).collect())
    want = []
    for i, t, _ in DOCS:
        ids = THEIRS.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    df = decode_column(encode_column(frame(spark), PATH, P.PATTERN), PATH, P.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in df.collect())
    assert round_trip(frame(spark, []), PATH, P.PATTERN).collect() == []
