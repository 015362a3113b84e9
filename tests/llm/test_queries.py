"""The registered queries over a small folder of tables, against brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessera.llm import queries as Q
from tessera.llm.bpe import read_ranks

from . import test_linededup, test_mixing, test_simhash, test_suffix, test_topk
from .data import DOCS, sentence
from .test_htmltext import PAGE

ROWS = [*DOCS, *((500 + i, t, f"s{i % 4}") for i, t in enumerate(test_suffix.corpus()[:40]))]
LINES = [(700 + i, f"a line that all of these documents have\n{sentence(i, 12)}", "l") for i in range(6)]
ROWS += LINES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in ROWS]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 2)) for i, _, _ in ROWS if i], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "u", PAGE), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    vectors = [(i, [((i * 37 + j * j) % 19 - 9) / 17 for j in range(8)]) for i in range(90)] + [(200, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


def run(spark, folder, name):
    return Q.queries()[name](spark, folder)


def test_op1(spark, folder):
    got = sorted((str(r.doc_id), int(np.uint64(int(r.fingerprint, 16)).astype(np.int64)), r.component_id) for r in run(spark, folder, "op1_simhash").collect())
    assert got == test_simhash.brute(ROWS)


def test_op2(spark, folder):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in run(spark, folder, "op2_html_text").collect()}
    text = "A & B One two. It said “yes”, and then left. Then it came back. Last <one>."
    assert got == {1: ("u", text, len(text)), 2: (None, "", 0)}


def test_op3(spark, folder):
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in run(spark, folder, "op3_line_dedup").collect())
    assert got == test_linededup.brute(ROWS)


def test_op4(spark, folder):
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(Q.RANKS)), special_tokens={})
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, folder, "op4_bpe").collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted((str(i), len(k), sha(",".join(map(str, k)).encode()), sha((t or "").encode())) for i, t, _ in ROWS for k in [theirs.encode_ordinary(t or "")])


def test_op5(spark, folder):
    rows = run(spark, folder, "op5_toxicity").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op6(spark, folder):
    rows = run(spark, folder, "op6_passages").collect()
    got = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == len(ROWS) and got[2] == got[3] == 1 and got[10] == 10


def test_op7(spark, folder):
    for r in run(spark, folder, "op7_matroska").collect():
        assert r.payload_bytes % 64 == 0 and 0 <= r.payload_bytes - r.n_bytes <= 64 and r.media_bytes > r.payload_bytes


def test_op8(spark, folder):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted(map(tuple, run(spark, folder, "op8_topk").select("query_id", "rank", "vec_id", "score").collect())) == test_topk.brute(vectors, 20)


def test_op9(spark, folder):
    rows = run(spark, folder, "op9_mixing").collect()
    sizes = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = test_mixing.share(sizes)
    assert len(rows) == len(ROWS) and all(abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source] for r in rows)


def test_op10(spark, folder):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, folder, "op10_suffix_dedup").collect())
    want = []
    for (i, t, _), spans in zip(ROWS, test_suffix.brute([t for _, t, _ in ROWS])):
        raw, at, kept = (t or "").encode(), 0, b""
        for a, b in spans:
            kept, at = kept + raw[at:a], b
        kept += raw[at:]
        want.append((str(i), len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)
