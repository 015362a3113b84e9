import hashlib
import importlib

import public_tokenizers
import pytest
import tiktoken

from tessera.llm.bpe import read_ranks

from .data import sentence

pipeline = importlib.import_module("corpus_pipeline")
LINE = "All rights are reserved by nobody in particular"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = [], []
    for i in range(300):
        text = sentence(i, 30 + i % 70)
        if i % 5 == 0:
            text = f"{text} vilest {sentence(i + 900, 10)} vilest rotten"
        if i % 7 == 0:
            text = f"{LINE}\n{text}"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(i % 9 > 0), int(i % 5 == 0)))
    for i in range(300, 320):
        copy = rows[i - 299]
        rows.append((i, copy[1] + " end", "en", copy[3], copy[4] + 4))
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), (None, sentence(77777, 20), "en", "s2", len(sentence(77777, 20)))]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == pipeline.COLUMNS
    ids = lambda name: {r.doc_id for r in kept[name]}
    assert not {i for i in range(0, 300, 5)} & ids("toxicity")
    assert {400, 401, None} <= ids("toxicity") and len(ids("toxicity")) > 240
    assert len(kept["line_dedup"]) == len(kept["toxicity"])
    holders = [r.doc_id for r in kept["line_dedup"] if LINE in (r.text or "")]
    assert len(holders) == 1 and all(r.n_chars == len(r.text) for r in kept["line_dedup"] if r.text)
    assert ids("simhash") <= ids("line_dedup") and not any(i in ids("simhash") for i in range(300, 320))
    assert len(kept["simhash"]) >= len(kept["line_dedup"]) - 23
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(words(kept["mixing"]) - words(kept["simhash"])) < 200
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted((str(r.doc_id), len(codec.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept["mixing"])
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in kept["bpe"]) == want


def test_run_gives_the_last_stage(spark, folder):
    assert pipeline.run(spark, folder).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_with_awkward_tables(spark, folder):
    """Extra columns with clashing names go, repeated and null rows are handled, an empty table stays empty."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    some = docs.where("doc_id < 12 or doc_id >= 300 or doc_id is null")
    for name in ("_toxic", "score", "n_lines", "_gone", "size", "copies", "_key", "ids", "fp"):
        some = some.withColumn(name, F.lit("x"))
    some = some.union(some.where("doc_id = 1"))
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, some, folder)
        assert out.count() > 0
        if name != "bpe":
            assert out.columns == pipeline.COLUMNS
        assert stage(spark, empty, folder).collect() == []
