"""A training corpus from documents: toxic ones out, repeated lines out, one of each group of near copies, sources mixed
to their weights, and token ids.

STAGES are applied in order; each gets what the one before it kept, written and read again.  All but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, linededup, mixing, simhash, toxicity
from tessera.llm.common import cut, table
from tessera.llm.queries import RANKS, toxicity_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of this score or more are rejected.
TOXIC = 0.7


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model, learnt from the labels that aren't held out, finds no toxic passage in."""
    model = toxicity_model(spark, sf_dir)
    return toxicity.score(docs.select(*COLUMNS), model, score_col="_toxic").where(F.col("_toxic") < TOXIC).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more of them share; n_chars follows the text."""
    kept = linededup.dedup_lines(docs.select(*COLUMNS))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return simhash.keep_one(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in their source's share; some more than once."""
    return mixing.mixture(docs.select(*COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, a row for each document of the mix."""
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash", one_of_near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: A model and near copies can't be expressed in SQL; stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
