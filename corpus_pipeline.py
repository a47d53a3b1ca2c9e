"""The corpus pipeline: five stages from raw documents to token digests.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written
as Parquet in the shared folder and reread as the next stage's documents.  All but
the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorial.llm.bpe import bpe_round_trip
from quorial.llm.common import stored, table
from quorial.llm.decontaminate import decontaminate
from quorial.llm.ngram_join import keep_one
from quorial.llm.secrets import redact
from quorial.llm.toxicity import keep_clean


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; null and empty texts stay, copies stay or go together."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Null texts are empty texts, of which one stays; documents with a null id all stay,
    and so do rows that repeat the id and text of the one that stays."""
    return keep_one(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such go.  Null and empty
    texts stay; an empty benchmark changes nothing."""
    return _measured(decontaminate(docs, table(spark, sf_dir, "benchmark")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials are masked; every document stays, null and empty texts as they are."""
    return _measured(redact(docs))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of what they decode to, for every row; a null
    text has no tokens."""
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_benchmark_text),
    ("secrets", mask_secrets),
    ("tokens", tokenise),
]

#: Learned scores, automata and merges are beyond SQL.  Tests hold the operators of the stages
#: against brute force, and the stages on planted rows: what stays, its texts and its tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
