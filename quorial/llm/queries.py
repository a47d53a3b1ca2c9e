"""The registered queries of the text operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .archive import archive_round_trip
from .bpe import bpe_round_trip
from .common import table
from .decontaminate import benchmark_hits
from .fingerprints import fingerprints
from .licenses import license_scan
from .licenses import oracle as license_sql
from .ngram_join import ngram_join
from .pii import personal_data_digest
from .phrases import oracle as phrase_sql
from .phrases import phrases
from .secrets import secret_scan
from .token_counts import token_counts
from .tool_calls import conversation_calls
from .toxicity import toxicity
from .vector_codes import oracle as codes_sql
from .vector_codes import vector_codes


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_calls(table(spark, sf_dir, "conversations"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_fingerprints, op3_ngram_join, op4_tool_calls, op5_secrets, op6_token_counts, op7_decontamination, op8_licenses, op9_bpe, op10_warc, op11_vector_codes, op12_personal_data, op13_phrases)
}

#: DuckDB twins.  The others are tested against brute force in ``tests/llm``.
ORACLE_SQL: dict[str, str] = {
    # a call's chain is a run of calls at most two turns apart
    "op4_tool_calls": """
        WITH asks AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'instruct' ELSE 'ask' END AS name, text,
                             CASE WHEN text IS NULL THEN '' ELSE '"text":' || CAST(to_json(text) AS VARCHAR) || ',' END AS head
                      FROM conversations WHERE role IN ('system', 'user') AND conv_id IS NOT NULL AND turn IS NOT NULL),
        one AS (SELECT * FROM asks QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY name, '{' || head || '"turn":') = 1),
        run AS (SELECT *, CASE WHEN turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) <= 2 THEN 0 ELSE 1 END AS opens FROM one),
        numbered AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn) AS chain FROM run),
        calls AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, chain ORDER BY turn) - 1 AS INTEGER) AS level FROM numbered),
        results AS (SELECT conv_id, turn - 1 AS turn, text AS content FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL
                    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS FIRST) = 1),
        both_ AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, 'call-' || coalesce(c.turn, r.turn) AS call_id, c.turn, level, name, text, head, content,
                         CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status
                  FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.turn = r.turn)
        SELECT conv_id, call_id, level, status, CASE WHEN turn IS NOT NULL THEN text IS NOT NULL END AS valid,
               CASE WHEN turn IS NOT NULL THEN CASE WHEN text IS NULL THEN 'text' ELSE '' END END AS broken,
               '{' || CASE WHEN turn IS NOT NULL THEN '"arguments":{' || head || '"turn":' || turn || '},' ELSE '' END || '"id":"' || call_id || '",'
                   || CASE WHEN turn IS NOT NULL THEN '"level":' || level || ',"name":"' || name || '",' ELSE '' END
                   || CASE WHEN content IS NOT NULL THEN '"result":' || CAST(to_json(content) AS VARCHAR) || ',' ELSE '' END || '"status":"' || status || '"}' AS json
        FROM both_""",
    "op8_licenses": license_sql(),
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        q AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest, min(page_id) OVER (PARTITION BY body) AS owner FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> owner THEN owner END AS refers_to
        FROM q""",
    "op11_vector_codes": codes_sql(),
    "op13_phrases": phrase_sql(),
}
