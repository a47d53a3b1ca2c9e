"""Token counts and byte-pair codes against the tokenizers library."""

import gc
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quorial.llm.bpe import Codec, bpe_round_trip
from quorial.llm.common import tidy
from quorial.llm.decontaminate import decontaminate
from quorial.llm.token_counts import TokenCounter, token_counts
from quorial.llm.toxicity import word_counts

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
FIXED = ["", " ", "a", "aaaa" * 400, "it's  we'll\n\n x", "<|endoftext|>", "a<|startoftext|> b<|endoftext|><|", "ΑΣ ΟΔΟΣ Σ", "é é ẛ̣", "\x00a \x1c b\x85c", "日本語 text 123 ١٢٣ ½", "tab\tend \n", "　wide line", "🙂🙃 x🙂"]


def texts():
    rng = random.Random(4)
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x391, 0x3CA), *range(0x2000, 0x2030), 0x3000, 0x301, 0x4E2D, 0x1F600, 10, 9]]
    return FIXED + ["".join(rng.choice(pool) if rng.random() < 0.4 else rng.choice("ab c'st re<|>\n12") for _ in range(rng.randint(0, 60))) for _ in range(400)]


def test_counts():
    lib, own = Tokenizer.from_file(WORD), TokenCounter(open(WORD, "rb").read())
    want = [len(e.ids) for e in lib.encode_batch(texts(), add_special_tokens=False)]
    assert own.batch(pa.array(texts())).tolist() == want


def test_codes():
    lib, own = Tokenizer.from_file(BYTE), Codec(open(BYTE, "rb").read())
    codes = [ids[e[i] : e[i + 1]] for e, ids in own.batch(pa.array(texts())) for i in range(len(e) - 1)]
    for text, got in zip(texts(), codes, strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want, text
        assert own.encode(text) == np.array(want, "<u4").tobytes()
        assert own.decode(own.encode(text)).decode("utf-8", "replace") == lib.decode(want, skip_special_tokens=False) == text


ROWS = [(1, "hello world", "x"), (1, "hello world", "y"), (None, None, "z"), (2, "", None), (3, "w " * 3000, "")]


@pytest.mark.parametrize("operator,path", [(token_counts, WORD), (bpe_round_trip, BYTE)])
def test_odd_rows(spark, operator, path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string")
    out = {(r.doc_id, r.n_tokens) for r in operator(df, path).collect()}
    assert out == {(1, 2), (None, 0), (2, 0), (3, 3000 if operator is token_counts else 3001)}
    assert operator(df, path).count() == 5
    assert operator(df.limit(0), path).count() == 0


def test_digests_and_limit(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, extra string")
    r = bpe_round_trip(df, BYTE, keep_ids=True, keep_text=True).where("doc_id = 1").first()
    assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.decoded == "hello world"
    assert r.decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()
    assert {(r.doc_id, r.n_bytes, r.over_limit) for r in token_counts(df, WORD).collect()} >= {(3, 6000, True), (None, 0, False)}


@pytest.mark.parametrize("operator", [lambda df: bpe_round_trip(df, BYTE), lambda df: decontaminate(df, df.limit(0), item_col="doc_id"), lambda df: word_counts(df.select("text"))])
def test_batches_sent_to_workers_are_bounded_by_bytes(spark, operator):
    df = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 5000) AS text")

    def look(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        spark.conf.unset(limit)
        operator(df)
        seen = df.mapInArrow(look, "n long, size long").collect()
        assert sum(r.n for r in seen) == 3000 and max(r.size for r in seen) < 5 << 20
        spark.conf.set(limit, "1m")
        operator(df)
        assert spark.conf.get(limit) == "1m"
    finally:
        spark.conf.unset(limit)


def test_workers_drop_the_vocabulary_for_other_tasks(spark):
    df = spark.range(0, 8, 1, 8).selectExpr("id AS doc_id", "'some words' AS text")
    assert {r.n_tokens for r in bpe_round_trip(df, BYTE).collect()} == {2}

    def look(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "Codec" for x in gc.get_objects())])], ["n"])

    assert sum(r.n for r in df.mapInArrow(tidy(look), "n long").collect()) == 0
    assert {r.n_tokens for r in bpe_round_trip(df, BYTE).collect()} == {2}
