"""SpotSigs fingerprints.

A spot is a common word; the chain of content words that follow it is its
signature.  A document's fingerprint is the set of its signatures.  Fingerprints
are compared by Jaccard likeness, pruned by their sizes, and the near-copy join
partitions them by size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, pick, sha256_hex, texts, tidy, word_hashes

#: Fixed: common words of English, German, French and Spanish that open a spot.
ANCHORS = """
the of and to in a is was for on that with it as be by are from or an at this not
der die das und ist ein eine zu den von mit auf dem des im nicht sich als
le la les de et un une du que qui en est dans pour par au il elle
el los las y por con para del se al no su lo
""".split()
#: Content words in a chain.
CHAIN = 2

_ANCHOR_HASHES = np.sort(word_hashes([" ".join(ANCHORS)])[0])


def signatures(text: str) -> np.ndarray:
    """The sorted set of a text's signatures as 32-bit numbers.

    A chain at the end of a text may be shorter.  A text without a spot that content
    follows gives its pairs of neighbouring words, one with a single word that word,
    and one without words a single number made from the raw text; so the set is
    never empty and equal texts have equal sets.
    """
    return _signatures(text, word_hashes([text])[0])


def _signatures(text: str, h: np.ndarray) -> np.ndarray:
    if not len(h):
        raw = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest()
        return np.frombuffer(raw, "<u4")
    anchor = _ANCHOR_HASHES[np.minimum(np.searchsorted(_ANCHOR_HASHES, h), len(_ANCHOR_HASHES) - 1)] == h
    content = np.r_[h[~anchor], np.zeros(CHAIN, np.uint64)]
    # content words before each place = index of the first one after it
    after = np.cumsum(~anchor)[anchor]
    spots = h[anchor][after < len(content) - CHAIN]
    after = after[after < len(content) - CHAIN]
    if len(spots):
        sig = spots
        for k in range(CHAIN):
            sig = mix64(sig ^ content[after + k])
    else:
        sig = mix64(h[:-1] ^ mix64(h[1:])) if len(h) > 1 else mix64(h)
    return np.unique((sig >> np.uint64(32)).astype("<u4"))


def packed(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype("<u4").tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; 0 without a look at the members where
    their sizes alone keep it under ``least``."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    value = both / (len(a) + len(b) - both)
    return value if value >= least else 0.0


def _neighbours(rows: DataFrame) -> DataFrame:
    """Rows dealt by ranges of ids, in descending order, each range followed by a copy
    of the row that comes after it.

    The ranges come from quantiles of the ids; all that the driver holds is a border
    and the largest id for each range.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))])
    rows = rows.withColumn("bucket", F.size(F.filter(cuts, lambda c: c < F.col("key"))))
    heads = sorted((r.bucket, r.head) for r in rows.groupBy("bucket").agg(F.max("key").alias("head")).collect())
    # what follows a range is the head of the one below, after the last of the first
    follows = {heads[i][1]: heads[(i + 1) % len(heads)][0] for i in range(len(heads))}
    guest = F.try_element_at(F.create_map(*[F.lit(x) for k, v in follows.items() for x in (k, v)]), F.col("key")) if follows else F.lit(None).cast("int")
    own = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("guest"))
    more = F.when(guest.isNotNull(), F.array(own, F.struct(guest.alias("to"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    dealt = rows.select("doc_id", "key", "text", F.explode(more).alias("at")).select("at.to", "at.guest", "key", "doc_id", "text")
    # numbers of which hashing deals one to each partition, in place of the ranges' own
    spread = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
    numbers = F.array(*[F.lit(r.id) for r in spread.orderBy("p").collect()])
    dealt = dealt.withColumn("to", F.coalesce(F.get(numbers, F.col("to")), F.col("to").cast("long")))
    return dealt.repartition(n, "to").sortWithinPartitions("to", "guest", F.desc("key"), F.asc_nulls_first("text")).select("to", "guest", "doc_id", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    The edited text has its last ``n_chars // 2`` code points replaced by the first as
    many of the next document, in descending order of ids (numbers); the first follows
    the last, so a lone document follows itself.  Null texts are empty.  Null ids come
    last; rows with one id are ordered by their texts.  An empty table gives an empty
    result.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        last = None
        for b in batches:
            out: list[list] = [[] for _ in names]
            whole = texts(b.column(3))
            hashes, starts = word_hashes(whole)
            for row, (to, guest, doc_id) in enumerate(zip(*(c.to_pylist() for c in b.columns[:3]), strict=True)):
                text = whole[row]
                sig = _signatures(text, hashes[starts[row] : starts[row + 1]])
                if last is not None and last[0] == to and not last[1]:
                    _, _, i, t, s = last
                    k = len(t) // 2
                    edited = t[: len(t) - k] + text[:k]
                    e = s if edited == t else signatures(edited)
                    row = (i, len(t), sha256_hex(edited.encode("utf-8", "surrogatepass")), packed(s), packed(e), likeness(s, e), likeness(s, sig))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                last = (to, guest, doc_id, text, sig)
            kinds = [b.column(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return _neighbours(rows).mapInArrow(tidy(run, most=1 << 20, text_at=3), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_copies(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs ``a < b`` of the different fingerprints with a likeness of at least
    ``least``, as ``a, b, likeness``; ``a`` and ``b`` are the smallest ids that have
    them.  Null ids take no part.

    Sets whose sizes differ by more than the factor ``least`` can't match, so each set
    is compared in the range of its own size and the next larger one only.  Within
    these, two sets that match must share one of the rarest ``n - ceil(least n) + 1``
    signatures of each.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [signatures(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "sig"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    sets = rows.where(F.col("doc_id").isNotNull()).mapInArrow(tidy(run), f"doc_id {kind}, sig array<long>")
    sets = sets.groupBy("sig").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("sig"))
    sets = sets.withColumn("range", F.floor(F.log("n") / -np.log(least)).cast("int"))
    spread = sets.select("doc_id", F.explode("sig").alias("s"))
    often = spread.groupBy("s").agg(F.count("*").alias("df"))
    ranked = spread.join(often, "s").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "s"))), lambda x: x["s"]).alias("rare"))
    head = ranked.join(sets, "doc_id").select("doc_id", "sig", "n", "range", F.explode(F.slice("rare", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))).alias("s"))
    # a set meets those of its range, and those of the next larger range
    left = head.select(F.col("doc_id").alias("a"), F.col("sig").alias("x"), "s", F.explode(F.array("range", F.col("range") + 1)).alias("range"), F.col("range").alias("own"))
    right = head.select(F.col("doc_id").alias("b"), F.col("sig").alias("y"), "s", "range")
    pairs = left.join(right, ["s", "range"]).where((F.col("own") < F.col("range")) | (F.col("a") < F.col("b")))
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    pairs = pairs.where(small >= large * least).dropDuplicates(["a", "b"])
    both = F.size(F.array_intersect("x", "y"))
    scored = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (both / (F.size("x") + F.size("y") - both)).alias("likeness"))
    return scored.where(F.col("likeness") >= least)
