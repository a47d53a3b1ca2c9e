"""N-gram Jaccard join by MinHash banding.

Documents with equal n-gram sets are one text, whatever their ids.  Different texts
are candidates if one of their bands agrees; candidates are verified on their full
n-gram sets, block by block, and only counts and a spanning forest of the links leave
a block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, mix64, numbered, pick, position, sorted_side, stored, text_digest, word_hashes
from .components import components

#: Different texts of a block, and the n-grams of these, are about as many at most
#: (a single text may have more); two blocks meet in one group.
BLOCK, GRAMS = 256, 400_000


def banding(least: float, recall: float, most: int = 160) -> tuple[int, int]:
    """Bands and rows: the most rows a band whose bands still find a pair of likeness
    ``least`` with the probability ``recall``, with at most ``most`` hashes."""
    for rows in range(most, 0, -1):
        hit = least**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("this recall needs more hashes")


def ngrams(texts: list[str], n: int) -> list[np.ndarray]:
    """For each text the sorted set of hashed n-grams of words.

    Shorter texts are one n-gram; a text without words is one n-gram made from the raw
    text, so that only equal ones match.
    """
    h, starts = word_hashes(texts)
    whole = np.full(max(0, len(h) - n + 1), np.uint64(n))
    for k in range(n):
        whole = mix64(whole ^ h[k : len(h) - n + 1 + k]) if len(whole) else whole
    out = []
    for text, a, b in zip(texts, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if a == b:
            out.append(np.frombuffer(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint64))
        elif b - a < n:
            gram = np.full(1, np.uint64(b - a))
            for k in range(a, b):
                gram = mix64(gram ^ h[k : k + 1])
            out.append(gram)
        else:
            grams = np.sort(whole[a : b - n + 1])
            out.append(grams[np.r_[True, grams[1:] != grams[:-1]]])
    return out


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**64, count, np.uint64) | np.uint64(1), rng.integers(0, 2**64, count, np.uint64)


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """For each set one 64-bit number a band; the band's place is part of it."""
    a, b = _seeds(bands * rows)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    low = np.empty((bands * rows, len(sets)), np.uint64)
    value = np.empty_like(flat)
    with np.errstate(over="ignore"):
        for k in range(bands * rows):
            np.multiply(flat, a[k], out=value)
            np.add(value, b[k], out=value)
            low[k] = np.minimum.reduceat(value, starts)
        low = low.reshape(bands, rows, len(sets))
        out = np.repeat(np.arange(bands, dtype=np.uint64)[:, None], len(sets), 1)
        for k in range(rows):
            out = mix64(out ^ low[:, k]) + np.uint64(1)
    return np.ascontiguousarray(out.T).view(np.int64)


def _verify(sets: list[np.ndarray], first: int, copies: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of the members of one group, counted with copies, and for each the
    smallest member of its component.  With ``first`` over 0, members before it are
    compared with those from it on only."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m, dtype=np.int32), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    del order
    # n-grams of one member only tell nothing
    new = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    column = np.cumsum(np.r_[0, column[1:] != column[:-1]]) if len(column) else column
    both = np.zeros((m, m), np.float32)
    width = max(64, (1 << 20) // m)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [k, k + width])
        part = np.zeros((m, width), np.float32)
        part[owner[lo:hi], column[lo:hi] - k] = 1
        both += part @ part.T
    near = both >= least * (size[:, None] + size[None, :] - both) - 1e-6
    np.fill_diagonal(near, False)
    if first:
        near[:first, :first] = False
        near[first:, first:] = False
    root = np.arange(m)
    while True:
        low = np.minimum(root, np.where(near, root[None, :], m).min(1))
        low = low[low]
        if (low == root).all():
            return near.astype(np.int64) @ copies, root
        root = low


def ngram_join(docs: DataFrame, n: int = 5, least: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links`` for every row of ``docs``.

    ``n_links`` is the number of other rows whose n-gram sets have a Jaccard likeness
    of at least ``least``; ``class_id`` the smallest doc_id of all rows that such links
    connect.  A pair of likeness ``least`` is found with the probability ``recall``, more
    alike ones with more; what is found is exact.  Null texts are empty; texts without
    words match equal texts only.  Rows with a null id take part as any other, and get a
    null class.  Rows that share an id, with one text or several, count each by their
    texts.  Of equal ids and texts none goes before another.  Other columns, whatever
    their names, play no part.  Empty table: empty result.
    """
    return _classes(docs, n, least, recall, id_col, text_col).select("doc_id", "class_id", "n_links")


def _classes(docs: DataFrame, n: int, least: float, recall: float, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, digest, class_id, n_links, stays`` for every row; ``stays`` tells the
    document of each class that has the class's id.

    A text is known by ``node``, a number that it gets once the texts are written, so
    ids that several texts share make several nodes.
    """
    bands, rows_a_band = banding(least, recall)
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", text_digest(F.col("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = ngrams(b.column(1).to_pylist(), n)
            keys = [hashlib.blake2b(g.tobytes(), digest_size=16).digest() for g in sets]
            sigs = signatures(sets, bands, rows_a_band)
            ends = pa.array(np.arange(len(sets) + 1) * bands, pa.int32())
            columns = [b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array([len(g) for g in sets], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(sigs.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "key", "n", "bands"])

    signed = stored(in_arrow(rows, sign, f"doc_id {kind}, digest binary, key binary, n long, bands array<long>", most=1 << 20), "signed")
    # the rows of a text are counted in each task first, so many copies do no harm
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("row")
    alike = signed.groupBy("key").agg(row, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    alike = alike.select("key", "row", "copies", "n", "bands", F.monotonically_increasing_id().alias("node"))
    alike = stored(alike, "texts")
    found = stored(_links(rows, alike, n, least), "links")
    roots = stored(components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))), "roots")
    # the first row of a class: the smallest id, nulls last
    first = F.min(F.struct("row.none", "row.doc_id", F.col("node").alias("text"))).alias("first")
    heads = stored(roots.join(sorted_side(alike.select("node", "row")), "node").groupBy("root").agg(first), "heads")
    named = roots.join(sorted_side(heads), "root").select("node", F.col("first.doc_id").alias("id"), F.col("first.text").alias("text"))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = alike.select("key", "node", "copies", "row").join(sorted_side(sums), "node", "left").join(sorted_side(named), "node", "left")
    alone = F.col("text").isNull()
    classes = classes.select(
        "key", F.when(alone, F.col("row.doc_id")).otherwise(F.col("id")).alias("id"), F.when(alone | (F.col("text") == F.col("node")), F.col("row.digest")).alias("first"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    stays = F.col("doc_id").isNull() | F.coalesce((F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("first")), F.lit(False))
    class_id = F.when(F.col("doc_id").isNotNull(), F.col("id"))
    return signed.select("doc_id", "digest", "key").join(sorted_side(classes), "key").select("doc_id", "digest", class_id.alias("class_id"), "n_links", stays.alias("stays"))


def _links(rows: DataFrame, alike: DataFrame, n: int, least: float) -> DataFrame:
    """``node, links, root`` from every group of blocks in which a text has links."""
    spark = rows.sparkSession
    banded = alike.select("node", "n", F.explode("bands").alias("band"))
    full = banded.groupBy("band").agg(F.count("*").alias("size"), F.sum("n").alias("grams")).where("size > 1")
    members = stored(banded.join(sorted_side(full), "band"), "members")
    # Candidates that buckets connect are dealt over blocks of about BLOCK texts and
    # GRAMS n-grams; those that share their fullest bucket mostly stay together.
    star = members.join(sorted_side(members.groupBy("band").agg(F.min("node").alias("v"))), "band").select(F.col("node").alias("u"), "v").distinct()
    joint = components(star)
    blocks = lambda texts, grams: F.ceil(F.greatest(F.col(texts) / BLOCK, F.col(grams) / GRAMS))
    home = members.groupBy("node").agg(F.max(F.struct("size", "band", "grams")).alias("home"), F.first("n").alias("n")).join(sorted_side(joint), "node")
    sizes = home.groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("all_grams"))
    home = home.select("node", "root", "home.*").join(sorted_side(sizes), "root")
    part = F.pmod(F.xxhash64("node"), blocks("size", "grams"))
    block = F.xxhash64("root", F.pmod(F.pmod(F.xxhash64("band"), F.lit(2**40)) + part, blocks("texts", "all_grams")))
    home = stored(home.select("node", block.alias("block")), "homes")
    # two blocks are compared if one bucket has members of both
    met = members.join(sorted_side(home), "node").select("band", "block").distinct()
    sets = met.groupBy("band").agg(F.array_sort(F.collect_set("block")).alias("blocks")).select("blocks").distinct()
    lone = sets.select(F.explode("blocks").alias("x")).distinct().select("x", F.col("x").alias("y"))
    cross = sets.where(F.size("blocks") > 1).select("blocks", F.posexplode("blocks").alias("i", "x")).select("x", F.explode(F.slice("blocks", F.col("i") + 2, F.size("blocks"))).alias("y")).distinct()
    side = lambda c, k: F.struct(F.col(c).alias("block"), F.lit(k).alias("side"))
    sides = lone.union(cross).select(F.xxhash64("x", "y").alias("group"), F.explode(F.when(F.col("x") == F.col("y"), F.array(side("x", 0))).otherwise(F.array(side("x", 0), side("y", 1)))).alias("s"))
    sides = sides.select("group", "s.block", "s.side")
    wanted = home.join(sorted_side(alike.select("node", "row", "copies")), "node")
    one_each = rows.join(sorted_side(wanted.select("node", "row")), (F.col("digest") == F.col("row.digest")) & F.col("doc_id").eqNullSafe(F.col("row.doc_id")), "inner").select("node", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.tobytes() for g in ngrams(b.column(1).to_pylist(), n)], pa.binary())], ["node", "grams"])

    # a row may repeat, its n-grams are the same
    grams = stored(in_arrow(one_each, cut, "node long, grams binary", most=1 << 20).groupBy("node").agg(F.first("grams").alias("grams")), "grams")
    asked = wanted.select("node", "copies", "block").join(sorted_side(sides), "block").select("group", "side", "node", "copies")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.join(sorted_side(grams), "node").select("group", "grams", "side", "node", "copies").repartition(parts, "group").sortWithinPartitions("group", "side", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for b in batches:
            for g, grams, side, node, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != group:
                    yield from batch(held)
                    group, held = g, []
                held.append((side, node, copies, np.frombuffer(grams, np.uint64)))
        yield from batch(held)

    def batch(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        first = sum(side == 0 for side, *_ in held) % len(held)
        links, root = _verify([s for *_, s in held], first, np.array([c for _, _, c, _ in held], np.int64), least)
        has = np.flatnonzero(links).tolist()
        named = lambda at: pa.array([held[i][1] for i in at], pa.int64())
        yield pa.RecordBatch.from_arrays([named(has), pa.array(links[has], pa.int64()), named(root[has].tolist())], ["node", "links", "root"])

    return in_arrow(dealt, verify, "node long, links long, root long", most=16 << 20)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, least: float = 0.8, recall: float = 0.999) -> DataFrame:
    """``docs`` with one document of each class, the one of the smallest id; all columns
    as they are.

    Rows with a null id stay.  Where the smallest id has several texts of the class,
    one of them stays; rows that repeat the id and the text that stay are one document,
    and stay too.  Null texts are empty texts, so of several one stays.  An empty table
    gives an empty result.
    """
    gone = _classes(docs, n, least, recall, id_col, text_col).where("NOT stays").select(F.col("doc_id").alias("gone"), "digest").distinct()
    rows, i, t = numbered(docs), f"c{position(docs, id_col)}", f"c{position(docs, text_col)}"
    return rows.join(sorted_side(gone), (F.col(i) == F.col("gone")) & (text_digest(F.col(t)) == F.col("digest")), "left_anti").toDF(*docs.columns)
