"""Phrase collocations by contiguous pattern growth.

Occurrences of a frequent prefix are projected to what follows them and packed in blocks;
the blocks of a prefix are dealt to one task, which extends it to the right depth-first:
in sorted order every extension of a prefix is a run inside that prefix's run.  A prefix
with more projected occurrences than a task may hold is projected on to its extensions,
which are prefixes of their own, as often as needed.

Words are 64-bit numbers made from language and word; should two words of a corpus get
one number, all numbers are made anew with another seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_arrow, mix64, pick, sha256_hex, sorted_side, stored

#: Fixed: what ends a piece, and what parts the words of a piece.
BREAKS, BLANKS = b".,;:!?\n\v\f\r", b" \t"
#: Words in the longest phrase.
LONGEST = 5
#: Bits of the filter of pairs, at most, as a power of two: 32 MB.
FILTER = 28
#: Projected occurrences that a task holds to combine equal ones, those of a block, and
#: those of one prefix that a task may hold.
HELD, BLOCK, MOST = 800_000, 8_000, 400_000
#: So many languages are broadcast at most.
LANGS = 20_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CLASS = np.array([2 if b in BREAKS else 1 if b in BLANKS else 0 for b in range(256)], np.uint8)
_PLACES = 48


def _numbers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77_003 + seed)
    return rng.integers(0, 2**64, 256, np.uint64), rng.integers(0, 2**64, _PLACES, np.uint64) | np.uint64(1)


class Words:
    """The words of some texts: their numbers, whether each begins a piece, and their
    bytes.  Phrases lie between the beginnings of pieces."""

    def __init__(self, langs: list[str], texts: list[bytes], seed: int):
        values, weights = _numbers(seed)
        self.raw = b"\n".join(texts).translate(_LOWER)
        data = np.frombuffer(self.raw, np.uint8)
        kind = _CLASS[data]
        edges = np.flatnonzero(np.diff(np.r_[0, (kind == 0).view(np.int8), 0]))
        self.begin, self.size = edges[::2], edges[1::2] - edges[::2]
        breaks = np.cumsum(kind == 2, dtype=np.int32)[self.begin]
        self.opens = np.diff(breaks, prepend=-1) != 0
        first = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
        self.row = np.searchsorted(first, self.begin, "right") - 1
        known = {x: mix64(np.array([int(sha256_hex(f"{seed}:{x}".encode())[:16], 16)], np.uint64))[0] for x in set(langs)}
        lang = np.array([known[x] for x in langs], np.uint64)[self.row]
        if not len(self.begin):
            self.id = np.zeros(0, np.int64)
            return
        place = np.arange(len(data), dtype=np.int32)
        place -= np.repeat(np.r_[0, self.begin[1:]].astype(np.int32), np.diff(np.r_[0, self.begin[1:], len(data)]))
        np.clip(place, 0, _PLACES - 1, out=place)
        with np.errstate(over="ignore"):
            value = values[data]
            value *= weights[place]
            value[kind != 0] = 0
            out = mix64(np.add.reduceat(value, self.begin) + self.size.astype(np.uint64))
            for i in np.flatnonzero(self.size > _PLACES).tolist():
                out[i] = int(sha256_hex(str(seed).encode() + self.word(i))[:16], 16)
            self.id = mix64(out ^ lang).view(np.int64)

    def word(self, i: int) -> bytes:
        return self.raw[self.begin[i] : self.begin[i] + self.size[i]]

    def joined(self) -> np.ndarray:
        """Whether each word and the next are in one piece."""
        return np.r_[~self.opens[1:], False] if len(self.id) else np.zeros(0, bool)


def buckets(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """For each pair of words its place in a table of ``2**bits``."""
    with np.errstate(over="ignore"):
        return (mix64(left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.view(np.uint64)) >> np.uint64(64 - bits)).view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[list[str], Words]]:
    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
        yield langs, Words(langs, [t or b"" for t in texts], seed)


def _word_counts(rows: DataFrame, seed: int) -> DataFrame:
    """``id, lang, word, n`` for every word of every language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, w in _batches(batches, seed):
            ids, at, n = np.unique(w.id, return_index=True, return_counts=True)
            words = pa.array([w.word(i) for i in at.tolist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([langs[r] for r in w.row[at].tolist()], pa.string()), words, pa.array(n.astype(np.int64))], ["id", "lang", "word", "n"])

    return in_arrow(rows, run, "id long, lang string, word string, n long").groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def _pair_filter(rows: DataFrame, seed: int, least: int, bits: int) -> np.ndarray:
    """A bit for each place of the table of pairs: whether the pairs there occur ``least``
    times together.  A frequent pair always has its bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w in _batches(batches, seed):
            at = np.flatnonzero(w.joined())
            place, n = np.unique(buckets(w.id[at], w.id[at + 1], bits), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(n.astype(np.int64))], ["place", "n"])

    often = in_arrow(rows, run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    got = often.groupBy(F.expr("shiftright(place, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(max(1, 1 << bits >> 6), np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _projected(rows: DataFrame, seed: int, bits: int, often) -> DataFrame:
    """Blocks (see ``_blocks``) of what follows each word, for all occurrences of pairs
    that may be frequent: the next words up to the first pair that can't be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = often.value, []
        for _, w in _batches(batches, seed):
            goes = w.joined()
            at = np.flatnonzero(goes)
            place = buckets(w.id[at], w.id[at + 1], bits)
            goes[at] = (table[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
            goes = np.r_[goes, np.zeros(LONGEST, bool)]
            ids = np.r_[w.id, np.zeros(LONGEST, np.int64)]
            at = np.flatnonzero(goes)
            context, on = [ids[at]], np.ones(len(at), bool)
            for k in range(1, LONGEST):
                on &= goes[at + k - 1]
                context.append(np.where(on, ids[at + k], 0))
            held.append(np.stack([*context, np.ones(len(at), np.int64)]))
            if sum(h.shape[1] for h in held) > HELD:
                held = [_combined(held)]
                if held[0].shape[1] > HELD // 2:
                    yield _blocks(held.pop(), 1)
        if held:
            yield _blocks(_combined(held), 1)

    return in_arrow(rows, run, _BLOCKS)


def _combined(held: list[np.ndarray]) -> np.ndarray:
    """The different columns of some arrays in order, their last rows summed."""
    rows = np.concatenate(held, 1)
    rows = rows[:, np.lexsort(rows[-2::-1])]
    new = np.r_[True, (rows[:-1, 1:] != rows[:-1, :-1]).any(0)] if rows.shape[1] else np.zeros(0, bool)
    start = np.flatnonzero(new)
    return np.r_[rows[:-1, start], np.add.reduceat(rows[-1:], start, 1) if len(start) else rows[-1:]]


#: A prefix, the different occurrences in a block and how many there are in all, and these:
#: rows of words (0: no more) and a row of counts.
_BLOCKS = "prefix array<long>, size long, n long, block binary"


def _blocks(rows: np.ndarray, depth: int) -> pa.RecordBatch:
    """Sorted occurrences as blocks of one prefix of ``depth`` words and bounded size."""
    m = rows.shape[1]
    new = np.r_[True, (rows[:depth, 1:] != rows[:depth, :-1]).any(0)] if m else np.zeros(0, bool)
    start = np.flatnonzero(new)
    start = np.unique(np.r_[start, [k for a, b in zip(start, np.r_[start[1:], m][: len(start)], strict=True) if b - a > BLOCK for k in range(a, b, BLOCK)]]).astype(np.int64)
    end = np.r_[start[1:], m][: len(start)].astype(np.int64)
    n = np.add.reduceat(rows[-1], start) if m else rows[-1]
    blocks = [np.ascontiguousarray(rows[:, a:b]).tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    ends = pa.array(np.arange(len(start) + 1) * depth, pa.int32())
    prefix = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows[:depth, start].T).ravel()))
    return pa.RecordBatch.from_arrays([prefix, pa.array((end - start).astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(blocks, pa.binary())], ["prefix", "size", "n", "block"])


def _unpacked(block: bytes) -> np.ndarray:
    return np.frombuffer(block, np.int64).reshape(LONGEST + 1, -1)


def grown(rows: np.ndarray, depth: int, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """From different occurrences in order that share ``depth`` words, that prefix (from
    two words on) and every frequent one that extends it, depth-first, with its count."""
    prefix, total = tuple(rows[:depth, 0].tolist()), int(rows[-1].sum())
    if depth > 1 and total >= least:
        yield prefix, total
    if depth < LONGEST and total >= least:
        word = rows[depth]
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        often = np.add.reduceat(rows[-1], start) >= least
        for a, b in zip(start[often].tolist(), np.r_[start[1:], len(word)][often].tolist(), strict=True):
            if word[a]:
                yield from grown(rows[:, a:b], depth + 1, least)


def _mined(blocks: DataFrame, depth: int, least: int) -> DataFrame:
    """``phrase, a``: the blocks of a prefix meet in a task and are grown."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.select("prefix", "block").repartition(parts, F.xxhash64("prefix")).sortWithinPartitions("prefix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, held, found = None, [], []
        for b in batches:
            for p, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != prefix:
                    if held:
                        found += grown(_combined(held), depth, least)
                    prefix, held = p, []
                held.append(_unpacked(block))
            if len(found) > 50_000:
                yield out(found)
                found = []
        if held:
            found += grown(_combined(held), depth, least)
        yield out(found)

    def out(found: list[tuple[tuple[int, ...], int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.list_(pa.int64())), pa.array([a for _, a in found], pa.int64())], ["phrase", "a"])

    return in_arrow(dealt, run, "phrase array<long>, a long")


def _projected_on(blocks: DataFrame, depth: int) -> DataFrame:
    """Blocks of prefixes of one word more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_unpacked(x) for x in b.column(1).to_pylist()]
            rows = [r[:, r[depth] != 0] for r in rows]
            if any(r.shape[1] for r in rows):
                yield _blocks(_combined(rows), depth + 1)

    return in_arrow(blocks.select("prefix", "block"), run, _BLOCKS)


def _phrases(blocks: DataFrame, least: int) -> DataFrame:
    """``phrase, a`` for every phrase of 2 to 5 words with at least ``least`` occurrences;
    a phrase is an array of numbers.

    A prefix with more than ``MOST`` occurrences in its blocks is not held by a task, but
    projected on; a prefix of all words has no more to extend and is only summed."""
    spark, found, depth = blocks.sparkSession, [], 1
    while True:
        sizes = stored(blocks.groupBy("prefix").agg(F.sum("size").alias("all"), F.sum("n").alias("a")).where(F.col("a") >= least), "sizes")
        if depth == LONGEST:
            found.append(sizes.select(F.col("prefix").alias("phrase"), "a"))
            break
        large = sizes.where(F.col("all") > MOST)
        if not large.limit(1).count():
            found.append(stored(_mined(blocks, depth, least), "mined"))
            break
        sized = blocks.join(sorted_side(sizes.select("prefix", "all")), "prefix")
        found.append(stored(_mined(sized.where(F.col("all") <= MOST), depth, least), "mined"))
        if depth > 1:
            found.append(large.select(F.col("prefix").alias("phrase"), "a"))
        before, blocks = blocks, stored(_projected_on(sized.where(F.col("all") > MOST), depth), "blocks")
        if depth > 1:
            discard(before)
        depth += 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def phrases(docs: DataFrame, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z are lower-cased; texts fall into pieces at ``.,;:!?`` and line ends, and pieces
    into words at blanks and tabs.  A phrase has 2 to 5 words of one piece and occurs
    ``a >= least`` times, overlaps counted; ``n`` is all words of the language.  Cut into
    two parts that occur ``l`` and ``r`` times it scores ``floor(1000 a n / (l r))``; its
    lowest score counts, and of equal ones the cut with the shorter first part.  Phrases
    that occur only inside one longer frequent phrase are left out.  Ties in score go by
    ``a``, then by the phrase's bytes.

    Null texts are empty, null languages are ``und``; repeated rows count each; other
    columns play no part.  No words, or an empty table: empty result.
    """
    spark = docs.sparkSession
    rows = pick(docs, lang=lang_col, text=text_col).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    seed = 0
    while True:
        words = stored(_word_counts(rows, seed), "words")
        if not words.groupBy("id").agg(F.count("*").alias("k")).where("k > 1 OR id = 0").head(1):
            break
        discard(words)
        seed += 1
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    n = totals.agg(F.sum("n")).first()[0] or 0
    bits = min(FILTER, max(16, int(n // 2).bit_length()))
    often = spark.sparkContext.broadcast(_pair_filter(rows, seed, least, bits))
    projected = stored(_projected(rows, seed, bits, often), "projected")
    often.destroy()
    found = stored(_phrases(projected, least), "phrases")
    discard(projected)
    parts = found.select(F.col("phrase").alias("part"), F.col("a").alias("f"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("word"))
    parts = parts.union(words.where(F.col("n") >= least).select(F.array("id").alias("part"), F.col("n").alias("f"), "lang", "word"))

    # a phrase inside a longer one that occurs as often is inside one of one word more
    inside = found.where(F.size("phrase") > 2).select(F.explode(F.expr("array(slice(phrase, 1, size(phrase) - 1), slice(phrase, 2, size(phrase) - 1))")).alias("phrase"), "a").distinct()
    kept = found.join(sorted_side(inside), ["phrase", "a"], "left_anti")

    # one join finds the counts of all parts, and the words: at most 13 rows a phrase
    asks = F.expr("""flatten(array(
        transform(sequence(1, size(phrase) - 1), k -> struct(0 AS kind, k, slice(phrase, 1, k) AS part)),
        transform(sequence(1, size(phrase) - 1), k -> struct(1 AS kind, k, slice(phrase, k + 1, size(phrase)) AS part)),
        transform(phrase, (w, i) -> struct(2 AS kind, i AS k, array(w) AS part))))""")
    asked = kept.select("phrase", "a", F.explode(asks).alias("x")).select("phrase", "a", "x.*")
    got = asked.join(sorted_side(parts), "part").groupBy("phrase", "a").agg(F.max("lang").alias("lang"), F.collect_list(F.struct("kind", "k", "f", "word")).alias("got"))
    counts = lambda kind: F.map_from_entries(F.transform(F.filter("got", lambda x: x["kind"] == kind), lambda x: F.struct(x["k"], x["f"])))
    spelled = F.concat_ws(" ", F.transform(F.array_sort(F.transform(F.filter("got", lambda x: x["kind"] == 2), lambda x: F.struct(x["k"], x["word"]))), lambda x: x["word"]))
    got = got.select("lang", "a", F.size("phrase").alias("size"), spelled.alias("phrase"), counts(0).alias("ls"), counts(1).alias("rs"))
    got = got.join(F.broadcast(totals) if totals.count() <= LANGS else sorted_side(totals), "lang")
    cut = F.expr("""array_min(transform(sequence(1, size - 1), k -> struct(
        (CAST(1000 AS decimal(38,0)) * a * n) div (CAST(ls[k] AS decimal(38,0)) * rs[k]) AS score, k, ls[k] AS l, rs[k] AS r)))""")
    scored = got.select("lang", "phrase", "a", "n", cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    # the best of each of 16 parts of a language hold its best
    best = [F.desc("score"), F.desc("a"), "phrase"]
    scored = scored.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*best))).where(F.col("rank") <= top)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return scored.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 100, top: int = 2000) -> str:
    """The DuckDB twin: every phrase of up to five words is counted."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(list_transform(regexp_split_to_array({lower}, '[.,;:!?\x0A-\x0D]'), lambda p: regexp_extract_all(p, '[^\x20\x09]+'))) AS ws FROM documents),
        grams AS (SELECT lang, ws[i : i + k - 1] AS g FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces), (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE i + k - 1 <= len(ws)),
        f AS MATERIALIZED (SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g),
        total AS (SELECT lang, sum(a) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
        cand AS MATERIALIZED (SELECT * FROM f WHERE len(g) >= 2 AND a >= {least}),
        inside AS (SELECT lang, q[i : i + k - 1] AS g, max(a) AS longer
                   FROM (SELECT lang, g AS q, a, unnest(range(1, len(g) + 1)) AS i FROM cand), (SELECT unnest(range(2, {LONGEST})) AS k) WHERE i + k - 1 <= len(q) AND k < len(q) GROUP BY ALL),
        kept AS (SELECT c.* FROM cand c LEFT JOIN inside i ON c.lang = i.lang AND c.g = i.g WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.a),
        cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM kept),
        scored AS (SELECT c.lang, c.g, c.a, c.k, x.a AS l, y.a AS r, n, CAST((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
                   FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1 : len(c.g)] JOIN total t ON t.lang = c.lang),
        low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
        FROM (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM low) WHERE rank <= {top}"""
