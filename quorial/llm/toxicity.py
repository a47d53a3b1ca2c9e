"""Toxicity of texts that hide their words.

A noisy channel turns words into leetspeak, spaces them out or repeats letters.
Words that look disturbed are restored: the possible readings of each character
form a lattice, in which Viterbi's algorithm finds the likeliest paths under a
character trigram model.  Among these the counts of all words of the corpus decide,
smoothed by the character model; they are a table that grows with the corpus, joined
by the words it is asked for.  Rules over restored words, learned from labelled
documents, then score the text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, numbered, pick, position, runs_of, slices, stored, text_digest

#: Fixed: letters that a character is written for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Fixed: Cyrillic letters that look like Latin ones.
ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j"}
#: Costs in nats: a reading of a symbol, a symbol left out, a doubled letter made single, a word border in a spaced run.
READ, SKIP, SINGLE, BORDER = 1.0, 4.0, 1.5, 3.0
#: Readings of a piece that the counts of words choose among, and the count of words that
#: the character model stands for beside them.
READINGS, PRIOR = 4, 1000.0
#: Labelled documents that rules are learned from, at most; those of the smallest hashes are taken.
SAMPLE = 20_000
#: A rule needs so many toxic documents, and in the greedy list so many not yet explained.
SUPPORT, FRESH, PRECISION = 5, 4, 0.8
#: Beside the greedy list: the least share of a sure word, the chance that any of a sample
#: comes from nothing, and words with mostly the same documents, at most.
SURE, CHANCE, TOGETHER = 0.97, 0.01, 100
#: Letters of a word's beginning that can be a rule, besides the whole word.
PREFIXES = (4, 5, 6)
#: Symbols of the character model: a border, a to z, and any other letter.
_SYMBOLS = 28
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+])(?:[ ._*\-]{1,2}(?:[^\W_]|[@$!|+])){3,}(?![^\W_])")
#: In RE2: every text in which _SPACED finds something, and few others.  All characters
#: beyond ASCII count as letters inside a run and as none beside it.
_SPACED_RE2 = r"(^|[^0-9A-Za-z])[0-9A-Za-z@$!|+\x{80}-\x{10FFFF}]([ ._*\-]{1,2}[0-9A-Za-z@$!|+\x{80}-\x{10FFFF}]){3,}($|[^0-9A-Za-z])"
_GAPS = re.compile(r"[ ._*\-]")
_LETTERS = re.compile(r"[^\W\d_]+")
_EDGES = "".join(c for c in "%&#*.,;:?\"'()[]{}<>=~^`/\\-_!«»„“”…")
_NOISY = re.compile(rf"(?=.*[^\W\d_])(?:.*[0-9@$!|+(€£]|.*([^\W\d_])\1\1|.*[a-z][{''.join(ALIKE)}]|.*[{''.join(ALIKE)}][a-z])")


#: Words that need no second look: Latin letters, and no letter thrice in a row.  In RE2.
_PLAIN = r"\A[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+\z"
_THRICE = "|".join(f"{c}{{3}}" for c in map(chr, [*range(97, 123), *range(0xDF, 0x250)]) if c.isalpha())


def plain_words(pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces without the marks around them, in lower case, and which of these are plain
    words: of one script, and not disturbed."""
    bare = pc.utf8_trim(pieces, _EDGES)
    core = pc.utf8_lower(bare)
    plain = pc.and_(pc.match_substring_regex(bare, _PLAIN), pc.invert(pc.match_substring_regex(core, _THRICE)))
    return core, plain.to_numpy(zero_copy_only=False)


def coded_pieces(part: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of texts: where each one's pieces begin (and end), the number of each piece, and
    the different pieces between white space."""
    lists = pc.utf8_split_whitespace(part)
    starts = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
    return starts - starts[0], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _fold_table() -> np.ndarray:
    """Code points under 0x10000 to model symbols: base letters 1 to 26, others 27."""
    out = np.full(0x10000, 27, np.int8)
    for c in range(0x250):
        base = unicodedata.normalize("NFKD", chr(c)).lower()[:1]
        if "a" <= base <= "z":
            out[c] = ord(base) - 96
    out[ord("^")] = 0
    return out


FOLD = _fold_table()


def _symbols(joined: str) -> np.ndarray:
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return FOLD[np.minimum(codes, 0xFFFF)].astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` of all words of all texts (``text``), in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column(0)):
                _, at, pieces = coded_pieces(part)
                often = np.bincount(at, minlength=len(pieces))
                core, plain = plain_words(pieces)
                other = np.flatnonzero(~plain)
                words = [(w.lower(), n) for w, n in zip([p.strip(_EDGES) for p in pieces.take(pa.array(other)).to_pylist()], often[other].tolist(), strict=True) if w.isalpha()]
                own = [core.filter(pa.array(plain)).cast(pa.string()), pa.array([w for w, _ in words], pa.string())]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(own), pa.array(np.r_[often[plain], np.array([n for _, n in words], np.int64)])], ["word", "n"])

    # counted within each task before the shuffle
    return in_arrow(texts, run, "word string, n long", text_at=0).groupBy("word").agg(F.sum("n").alias("n"))


def trigram_counts(words: DataFrame) -> np.ndarray:
    """Character trigrams, 28 x 28 x 28, of ``word_counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SYMBOLS**3, np.int64)
        for b in batches:
            if b.num_rows:
                own = b.column(0).to_pylist()
                sym = _symbols("^^" + "^^".join(own) + "^^")
                weight = np.repeat(b.column(1).to_numpy(), np.array([len(w) + 2 for w in own]))
                gram = (sym[:-2] * _SYMBOLS + sym[1:-1]) * _SYMBOLS + sym[2:]
                total += np.bincount(gram[: len(weight)], weights=weight, minlength=_SYMBOLS**3).astype(np.int64)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["gram", "n"])

    rows = in_arrow(words, run, "gram long, n long", text_at=0).groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_SYMBOLS**3)
    for r in rows:
        out[r.gram] = r.n
    return out.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Trigram model, interpolated with bigrams and a uniform share."""
    two = counts.sum(0)
    p1 = (two + 0.5) / (two + 0.5).sum(1, keepdims=True)
    seen = counts.sum(2, keepdims=True)
    return np.log((counts + 5.0 * p1[None]) / (seen + 5.0))


class Restorer:
    """Viterbi over the character lattice of a disturbed word."""

    def __init__(self, model: np.ndarray):
        self.cost = (-model).tolist()

    @staticmethod
    def lattice(token: str, spaced: bool) -> Iterator[list[tuple[str, float]]]:
        """For each place the strings it can stand for, with their costs."""
        i = 0
        while i < len(token):
            c, j = token[i], i + 1
            while j < len(token) and token[j] == c:
                j += 1
            n = j - i
            readings = [(c, 0.0)] if c.isalpha() else [(r, READ) for r in LEET.get(c, "")]
            if c in ALIKE:
                readings.append((ALIKE[c], READ))
            if not readings:
                yield [("", SKIP * 0.25)]
            elif n == 1:
                yield readings + ([] if c.isalpha() else [("", SKIP)])
            else:
                single = 0.0 if n > 2 else SINGLE
                yield [(r, w + single) for r, w in readings] + [(r * 2, w * 2) for r, w in readings] + ([] if c.isalpha() else [("", SKIP)])
            if spaced and j < len(token):
                yield [("", 0.0), (" ", BORDER)]
            i = j

    def paths(self, token: str, spaced: bool = False, most: int = READINGS) -> list[tuple[float, str]]:
        """The likeliest readings, at most ``most``, with their costs in order.

        Time and memory grow with the token's length only: of each of the at most
        28 x 28 states so many ways back are kept, as links, not as strings.  Of
        equally likely ways into a state the first ones met stay.
        """
        cost = self.cost
        best: dict[tuple[int, int], list[tuple[float, tuple | None]]] = {(0, 0): [(0.0, None)]}
        for options in self.lattice(token.lower(), spaced):
            new: dict[tuple[int, int], list[tuple[float, tuple | None]]] = {}
            for (a, b), ways in best.items():
                for text, extra in options:
                    x, y, v = a, b, extra
                    for c in text:
                        if c == " ":
                            v += cost[x][y][0]
                            x, y = 0, 0
                        else:
                            k = int(FOLD[min(ord(c), 0xFFFF)])
                            v += cost[x][y][k]
                            x, y = y, k
                    new.setdefault((x, y), []).extend([(w + v, (back, text) if text else back) for w, back in ways])
            best = {state: sorted(ways, key=_first)[:most] if len(ways) > most else ways for state, ways in new.items()}
        ends = sorted([(w + cost[a][b][0], back) for (a, b), ways in best.items() for w, back in ways], key=_first)
        out: dict[str, float] = {}
        for w, back in ends:
            if len(out) < most:
                text = _spelled(back)
                out.setdefault(text, w)
        return [(w, text) for text, w in out.items()]

    def likelihood(self, word: str) -> float:
        """Cost of a word under the character model alone."""
        a, b, v = 0, 0, 0.0
        for c in word:
            k = int(FOLD[min(ord(c), 0xFFFF)])
            v += self.cost[a][b][k]
            a, b = b, k
        return v + self.cost[a][b][0]


def _first(x: tuple) -> float:
    return x[0]


def _spelled(back: tuple | None) -> str:
    out = []
    while back is not None:
        back, text = back
        out.append(text)
    return "".join(reversed(out))


#: What stands before a piece, and before a run that may hold several words.
PIECE, RUN = "p", "r"


def words_and_odd(piece: str) -> tuple[list[str], list[str]]:
    """Words of a piece without white space as they are written, and what of it is to
    be restored."""
    low = piece.lower()
    if low.isalpha() and not _NOISY.match(low):
        return [low], []
    core = low.strip(_EDGES)
    words = _LETTERS.findall(core)
    if not _NOISY.match(core):
        return words, []
    # runs of a symbol behind a word are decoration
    bare = core.rstrip(core[-1]) if core[-1] in "$+!|@" else core
    return words, list(dict.fromkeys([PIECE + core, PIECE + (bare if len(core) - len(bare) > 1 else core)]))


def spaced_runs(text: str) -> list[str]:
    """What is written letter by letter, to be restored."""
    out = []
    for m in _SPACED.finditer(text):
        run = _GAPS.sub("", m.group()).lower()
        # a symbol written thrice or more can be filler beside a word, not only a part of it
        for part in dict.fromkeys([run, *re.sub(r"(.)\1\1+", " ", run).split()]):
            out += [RUN + part, PIECE + part]
    return list(dict.fromkeys(out))


def restored(odd: DataFrame, model, words: DataFrame) -> DataFrame:
    """``odd, words`` for the different values of ``odd``: the words of the likeliest
    reading.

    The likeliest paths under the character model are weighed anew with the counts of
    all words: a word's probability is ``(n + PRIOR p) / (all + PRIOR)``, where p is what
    the character model gives it.  Of equally likely readings the first path stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for odd in b.column(0).to_pylist():
                for k, (cost, text) in enumerate(restorer.paths(odd[1:], odd[0] == RUN)):
                    own = _LETTERS.findall(text)
                    like = [restorer.likelihood(w) for w in own]
                    # what the channel adds to the words' own costs
                    rest = cost - sum(restorer.likelihood(w) for w in text.split(" ")) if text else cost
                    for w, v in zip(own or [""], like or [0.0], strict=True):
                        for column, value in zip(out, (odd, k, rest, own, w, v), strict=True):
                            column.append(value)
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["odd", "k", "rest", "own", "word", "cost"])

    total = float(words.agg(F.sum("n")).first()[0] or 0)
    # few bytes, but much work for each: not to be coalesced into few tasks
    parts = int(odd.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = in_arrow(odd.select("odd").distinct().repartition(parts, "odd"), run, "odd string, k int, rest double, own array<string>, word string, cost double", text_at=0)
    known = paths.join(words, "word", "left")
    cost = -F.log((F.coalesce("n", F.lit(0)) + PRIOR * F.exp(-F.col("cost"))) / (total + PRIOR))
    each = known.select("odd", "k", "rest", "own", F.when(F.col("word") == "", 0.0).otherwise(cost).alias("cost"))
    each = each.groupBy("odd", "k").agg((F.first("rest") + F.sum("cost")).alias("cost"), F.first("own").alias("own"))
    return each.groupBy("odd").agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "k", "own")).alias("best")).select("odd", F.col("best.own").alias("words"))


def features(words: list[str]) -> set[str]:
    """Whole words and beginnings of words."""
    out = set()
    for w in words:
        out.add(w)
        out.update(w[:k] + "*" for k in PREFIXES if len(w) >= k)
    return out


def _by_document(b: pa.RecordBatch, only: set[str] | None = None) -> Iterator[set[str]]:
    """The features of each document of a batch of (text, restored); with ``only`` just
    these, looked for once in each different piece."""
    for part, more in _with_restored(b):
        starts, at, pieces = coded_pieces(part)
        of = {}
        for i, piece in enumerate(pieces.to_pylist()):
            found = features(words_and_odd(piece)[0]) if only is None else _among(words_and_odd(piece)[0], only)
            if found:
                of[i] = found
        has = np.isin(at, np.fromiter(of, np.int64, len(of)))
        for row, words in enumerate(more):
            own = at[starts[row] : starts[row + 1]][has[starts[row] : starts[row + 1]]]
            out = _among(words or [], only) if only is not None else features(words or [])
            yield out.union(*[of[i] for i in set(own.tolist())])


def _among(words: list[str], only: set[str]) -> set[str]:
    return {f for w in words for f in (w, *[w[:k] + "*" for k in PREFIXES if len(w) >= k]) if f in only}


def _with_restored(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, list]]:
    column = pc.fill_null(b.column(0).cast(pa.large_string()), "")
    for start, rows in runs_of(column):
        yield column.slice(start, rows), b.column(1).slice(start, rows).to_pylist()


def learn_rules(sample: DataFrame) -> list[tuple[str, float]]:
    """A list of (feature, share of toxic documents among those that have it); a feature is
    a word or its beginning.

    First greedily: the feature that explains the most toxic documents not yet explained
    goes next, so a word that merely stands beside a toxic one in copies adds no rule.
    Then what these leave out because it mostly stands beside them, where it is
    beyond chance by itself (``_sure``).  ``sample`` (text, restored, toxic) is bounded by
    ``SAMPLE``.
    """

    def count(only: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = Counter()
            for b in batches:
                for f in _by_document(b, only):
                    n.update(f)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["feature", "n"])

        return run

    def counted(rows: DataFrame, only: set[str] | None) -> DataFrame:
        return in_arrow(rows.select("text", "restored"), count(only), "feature string, n long", text_at=0).groupBy("feature").agg(F.sum("n").alias("n"))

    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    found = stored(counted(toxic, None), "features")
    bad = {r.feature: r.n for r in found.where(F.col("n") >= SUPPORT).collect()}
    good = {r.feature: r.n for r in counted(clean, set(bad)).collect()}
    share = {f: (n + 0.1) / (n + good.get(f, 0) + 0.2) for f, n in bad.items()}
    kept = sorted(f for f in bad if share[f] >= PRECISION)
    place = {f: i for i, f in enumerate(kept)}

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(place[f] for f in x) for x in _by_document(b, set(place))], pa.list_(pa.int32()))], ["has"])

    # the same document in many copies explains once
    once = [r.has for r in in_arrow(toxic.select("text", "restored").distinct(), explain, "has array<int>", text_at=0).collect()]
    has, rules, left = [set(x) for x in once], [], sorted(place.values())
    while left:
        n = Counter(f for x in has for f in x)
        if not n:
            break
        # of equal ones the whole word, then the longer beginning, goes first
        f, fresh = max(n.items(), key=lambda x: (x[1] * share[kept[x[0]]], not kept[x[0]].endswith("*"), len(kept[x[0]]), -x[0]))
        if fresh < FRESH:
            break
        rules.append((kept[f], share[kept[f]]))
        has = [x for x in has if f not in x]
    base = sample.agg(F.avg("toxic")).first()[0] or 0.0
    chosen = {f for f, _ in rules}
    return rules + [(f, share[f]) for f in _sure(kept, once, {f: (bad[f], good.get(f, 0)) for f in kept}, base, found.count()) if f not in chosen]


def _sure(kept: list[str], has: list[list[int]], counts: dict[str, tuple[int, int]], base: float, tried: int) -> list[str]:
    """Words of ``kept`` with a share of at least ``SURE`` that chance would hardly give any
    of ``tried`` features, by Chernoff's bound under the sample's share of toxic
    documents, so a small sample needs fewer.  ``has``: the places in ``kept`` of the words
    in each different toxic document.  Words whose documents are mostly the same as those
    of many others come from copies of one text, and are left out."""
    if not 0 < base < 1 or not has:
        return []
    first = np.full((3, len(kept)), len(has))
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(len(has))
        for i, fs in enumerate(has):
            if fs:
                np.minimum.at(first[seed], fs, order[i])
    alike = sum((np.bincount(f, minlength=len(has) + 1)[f] > TOGETHER).astype(int) for f in first)
    n_once = Counter(f for x in has for f in x)
    out = []
    for i, f in enumerate(kept):
        n, g = n_once[i], counts[f][1]
        if not n or f.endswith("*") or alike[i] > 1:
            continue
        s = n / (n + g)
        evidence = (n + g) * (s * math.log(s / base) + ((1 - s) * math.log((1 - s) / (1 - base)) if s < 1 else 0.0))
        if s >= SURE and evidence >= math.log(max(1, tried) / CHANCE):
            out.append(f)
    return out


def best_rule(rules: dict[str, float], words: list[str], base: float = 0.0) -> float:
    get, best = rules.get, base
    for w in words:
        for f in (w, *[w[:k] + "*" for k in PREFIXES if len(w) >= k]):
            if (p := get(f)) is not None and p > best:
                best = p
    return best


class Notes:
    """Of texts: the score of the words as they are written, and what is to be restored."""

    def __init__(self, rules: dict[str, float], base: float):
        self.rules, self.base = rules, base
        starts = [re.escape(f[:-1]) for f in rules if f.endswith("*")]
        whole = [rf"{re.escape(f)}\z" for f in rules if not f.endswith("*")]
        #: In RE2: words that a rule fits, and perhaps others.
        self.fits = rf"\A(?:{'|'.join(starts + whole)})" if rules else None

    def batch(self, part: pa.Array) -> tuple[np.ndarray, list[list[str]]]:
        starts, at, pieces = coded_pieces(part)
        core, plain = plain_words(pieces)
        worth = np.full(len(pieces), self.base)
        is_odd, odd_of = np.zeros(len(pieces), bool), {}
        if self.fits:
            fit = np.flatnonzero(plain & pc.match_substring_regex(core, self.fits).to_numpy(zero_copy_only=False))
            worth[fit] = [best_rule(self.rules, [w], self.base) for w in core.take(pa.array(fit)).to_pylist()]
        other = np.flatnonzero(~plain)
        for i, piece in zip(other.tolist(), pieces.take(pa.array(other)).to_pylist(), strict=True):
            words, odd = words_and_odd(piece)
            worth[i] = best_rule(self.rules, words, self.base)
            if odd:
                is_odd[i], odd_of[i] = True, odd
        score = np.full(len(part), self.base)
        some = np.flatnonzero(starts[1:] > starts[:-1])
        if len(some):
            score[some] = np.maximum.reduceat(worth[at], starts[:-1][some])
        odd: list[dict[str, None]] = [{} for _ in range(len(part))]
        places = np.flatnonzero(is_odd[at])
        for row, piece in zip((np.searchsorted(starts, places, "right") - 1).tolist(), at[places].tolist(), strict=True):
            odd[row].update(dict.fromkeys(odd_of[piece]))
        for i in np.flatnonzero(pc.match_substring_regex(part, _SPACED_RE2).to_numpy(zero_copy_only=False)):
            odd[i].update(dict.fromkeys(spaced_runs(part[i].as_py())))
        return score, [list(x) for x in odd]


def noted(rows: DataFrame, rules: list[tuple[str, float]], base: float) -> DataFrame:
    """``key, score, odd, row`` for rows of ``key, text``, stored."""
    own = dict(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes = Notes(own, base)
        for b in batches:
            score, odd = notes.batch(pc.fill_null(b.column(1).cast(pa.large_string()), ""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(odd, pa.list_(pa.string()))], ["key", "score", "odd"])

    kind = rows.schema["key"].dataType.simpleString()
    return stored(in_arrow(rows, run, f"key {kind}, score double, odd array<string>").withColumn("row", F.monotonically_increasing_id()), "noted")


def _held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def scored(rows: DataFrame, doc_ids: DataFrame, labels: DataFrame, label_id: str, label_col: str, sample: int) -> DataFrame:
    """``key, score`` for every one of ``rows`` (key, text).  ``doc_ids`` (doc_id, text)
    are the rows that labels belong to."""
    spark = rows.sparkSession
    marked = pick(labels, doc_id=label_id, toxic=label_col).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
    chosen = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    words = stored(word_counts(rows.select("text")), "words")
    model = spark.sparkContext.broadcast(log_probabilities(trigram_counts(words)))
    # at most ``sample`` rows of two numbers are broadcast
    learned = stored(doc_ids.join(F.broadcast(chosen), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id()), "toxic-sample")
    odd = noted(learned.select(F.col("row").alias("key"), "text"), [], 0.0).select("key", F.explode("odd").alias("odd"))
    read = odd.join(restored(odd, model, words), "odd").groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("restored"))
    learned = stored(learned.join(read, F.col("row") == F.col("key"), "left").select("text", "toxic", "restored"), "toxic-words")
    rules = learn_rules(learned)
    base = _base(learned, rules)
    first = noted(rows, rules, base)
    odd = first.select("row", F.explode("odd").alias("odd"))
    own = dict(rules)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([best_rule(own, w) for w in b.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), found], ["odd", "more"]).filter(pc.greater(found, 0))

    rated = stored(in_arrow(restored(odd, model, words), rate, "odd string, more double", text_at=0), "rated")
    # narrow rows, and only those of pieces that a rule fits
    hidden = odd.join(rated, "odd").groupBy("row").agg(F.max("more").alias("more"))
    return first.join(hidden, "row", "left").select("key", F.greatest("score", F.coalesce("more", F.lit(0.0))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document.

    Rules are learned from at most ``sample`` labelled rows that are not held out;
    counts of words and characters from all texts.  Null and empty texts get the base
    score, the share of toxic documents that no rule explains (under 0.5).  A document
    labelled more than once counts as toxic if one label says so; null labels are no
    labels.  Without labels every score is 0.  Repeated rows each have their score;
    other columns, whatever their names, play no part; an empty table gives an empty
    result.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    out = scored(rows.withColumnRenamed("doc_id", "key"), rows, labels, label_id, label_col, sample).withColumnRenamed("key", "doc_id")
    return out.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _base(learned: DataFrame, rules: list[tuple[str, float]]) -> float:
    """The share of toxic ones among the sample's documents that no rule fits."""
    own = dict(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes = Notes(own, 0.0)
        for b in batches:
            free = []
            for part, more in _with_restored(b):
                free += [x == 0 and best_rule(own, words or []) == 0 for x, words in zip(notes.batch(part)[0].tolist(), more, strict=True)]
            free = np.array(free, bool)
            yield pa.RecordBatch.from_arrays([pa.array([int(free.sum())]), pa.array([int((free & (b.column(2).to_numpy() == 1)).sum())])], ["n", "toxic"])

    r = in_arrow(learned.select("text", "restored", "toxic"), run, "n long, toxic long", text_at=0).agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).first()
    return min(0.49, ((r.toxic or 0) + 0.01) / (r.n + 1)) if r.n and not math.isnan(r.n) else 0.0


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the documents predicted toxic, all columns as they are.

    The score depends on the text alone, so repeated rows and copies stay or go
    together.  Null and empty texts stay, and without labels all do; an empty table
    gives an empty result.
    """
    ids = pick(docs, doc_id=id_col, text=text_col)
    keyed = ids.select(text_digest(F.col("text")).alias("key"), "text")
    toxic = stored(scored(keyed, ids, labels, label_id, label_col, sample).where("score >= 0.5").select("key").distinct(), "toxic")
    rows = numbered(docs)
    return rows.join(toxic, text_digest(F.col(f"c{position(docs, text_col)}")) == F.col("key"), "left_anti").toDF(*docs.columns)
