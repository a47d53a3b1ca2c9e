"""Benchmark decontamination with a generalised suffix automaton.

All items' words go into one automaton.  Each document's words stream through it
and the longest matching length is tracked; where the last ``window`` words occur
in an item, they are hit.  An item shorter than the window is one window.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, built, discard, in_arrow, numbered, pick, position, stored, text_digest, texts

#: Bytes of item texts in one automaton, about, as a Python worker needs about 105 times
#: as many; more items make more automata, one pass over the documents each.
BLOCK_BYTES = 2 << 20
#: Words with their places, in UTF-8.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class SuffixAutomaton:
    """All substrings of all items.  States have a longest length, a suffix link, and
    the items whose windows end there."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.len, self.link = [0], [-1]
        self.names = [name for name, _ in items]
        whole: dict[int, list[int]] = {}
        self.shortest = window
        for number, (_, words) in enumerate(items):
            if not words:
                continue
            self.shortest = min(self.shortest, len(words))
            state = 0
            for w in words:
                state = self._extend(state, self.ids.setdefault(w, len(self.ids)))
            if len(words) < window:
                whole[number] = words
        self._own(items, whole)

    def _extend(self, last: int, c: int) -> int:
        nxt, ln, link = self.next, self.len, self.link
        if c in nxt[last]:
            q = nxt[last][c]
            if ln[q] == ln[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        ln.append(ln[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if ln[q] == ln[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, ln, link = self.next, self.len, self.link
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        ln.append(ln[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _own(self, items: list, whole: dict[int, list[bytes]]) -> None:
        """For each state: the state of its last ``window`` words, and the short items
        that its words end with.  For each window state: the items that hold it."""
        n, w = len(self.len), self.window
        order = sorted(range(1, n), key=self.len.__getitem__)
        self.at = [-1] * n
        for s in order:
            if self.len[s] >= w:
                up = self.link[s]
                self.at[s] = s if self.len[up] < w else self.at[up]
        self.holds: dict[int, set[int]] = {}
        for number, (_, words) in enumerate(items):
            if len(words) >= w:
                s, matched = 0, 0
                for word in words:
                    s, matched = self.next[s][self.ids[word]], matched + 1
                    if matched >= w:
                        self.holds.setdefault(self.at[s], set()).add(number)
        own: dict[int, list[tuple[int, int]]] = {}
        for number, words in whole.items():
            s = 0
            for word in words:
                s = self.next[s][self.ids[word]]
            own.setdefault(s, []).append((len(words), number))
        self.short: list[tuple] = [()] * n
        for s in order:
            self.short[s] = self.short[self.link[s]] + tuple(own.get(s, ()))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """Which words are hit, which of them by an item shorter than the window, and
        which items have a window that occurs."""
        ids = np.fromiter((self.ids.get(w, -1) for w in words), np.int64, len(words))
        known = np.r_[False, ids >= 0, False]
        edges = np.flatnonzero(known[1:] != known[:-1])
        cover, short, found = np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 1, np.int64), set()
        # a window holds known words only, so shorter runs of them can't have one
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self.shortest:
                self._run(ids[a:b].tolist(), a, cover, short, found)
        by_short = np.cumsum(short[:-1]) > 0
        return (np.cumsum(cover[:-1]) > 0) | by_short, by_short, found

    def _run(self, run: list[int], base: int, cover: np.ndarray, short: np.ndarray, found: set[int]) -> None:
        nxt, ln, link, w = self.next, self.len, self.link, self.window
        s, matched = 0, 0
        for i, c in enumerate(run):
            while s and c not in nxt[s]:
                s = link[s]
                matched = ln[s]
            t = nxt[s].get(c)
            if t is None:
                matched = 0
                continue
            s, matched = t, matched + 1
            if matched >= w:
                found |= self.holds[self.at[s]]
                cover[base + i + 1 - w] += 1
                cover[base + i + 1] -= 1
            for k, number in self.short[s]:
                if k <= matched:
                    found.add(number)
                    short[base + i + 1 - k] += 1
                    short[base + i + 1] -= 1


def _spans(hit: np.ndarray) -> list[int]:
    """Where runs of hit words begin and end, in turn."""
    return np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0])).tolist()


def _marked(spans: Iterable[list[int]], n: int) -> np.ndarray:
    cover = np.zeros(n + 1, np.int64)
    for one in spans:
        np.add.at(cover, one[::2], 1)
        np.add.at(cover, one[1::2], -1)
    return np.cumsum(cover[:-1]) > 0


def _automaton(items: list[tuple[str, str]], window: int, name: str) -> SuffixAutomaton:
    """Built once in each Python worker from the items that were sent to it, in place
    of the one before."""
    return built((window, name), lambda: SuffixAutomaton([(i, ascii_words(t)) for i, t in items], window))


class Matches:
    """What of each document occurs in the benchmark.

    Items are dealt over blocks of about ``BLOCK_BYTES``.  Of one block the automaton is
    asked while documents are read.  Of more, each has a pass over the documents and
    leaves narrow rows for texts with hits; these are put together by text and joined to
    the documents, before anything is decided.  The driver holds one block at a time.
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text_col: str):
        spark = docs.sparkSession
        items = pick(benchmark, item_id=item_col, text=item_text_col).where("text IS NOT NULL AND item_id IS NOT NULL")
        items = items.select(F.col("item_id").cast("string"), "text")
        size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        count = max(1, -(-size // BLOCK_BYTES))
        self.window, self.name = window, uuid.uuid4().hex
        self.rows = numbered(docs)
        self.text = f"c{position(docs, text_col)}"
        self.joined, self.items = None, None
        sent = lambda part: spark.sparkContext.broadcast([(r.item_id, r.text) for r in part.collect()])
        if count == 1:
            self.items = sent(items)
            return
        rows = self.rows.select(text_digest(F.col(self.text)).alias("digest"), F.col(self.text).alias("text"))
        place = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
        parts = []
        for k in range(count):
            block = sent(items.where(place == k))
            parts.append(stored(in_arrow(rows, _pass(block, window, f"{self.name}-{k}"), _FOUND), "hits"))
            block.destroy()
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        # copies of a text give the same spans, and sets keep each once
        sums = every.groupBy("digest").agg(F.collect_set("spans").alias("spans"), F.collect_set("short").alias("short"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        found = stored(sums, "found")
        discard(*parts)
        self.joined = self.rows.withColumn("digest", text_digest(F.col(self.text))).join(found, "digest", "left")

    def of(self) -> Callable:
        """A function from a batch, and the words of its texts, to hit words, those hit
        by short items, and the names of items, for each row."""
        items, window, name = self.items, self.window, self.name

        def ask(b: pa.RecordBatch, whole: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, set[str]]]:
            if items is None:
                spans, short, found = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("spans", "short", "items"))
                for words, x, y, z in zip(whole, spans, short, found, strict=True):
                    yield _marked(x or [], len(words)), _marked(y or [], len(words)), set(z or [])
                return
            auto = _automaton(items.value, window, name)
            for words in whole:
                if len(words) < auto.shortest:
                    yield np.zeros(len(words), bool), np.zeros(len(words), bool), set()
                else:
                    hit, by_short, which = auto.scan(words)
                    yield hit, by_short, {auto.names[k] for k in which}

        return ask


_FOUND = "digest binary, spans array<int>, short array<int>, items array<string>"


def _pass(block, window: int, name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(block.value, window, name)
        for b in batches:
            out: list[list] = [[], [], [], []]
            for digest, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                words = ascii_words(text)
                if len(words) >= auto.shortest:
                    hit, by_short, found = auto.scan(words)
                    if found:
                        for column, value in zip(out, (digest, _spans(hit), _spans(by_short), sorted(auto.names[k] for k in found)), strict=True):
                            column.append(value)
            kinds = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["digest", "spans", "short", "items"])

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 8, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per document.

    Null and empty texts have no words; their item list is empty, with the digest of
    nothing.  Items without words, text or id never occur.  Items that share an id
    count once.  Repeated rows of documents each have their result.  An empty
    benchmark leaves all documents clean; an empty table gives an empty result.  Other
    columns, whatever their names, play no part.  The number of blocks that the
    benchmark is dealt over changes nothing in the result.
    """
    matches = Matches(pick(docs, doc_id=id_col, text=text_col), benchmark, window, "text", item_col, item_text_col)
    kind = matches.rows.schema["c0"].dataType.simpleString()
    ask = matches.of()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [ascii_words(t) for t in texts(b.column(1))]
            hits, _, names = zip(*ask(b, whole), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(w) for w in whole], pa.int64()),
                    pa.array([int(h.sum()) for h in hits], pa.int64()),
                    pa.array([len(n) for n in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(n)).encode()).hexdigest() for n in names], pa.string()),
                    pa.array([len(n) >= least_items for n in names], pa.bool_()),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    rows = matches.rows if matches.joined is None else matches.joined.select("c0", "c1", "spans", "short", "items")
    return in_arrow(rows, run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_spans(text: str, hit: np.ndarray, by_short: np.ndarray, longest: int, coverage: float) -> str | None:
    """The text without its runs of hit words that are at least ``longest`` words long
    or hold a whole short item, or None if hit words make up more than ``coverage``."""
    if not hit.any():
        return text
    if hit.sum() > coverage * len(hit):
        return None
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at, spans = [], 0, _spans(hit)
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        if b - a >= longest or by_short[a:b].any():
            out.append(raw[at : places[a][0]])
            at = places[b - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, longest: int = 8, coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with the matching spans cut out of ``text_col``; documents of which
    more than ``coverage`` of the words match any items go.

    Other columns stay as they are, in their order.  Null and empty texts stay as they
    are, and so does every text with no match; repeated rows are each treated alike.  An
    empty benchmark changes nothing; an empty table gives an empty result.
    """
    matches = Matches(docs, benchmark, window, text_col, item_col, item_text_col)
    ask, at, columns = matches.of(), int(matches.text[1:]), matches.rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new: list[str | None] = []
            keep = []
            for text, (hit, by_short, _) in zip(old, ask(b, [ascii_words(t or "") for t in old]), strict=True):
                new.append(text if text is None else remove_spans(text, hit, by_short, longest, coverage))
                keep.append(text is None or new[-1] is not None)
            own = [b.column(k) for k in range(len(columns))]
            own[at] = pa.array(new, b.column(at).type)
            yield pa.RecordBatch.from_arrays(own, names=columns).filter(pa.array(keep, pa.bool_()))

    rows = matches.rows if matches.joined is None else matches.joined.select(*columns, "spans", "short", "items")
    return in_arrow(rows, run, matches.rows.schema, text_at=at).toDF(*docs.columns)
