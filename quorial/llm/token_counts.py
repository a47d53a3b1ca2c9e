"""Token counts by rank-synchronous merging of batched pre-tokens.

The pre-tokens of a batch that were not met before are laid out as one ragged
array of symbols.  In each round every sequence finds its pair of lowest rank,
and all sequences merge theirs at once; a sequence without a known pair is done,
and what symbols it still has is its count.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Cache, distinct_pieces, kept, pick, row_sums, slices, tidy

_NONE = np.iinfo(np.int64).max


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the rest is counted up from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class PairMerger:
    """Ranks of symbol pairs, and the array merge over them."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        chars = byte_chars()
        self.inner = np.array([vocab.get(c, -1) for c in chars], np.int64)
        self.last = np.array([vocab.get(c + suffix, -1) for c in chars], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.order[at], _NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each non-empty word."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        sym = self.inner[flat]
        sym[ends - 1] = self.last[flat[ends - 1]]
        seq = np.repeat(np.arange(len(words)), lengths)
        out = lengths.copy()
        #: rank of the pair that begins at each symbol
        rank = np.full(len(sym), _NONE)
        inside = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inside] = self.ranks(sym[inside], sym[inside + 1])
        while len(sym):
            heads = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, heads)
            size = np.diff(np.r_[heads, len(sym)])
            done = best == _NONE
            if done.any():
                out[seq[heads[done]]] = size[done]
                live = ~np.repeat(done, size)
                sym, seq, rank, best, size = sym[live], seq[live], rank[live], best[~done], size[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, size)
            # of overlapping occurrences (x x x) the left one goes first
            at = np.flatnonzero(hit)
            if (at[1:] - at[:-1] == 1).any():
                first = np.r_[True, at[1:] - at[:-1] != 1]
                run = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
                at = at[(at - run) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = (np.cumsum(keep) - 1)[at]
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            # only pairs beside a merged symbol have another rank now
            near = np.r_[moved, moved[moved > 0] - 1]
            near = near[near < len(sym) - 1]
            same = seq[near] == seq[near + 1]
            rank[near] = _NONE
            rank[moved] = _NONE
            near = near[same]
            rank[near] = self.ranks(sym[near], sym[near + 1])
        return out


class TokenCounter:
    """Counts as the tokenizers library gives them for a BPE vocabulary whose
    normaliser is NFC, white-space folding and lower case, and whose pre-tokens
    are what one pattern matches."""

    def __init__(self, spec: bytes):
        spec = json.loads(spec)
        model = spec["model"]
        if model["type"] != "BPE" or [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a BPE vocabulary with the normalisers NFC, Replace and Lowercase is needed")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.merger = PairMerger(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known = kept(Cache())

    def pre_tokens(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # characters are lowered one by one, without the rule for a final sigma
            text = text.replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def words(self, piece: str) -> list[str]:
        """Pre-tokens of a piece without white space."""
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        piece = piece.lower()
        # letters, or letters and one mark, need no pattern
        if piece.isalpha():
            return [piece]
        if piece[-1:] in _MARKS and piece[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.pattern.findall(piece)

    def measure(self, new: list[str]) -> None:
        """Learns the counts of pieces without white space."""
        known = self.known
        split = [self.words(p) for p in new]
        words = [w for w in {w for ws in split for w in ws} if w not in known]
        if words:
            known.learn(words, self.merger.counts([w.encode() for w in words]).tolist())
        known.learn(new, [known[ws[0]] if len(ws) == 1 else sum([known[w] for w in ws]) for ws in split])

    def alone(self, text: str) -> int:
        """The count of one text, with special strings and any control characters."""
        parts = self.special.split(text) if self.special else [text]
        words = [w for part in parts for w in self.pre_tokens(part)]
        each = self.merger.counts([w.encode() for w in set(words)]) if words else []
        size = dict(zip(set(words), each, strict=True))
        return int(sum(map(size.__getitem__, words))) + len(parts) - 1

    def batch(self, column: pa.Array) -> np.ndarray:
        """Counts of the texts.

        No pre-token spans white space, and neither composition nor lower case
        reaches across it, so the different pieces between white space are counted
        once and looked up.
        """
        out, known = [np.zeros(0, np.int64)], self.known
        for part in slices(column):
            starts, at, pieces = distinct_pieces(pc.utf8_split_whitespace(part))
            known.trim()
            new = [w for w in pieces if w not in known]
            for j in range(0, len(new), 20_000):
                self.measure(new[j : j + 20_000])
            sizes = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
            n = row_sums(sizes[at], starts)
            for i in np.flatnonzero(pc.match_substring_regex(part, _ODD).to_numpy(zero_copy_only=False)):
                n[i] = self.alone(part[i].as_py())
            out.append(n)
        return np.concatenate(out)


#: Marks that make one pre-token after letters.
_MARKS = tuple(".,;:!?%")
#: Special strings, and control characters that are white space to some only.
_ODD = r"<\||[\x1c-\x1f\x{85}\x{180e}\x{200b}\x{feff}]"


_COUNTERS: dict[int, TokenCounter] = {}


def counter_of(data: bytes) -> TokenCounter:
    """Built once in each Python worker."""
    return _COUNTERS.get(key := hash(data)) or _COUNTERS.setdefault(key, TokenCounter(data))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    A null text counts as empty: 0 bytes, 0 tokens.  Rows keep their number, so
    repeated rows and null ids come out as they came in; an empty table gives an
    empty result.  Whole texts are counted, whatever their length.  The
    vocabulary is read once by the driver and sent to the executors; its size
    does not depend on the data.
    """
    with open(vocabulary, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(spec.value)
        for b in batches:
            n = counter.batch(b.column(1))
            size = pc.binary_length(pc.fill_null(b.column(1), "")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
