"""Byte-pair encoding with a backtracking encoder, and decoding by offsets.

An Aho-Corasick automaton of all token strings gives the longest token at each
place.  The encoder goes from left to right with the longest token; a token may
follow another only if the table of compatible pairs says that merging their
joined bytes leaves the border between them.  If none fits, it takes a step back.
Positions that were found dead are not entered again, so the time is linear.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Cache, built, distinct_pieces, gather, in_arrow, kept, pick, row_sums, slices
from .token_counts import byte_chars

#: Fixed: the split of byte-level vocabularies before any merge.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Marks that make one pre-token after letters.
_MARKS = tuple(".,;:!?%")
_W = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts that are encoded whole: with a blank at an end or beside other white space,
#: with the mark, or with something like a special string.
_WHOLE = rf"\A{_W}|{_W}\z| {_W}|{_W} |\x00|<\|"


#: Pairs of tokens whose compatibility is remembered, at most.
_SLOTS = 1 << 20


class Codec:
    """Encoder and decoder of one byte-level vocabulary."""

    def __init__(self, spec: bytes):
        spec = json.loads(spec)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normaliser is needed")
        of = {c: b for b, c in enumerate(byte_chars())}
        vocab = spec["model"]["vocab"]
        raw = lambda s: bytes(of[c] for c in s)
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        # ranks: the 256 bytes, then the merges in order
        rank = {bytes([b]): b for b in range(256)}
        self.halves = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        ids = [vocab[c] for c in byte_chars()]
        for a, b in merges:
            left, right, new = rank[raw(a)], rank[raw(b)], len(self.halves)
            rank[raw(a) + raw(b)] = new
            self.halves.append((left, right))
            self.joined[left, right] = new
            ids.append(vocab[a + b])
        self.lengths = [0] * len(ids)
        auto = ahocorasick.Automaton()
        for s, r in rank.items():
            self.lengths[r] = len(s)
            auto.add_word(s.decode("latin-1"), r)
        auto.make_automaton()
        self.auto = auto
        # the longest token that is a proper prefix of each token
        self.shorter = [-1] * len(ids)
        for s, r in rank.items():
            for n in range(len(s) - 1, 0, -1):
                if (p := rank.get(s[:n])) is not None:
                    self.shorter[r] = p
                    break
        self.ids, self.lengths, self.shorter = np.array(ids), np.array(self.lengths), np.array(self.shorter)
        # answers of the compatibility table: the pair asked for last in each slot
        self.asked, self.answer = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, bool)
        # decoding: the bytes of all tokens, and where each begins
        content = {i: s for s, r in rank.items() for i in (ids[r],)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        content |= {i: s.encode() for s, i in self.special.items()}
        top = max(content) + 1
        sizes = np.array([len(content.get(i, b"")) for i in range(top)], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.blob = np.frombuffer(b"".join(content.get(i, b"") for i in range(top)), np.uint8)
        self.pattern = regex.compile(SPLIT)
        strings = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, strings)) + ")") if strings else None
        self.words, self.known = kept(Cache()), kept(Cache())

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of both tokens gives just these two.

        The merges across the border are tried from the last to the first: at each
        step the token that was made later is opened on the side of the border, and
        a merge across that comes before what was opened would have taken place.
        """
        left, right, limit, fits = a, b, len(self.halves), True
        while True:
            made = self.joined.get((left, right))
            if made is not None and made < limit:
                fits = False
                break
            if left > right:
                limit, left = left, self.halves[left][1]
                if left == limit:
                    limit, right = right + 1, self.halves[right][0]
                    if right + 1 == limit:
                        break
            else:
                limit, right = right + 1, self.halves[right][0]
                if right + 1 == limit:
                    limit, left = left, self.halves[left][1]
                    if left == limit:
                        break
        return fits

    def compatible_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left * len(self.halves) + right
        slot = ((pairs * 0x9E3779B97F4A7C1) >> 20) & (_SLOTS - 1)
        new = self.asked[slot] != pairs
        if new.any():
            ask, first = np.unique(pairs[new], return_inverse=True)
            found = np.fromiter((self.compatible(*divmod(p, len(self.halves))) for p in ask.tolist()), bool, len(ask))[first]
            out = np.where(new, False, self.answer[slot])
            out[new] = found
            # slots may clash; pair and answer come from the same one of those that do
            last = dict(zip(slot[new].tolist(), range(len(found)), strict=True))
            at = np.fromiter(last.values(), np.int64, len(last))
            self.asked[slot[new][at]], self.answer[slot[new][at]] = pairs[new][at], found[at]
            return out
        return self.answer[slot]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens, all in step: in each round every unfinished word
        tries one token at its place."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        # one automaton pass; no token has the separator, so no match spans words
        text = "\u0100".join([w.decode("latin-1") for w in words])
        found = np.fromiter(self.auto.iter(text), np.dtype([("end", np.int64), ("rank", np.int64)]))
        longest = np.full(len(text) + 1, -1)
        # matches come by their ends, so of those with one start the longest is last
        longest[found["end"] + 1 - self.lengths[found["rank"]]] = found["rank"]
        start = np.cumsum(sizes + 1) - (sizes + 1)
        end_of = start + sizes
        alive = np.ones(len(text) + 2, bool)
        stack = np.full((len(words), int(sizes.max()) + 1), -1, np.int32)
        depth = np.ones(len(words), np.int64)  # column 0: nothing before the first token
        live, pos, token = np.arange(len(words)), start.copy(), longest[start]
        while len(live):
            end = pos + self.lengths[token]
            last = stack[live, depth[live] - 1].astype(np.int64)
            fit = alive[end]
            ask = np.flatnonzero(fit & (last >= 0))
            fit[ask] = self.compatible_pairs(last[ask], token[ask])
            yes = np.flatnonzero(fit)
            stack[live[yes], depth[live[yes]]] = token[yes]
            depth[live[yes]] += 1
            pos[yes] = end[yes]
            no = np.flatnonzero(~fit)
            less = self.shorter[token[no]]
            # nothing fits from here on: the place is dead, go back a token
            back = no[less < 0]
            alive[pos[back]] = False
            token[yes] = longest[end[yes]]
            token[no] = less
            depth[live[back]] -= 1
            token[back] = stack[live[back], depth[live[back]]]
            pos[back] -= self.lengths[token[back]]
            more = pos < end_of[live]
            live, pos, token = live[more], pos[more], token[more]
        counts = depth - 1
        ids = self.ids[stack[:, 1:][np.arange(stack.shape[1] - 1) < counts[:, None]]].astype("<u4").tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def split(self, text: str) -> list[str]:
        """Pre-tokens.  Letters, or letters and one mark, need no pattern."""
        body = text[1:] if text[:1] == " " else text
        if body.isalpha():
            return [text]
        if body[-1:] in _MARKS and body[:-1].isalpha():
            return [text[:-1], text[-1]]
        return self.pattern.findall(text)

    def learn_words(self, words: set[str]) -> None:
        self.words.trim()
        new = sorted((w for w in words if w not in self.words), key=len)
        for k in range(0, len(new), 10_000):
            part = new[k : k + 10_000]
            # very long words are encoded one by one, to keep the stacks small
            for run in [part] if len(part[-1]) <= 200 else [[w] for w in part]:
                ids = self.encode_words([w.encode() for w in run])
                self.words.learn(run, ids, sum(map(len, ids)) // len(ids))

    def learn(self, pieces: list[str]) -> None:
        known = self.known
        known.trim()
        pieces = [p for p in pieces if p not in known]
        split = [self.split(p[1:] if p[:1] == "\0" else " " + p) for p in pieces]
        self.learn_words({w for ws in split for w in ws})
        words = self.words
        ids = [words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws]) for ws in split]
        if ids:
            known.learn(pieces, ids, sum(map(len, ids)) // len(ids))

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.cut.split(text) if self.cut else (text,):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                words = self.pattern.findall(part)
                self.learn_words(set(words))
                out.append(b"".join([self.words[w] for w in words]))
        return b"".join(out)

    def batch(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of rows: where each row's ids begin (and end), and the ids.

        A blank between other characters belongs to the word that follows it, so the
        different pieces between blanks are encoded once, each behind a blank.
        """
        for part in slices(column):
            whole = pc.match_substring_regex(part, _WHOLE).to_numpy(zero_copy_only=False)
            # the first piece of a row has no blank before it, and is told apart by a mark
            marked = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), pc.if_else(pa.array(whole), "", part), pa.scalar("", pa.large_string()))
            starts, at, pieces = distinct_pieces(pc.split_pattern(marked, " "))
            self.learn(pieces)
            packed = [self.known[p] for p in pieces]
            size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            first = np.cumsum(size) - size
            ids = gather(np.frombuffer(b"".join(packed), "<u4"), first[at], size[at])
            ends = np.r_[0, np.cumsum(row_sums(size[at], starts))]
            if whole.any():
                rows = np.split(ids, ends[1:-1])
                for i in np.flatnonzero(whole):
                    rows[i] = np.frombuffer(self.encode(part[i].as_py()), "<u4")
                ends = np.r_[0, np.cumsum([len(r) for r in rows])]
                ids = np.concatenate(rows)
            yield ends, ids

    def decode(self, packed: bytes) -> bytes:
        """The bytes of the tokens, gathered by the offset table."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        return self.gathered(ids).tobytes()

    def gathered(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.blob, self.starts[ids], self.starts[ids + 1] - self.starts[ids])


def codec_of(data: bytes) -> Codec:
    return built(("codec", hash(data)), lambda: Codec(data))


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``;
    with ``keep_ids`` also ``ids`` (array of int), with ``keep_text`` ``decoded``.

    Whole texts are encoded and decoded.  A null text counts as empty: no tokens,
    and the digests of nothing.  Repeated rows and null ids stay as they are; an
    empty table gives an empty result.  The vocabulary's size does not depend on
    the data.
    """
    with open(vocabulary, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for b in batches:
            n, ids, back, kept, whole = [np.zeros(0, np.int64)], [], [], [], []
            for ends, flat in codec.batch(b.column(1)):
                n.append(np.diff(ends))
                raw = codec.gathered(flat.astype(np.int64)).tobytes()
                sizes = (codec.starts[1:] - codec.starts[:-1])[flat]
                cuts = np.r_[0, np.cumsum(sizes)][ends]
                for i in range(len(ends) - 1):
                    own = flat[ends[i] : ends[i + 1]]
                    # bytes that are no text become U+FFFD, as in the library
                    text = raw[cuts[i] : cuts[i + 1]].decode("utf-8", "replace")
                    ids.append(hashlib.sha256(own).hexdigest())
                    back.append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_ids:
                        kept.append(own.astype(np.int32))
                    if keep_text:
                        whole.append(text)
            columns = {"doc_id": b.column(0), "n_tokens": pa.array(np.concatenate(n)), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            if keep_ids:
                columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
            if keep_text:
                columns["decoded"] = pa.array(whole, pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    # small batches: ids and places take some 30 bytes for each of text
    extra = ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return in_arrow(rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}", most=1 << 20)
