"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give base spans.  The field looks at what they leave: its segments are whole
candidate spans, scored by features of the whole span (check digits, layout of groups,
separators, what is beside it), and dynamic programming over the boundaries of candidates
chooses boundaries and kinds together.  Entities are bounded to ``GROUPS`` groups of
digits or ``PIECES`` pieces of an address on either side.

A place that no candidate covers has nothing to decide, so a text falls into islands of
overlapping candidates that are decoded one by one, whatever the text's length.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, numbered, pick, position, texts

#: Fixed: kinds in their order.
KINDS = ["email", "ip", "card", "phone"]
GROUPS, PIECES = 7, 4
#: Texts made to learn from, and passes over them.
SAMPLE, PASSES = 1500, 120

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns: of each kind the leftmost matches that
    don't overlap; a match that fails its check is dropped, with no other in its place."""
    out: list[Span] = []
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            after = m.end()
        at = text.find("@", at + 1)
    if not _NUMBER.search(text):
        return out
    for m in _DOTTED.finditer(text):
        parts = list(_NUMBER.finditer(text, *m.span())) if m[0].count(".") > 2 else []
        for k in range(0, len(parts) - 3, 4):
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                out.append((parts[k].start(), parts[k + 3].end(), "ip"))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in _PLUS.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=_order)


def _order(span: Span) -> tuple:
    return span[0], KINDS.index(span[2]), span[1]


#: Fixed: how a dot, and the mark between name and host, are written out.
_DOT = r"(?:[ \t]?[\[({<][ \t]?(?:dot|\.)[ \t]?[\])}>][ \t]?|[ \t](?:dot|DOT|\.)[ \t]|[ \t]\.|\.[ \t]|\.)"
_AT = r"(?:[ \t]?[\[({<][ \t]?(?:at|@)[ \t]?[\])}>][ \t]?|[ \t]@[ \t]?|@[ \t]|[ \t](?:at|AT)[ \t])"
_RUN = re.compile(rf"[+(]{{0,2}}[0-9]++(?:(?:[ .()\-/]{{1,3}}|\s?[\[({{](?:dot|\.)[\])}}]\s?| dot )[0-9]++)*+")
_HOST = re.compile(rf"{_AT}(?=([A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,{PIECES}}}))")
_NAME = re.compile(rf"[A-Za-z0-9_%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,{PIECES - 1}}}$")
_PIECE = re.compile(rf"{_DOT}")
#: Fixed: words that announce a kind, and words that stand before a plain "at".
_KEYS = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|write|contact|courriel|correo)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|addr|address|ping|dns)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|credit|mastercard|amex|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|cell|fax|telefon|whatsapp)\b"),
    "other": re.compile(r"(?i)\b(?:version|order|invoice|isbn|id|no|date|section|chapter|total|ref|build|token)\b"),
}
_COMMON = frozenset("the a an is was are be look looks looked arrive arrived and of in it they we he she you i not all here there out up back one more meet stay live lives work works".split())


class Candidate:
    """A span that may be an entity of a kind, and its features."""

    __slots__ = ("start", "end", "kind", "features")

    def __init__(self, start: int, end: int, kind: str, features: list[str]):
        self.start, self.end, self.kind = start, end, kind
        self.features = [kind, *(f"{kind} {f}" for f in features)]


def _beside(text: str, start: int, end: int) -> list[str]:
    """Features of the characters and words beside a span."""
    kind = lambda c: "blank" if c.isspace() else "word" if c.isalnum() or c in "_@" else "tight" if c in "+-/\\#&=%$" else "mark"
    lead = text[max(0, start - 32) : start]
    keys = sorted((m.end(), k) for k, p in _KEYS.items() for m in p.finditer(lead))
    return [f"before {kind(lead[-1]) if lead else 'blank'}", f"after {kind(text[end]) if end < len(text) else 'blank'}", f"key {keys[-1][1] if keys else 'none'}"]


def _number_candidates(text: str, m: re.Match) -> Iterator[Candidate]:
    spans = [n.span() for n in _NUMBER.finditer(text, *m.span())]
    groups = [text[a:b] for a, b in spans]
    seps = [text[spans[i][1] : spans[i + 1][0]] for i in range(len(spans) - 1)]
    # digits that letters touch are part of a word
    free = lambda at: not (0 <= at < len(text) and (text[at].isalnum() or text[at] == "_"))
    for i in range(len(groups)):
        digits = ""
        if not free(spans[i][0] - 1):
            continue
        for j in range(i, min(i + GROUPS, len(groups))):
            digits += groups[j]
            if len(digits) > 19:
                break
            own, end, kinds = seps[i:j], spans[j][1], []
            if not free(end):
                continue
            if j == i + 3 and all(len(g) <= 3 for g in groups[i : j + 1]) and all("." in s or "dot" in s for s in own):
                kinds.append("ip")
            if 12 <= len(digits) <= 19 and all(s in (" ", "-", ".") for s in own):
                kinds.append("card")
            if 7 <= len(digits) <= 15 and not any("dot" in s for s in own):
                kinds.append("phone")
            if not kinds:
                continue
            start = spans[i][0]
            lead = re.search(r"[+(]{0,2}$|\+ \(?$", text[max(0, start - 3) : start])[0]
            more = [f"left {_size(groups[i - 1])} {_mark(seps[i - 1])}" if i else "left none", f"right {_size(groups[j + 1])} {_mark(seps[j])}" if j + 1 < len(groups) else "right none"]
            bare = _beside(text, start, end) + more
            layout = "-".join(str(len(g)) for g in groups[i : j + 1])
            marks = "one" if not own else "same" if len(set(own)) == 1 else "mixed"
            for kind in kinds:
                if kind == "ip":
                    values = [int(g) for g in groups[i : j + 1]]
                    written = "dots" if all(s == "." for s in own) else "words" if all("dot" in s or s in ("(.)", "[.]") for s in own) else "spaced"
                    yield Candidate(start, end, kind, [*bare, "bytes" if max(values) <= 255 else "large", f"written {written}", "small" if max(values) < 20 else "wide", "zeros" if any(len(g) > 1 and g[0] == "0" for g in groups[i : j + 1]) else "plain"])
                elif kind == "card":
                    shape = "single" if i == j else "fours" if layout in ("4-4-4-4", "4-4-4-4-3", "4-6-5", "4-6-4") else "other"
                    yield Candidate(start, end, kind, [*bare, "luhn" if luhn(digits) else "no luhn", f"digits {len(digits)}", f"shape {shape}", f"marks {marks}", "issued" if digits[0] in "3456" else "not issued"])
                else:
                    size = next(f"to {n}" for n in (9, 11, 13, 15) if len(digits) <= n)
                    date = bool(re.fullmatch(r"(?:19|20)\d\d-\d\d?-\d\d?.*|\d\d?-\d\d?-(?:19|20)\d\d.*", "-".join(groups[i : j + 1])))
                    ends = f"ends {min(len(groups[j]), 5)}"
                    sane = "sane" if all(len(g) <= 4 for g in groups[i : j + 1]) and len(groups[j]) >= 2 else "odd"
                    area = "area" if ")" in "".join(own) else "no area"
                    shape = [f"digits {size}", f"groups {min(j - i + 1, 6)}", ends, sane, area, "date" if date else "no date", f"dots {any('.' in s for s in own)}", "zero" if digits[0] == "0" else "no zero", f"layout {layout}"]
                    # with all, some or none of the signs before it
                    for k in range(len(lead) + 1):
                        sign = lead[k:].replace(" ", "")
                        if not lead[k:].startswith(" "):
                            open_ = "open" if "(" in sign and ")" not in "".join(own) else "closed"
                            yield Candidate(start - len(lead) + k, end, kind, [*_beside(text, start - len(lead) + k, end), *more, f"sign {sign or 'none'} {open_} {area}", f"valid {'+' in sign and 10 <= len(digits) <= 15}", *shape])


def _mark(sep: str) -> str:
    return "dot" if sep == "." else "line" if sep == "-" else "blank" if sep == " " else "more"


def _size(group: str) -> str:
    return "short" if len(group) <= 4 else "middle" if len(group) < 12 else "long"


def _address_candidates(text: str, m: re.Match) -> Iterator[Candidate]:
    name = _NAME.search(text, max(0, m.start() - 70 * PIECES), m.start())
    if not name:
        return
    begins = [name.start()] + [x.end() for x in _PIECE.finditer(text, *name.span()) if x.end() < name.end()]
    host = m.span(1)
    dots = list(_PIECE.finditer(text, *host))
    ends = [dots[k + 1].start() for k in range(len(dots) - 1)] + [host[1]]
    at = "word" if m[0].strip().lower() == "at" else "brackets" if re.search(r"[\[({<]", m[0]) else "spaced"
    for k, end in enumerate(ends):
        written = {"dot" if "dot" in x[0].lower() else "brackets" if x[0].strip() != "." else "dots" if x[0] == "." else "spaced" for x in dots[: k + 1]}
        last = text[dots[k].end() : end]
        for i, start in enumerate(begins):
            local = text[start : m.start()]
            inner = "-".join(sorted({_written(x[0]) for x in _PIECE.finditer(local)})) or "none"
            yield Candidate(start, end, "email", [
                *_beside(text, start, end), f"at {at}", f"at {at} {'-'.join(sorted(written))}", f"pieces left {len(begins) - 1 - i}", f"pieces right {k + 1}", f"beyond {len(ends) - 1 - k}",
                "top" if re.fullmatch("[A-Za-z]{2,4}", last) else "no top", "common" if local.lower() in _COMMON else "own", f"joint {_joint(text, begins, i, start)}", f"inner {inner} {at}", f"leaves {'-' if k + 1 == len(ends) else _written(dots[k + 1][0])}",
            ])


def _written(dot: str) -> str:
    return "tight" if dot == "." else "loose" if dot.strip() == "." else "words"


def _joint(text: str, begins: list[int], i: int, start: int) -> str:
    """How the piece before the first one, if any, would be joined to it."""
    return "none" if not i else "tight" if text[start - 1] == "." and not text[start - 2].isspace() else "loose"


def candidates(text: str, taken: list[Span] = ()) -> list[Candidate]:
    """All candidates that don't overlap ``taken``, in order."""
    out = []
    if _NUMBER.search(text):
        for m in _RUN.finditer(text):
            if m.end() - m.start() >= 7:
                out += _number_candidates(text, m)
    if "@" in text or "at" in text or "AT" in text:
        for m in _HOST.finditer(text):
            out += _address_candidates(text, m)
    if taken and out:
        begin, end = np.array([s for s, _, _ in taken]), np.maximum.accumulate([e for _, e, _ in taken])
        at = np.searchsorted(begin, [c.end for c in out])
        out = [c for c, k in zip(out, at.tolist(), strict=True) if not k or end[k - 1] <= c.start]
    return sorted(out, key=lambda c: (c.start, c.end, KINDS.index(c.kind)))


class Field:
    """Weights of the field: one for each feature, and one for each pair of kinds of
    segments that touch (kind 0: outside)."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def score(self, c: Candidate) -> float:
        return sum(self.weights.get(f, 0.0) for f in c.features)

    def decode(self, found: list[Candidate]) -> list[Span]:
        """The best segmentation of each island of candidates, given in order."""
        out: list[Span] = []
        island: list[Candidate] = []
        reach = -1
        for c in found:
            if island and c.start > reach:
                out += self._island(island)
                island = []
            island.append(c)
            reach = max(reach, c.end) if len(island) > 1 else c.end
        return out + (self._island(island) if island else [])

    def _island(self, found: list[Candidate]) -> list[Span]:
        places = sorted({p for c in found for p in (c.start, c.end)})
        at = {p: i for i, p in enumerate(places)}
        ending: dict[int, list[Candidate]] = {}
        for c in found:
            ending.setdefault(at[c.end], []).append(c)
        states = range(len(KINDS) + 1)
        move = self.moves.tolist()
        best = [[0.0, *[-np.inf] * len(KINDS)]]
        back: list[list] = [[None] * len(states)]
        for t in range(1, len(places)):
            value, came = [-np.inf] * len(states), [None] * len(states)
            y = max(states, key=lambda y: best[t - 1][y] + move[y][0])
            value[0], came[0] = best[t - 1][y] + move[y][0], (t - 1, y, None)
            for c in ending.get(t, ()):
                s, k = at[c.start], KINDS.index(c.kind) + 1
                y = max(states, key=lambda y: best[s][y] + move[y][k])
                if (v := best[s][y] + move[y][k] + self.score(c)) > value[k]:
                    value[k], came[k] = v, (s, y, c)
            best.append(value)
            back.append(came)
        out, t = [], len(places) - 1
        y = max(states, key=lambda y: best[t][y])
        while t:
            t, y, c = back[t][y]
            if c is not None:
                out.append((c.start, c.end, c.kind))
        return out[::-1]


def labelled_texts(count: int, seed: int = 5) -> Iterator[tuple[str, list[Span]]]:
    """Texts made by rule, each with its entities: entities in the formats of the patterns
    and in others, alone and next to one another, and numbers that are none."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefghiklmnoprstuvwz", k=rng.randint(2, 8)))
    byte = lambda: str(rng.randint(0, 255))

    def card() -> str:
        body = rng.choice("4456") + digits(14) if rng.random() < 0.85 else rng.choice(["34", "37"]) + digits(12)
        body += next(d for d in "0123456789" if luhn(body + d))
        mark = rng.choice(["", "", "", " ", "-", "."])
        cuts = (4, 8, 12) if len(body) == 16 else (4, 10)
        return mark.join(body[a:b] for a, b in zip((0, *cuts), (*cuts, len(body)), strict=True))

    def phone() -> str:
        a, b, c, country = digits(3), digits(3), digits(4), rng.choice(["1", "44", "49", "33", "34", "351"])
        return rng.choice([f"+{country} ({a}) {b}-{c}"] * 4 + [f"+{country} {a} {b} {c}", f"+{country}-{a}-{b}-{c}", f"+{country}{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{country}.{a}.{b}.{c}", f"+{country} {a} {digits(2)} {digits(2)} {digits(2)}", f"(+{country}) {a} {b} {c}", f"00{country} {a} {b} {c}"])

    def ip() -> str:
        return rng.choice([".", ".", ".", ".", "[.]", " dot ", "[dot]", "(dot)", " . "]).join(byte() for _ in range(4))

    def email() -> str:
        name, host, top = word() + rng.choice(["", digits(2)]), word(), rng.choice(["com", "org", "net", "de", "fr", "es"])
        at, dot = rng.choice([("@ ", "."), (" @ ", "."), (" at ", " dot "), (" at ", " dot "), ("[at]", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "."), (" AT ", " DOT ")])
        local = name if rng.random() < 0.6 else f"{word()}{'.' if dot == '.' else dot}{name}"
        return f"{local}{at}{host}{dot}{top}" if rng.random() < 0.7 else f"{local}{at}{host}{dot}{word()}{dot}{top}"

    makers = {"card": card, "phone": phone, "ip": ip, "email": email}
    keys = {"card": ["card", "visa", "credit card:"], "phone": ["phone", "tel.", "call", "mobile:"], "ip": ["ip", "server", "host"], "email": ["email", "mail:", "write to", "contact"]}

    def wrong() -> str:
        bad = rng.choice("0123456789") + digits(15)
        year = rng.choice(["1998", "2019", "2024"])
        return rng.choice([
            bad if not luhn(bad) else bad[:-1] + str((int(bad[-1]) + 1) % 10), digits(rng.randint(7, 13)), f"{year}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {rng.randint(10, 23)}", f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{year}",
            f"version {rng.randint(1, 9)}.{rng.randint(0, 19)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}", ".".join(byte() for _ in range(rng.choice([3, 5, 6]))), f"{rng.randint(300, 999)}.{byte()}.{byte()}.{byte()}", f"{digits(3)},{digits(3)},{digits(3)}",
            f"{year} {rng.choice(['2018', '2020'])} {digits(3)}", f"order {digits(8)}", f"isbn 978-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", f"{word()}{digits(16)}", f"{digits(12)}{word()}", *["".join(rng.choices("0123456789abcdef", [6] * 10 + [2] * 6, k=rng.randint(24, 64))) for _ in range(3)], " ".join(digits(2) for _ in range(6)), f"{digits(4)} {digits(4)} {digits(4)}", " ".join(digits(rng.randint(1, 3)) for _ in range(8)), digits(rng.randint(20, 30)), f"{word()}-{digits(3)}-{digits(3)}-{digits(4)}",
            f"{rng.choice(['look', 'arrived', 'was', 'stay', word()])} at {word()}. {word().title()} {word()}", f"{rng.choice(['look', 'is', word()])} at {word()}.{rng.choice(['com', 'org'])}", f"{word()} at the {word()} dot {word()}", f"{word()} @ {word()}. {word().title()}",
            f"{rng.choice([word(), word(), 'the', 'as'])} at {rng.choice(['it', 'the', word()])}. {word().title()}. {word().title()}", f"{word()} at {word()}. {word().title()} {word()}. {word().title()}",
        ])

    for _ in range(count):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 4))), []
        for _ in range(rng.choice([1, 1, 2, 2, 3])):
            text += rng.choice([" ", " ", " ", ", ", ". ", ": ", "\n", " (", '"'] if text else [""])
            if rng.random() < 0.55:
                kind = rng.choice(list(makers))
                if rng.random() < 0.3:
                    text += rng.choice(keys[kind]) + " "
                made = makers[kind]()
                spans.append((len(text), len(text) + len(made), kind))
                text += made
            else:
                text += wrong()
            if rng.random() < 0.6:
                text += rng.choice([" ", " ", ", ", ". ", ") ", "\n"]) + " ".join(word() for _ in range(rng.randint(1, 3)))
        yield text, spans


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def _segments(labelled: list[tuple[str, list[Span]]]) -> tuple[list, dict[str, int]]:
    """Of each text with reachable entities its candidates, as numbers: text, from and to
    (places among the boundaries of candidates), kind, whether it is an entity, features."""
    names: dict[str, int] = {}
    rows, at_text = [], 0
    for text, spans in labelled:
        found = candidates(text)
        if {s for s in spans} - {(c.start, c.end, c.kind) for c in found}:
            continue
        place = {p: i for i, p in enumerate(sorted({p for c in found for p in (c.start, c.end)}))}
        gold = set(spans)
        for c in found:
            rows.append((at_text, place[c.start], place[c.end], KINDS.index(c.kind) + 1, (c.start, c.end, c.kind) in gold, [names.setdefault(f, len(names)) for f in c.features]))
        at_text += bool(found)
    return rows, names


def train(labelled: list[tuple[str, list[Span]]], passes: int = PASSES, shrink: float = 0.02) -> Field:
    """Weights by the conditional likelihood of the entities, with forward and backward
    sums over all segmentations of all texts at once, and Adam steps."""
    rows, names = _segments(labelled)
    kinds = len(KINDS) + 1
    if not rows:
        return Field({}, np.zeros((kinds, kinds)))
    text, begin, end, kind, gold = (np.array([r[k] for r in rows]) for k in range(5))
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, r[5]] = 1
    texts_, last = int(text.max()) + 1, np.zeros(int(text.max()) + 1, int)
    np.maximum.at(last, text, end)
    steps = int(last.max())
    by_end = [np.flatnonzero(end == t) for t in range(steps + 1)]
    by_begin = [np.flatnonzero(begin == t) for t in range(steps + 1)]
    # the true path: what each place was reached by, outside where no entity lies
    moves_seen = np.zeros((kinds, kinds))
    for b in range(texts_):
        mine = {int(begin[i]): i for i in np.flatnonzero((text == b) & gold)}
        t = y = 0
        while t < last[b]:
            to, t = (int(kind[mine[t]]), int(end[mine[t]])) if t in mine else (0, t + 1)
            moves_seen[y, to] += 1
            y = to
    seen = x[gold].sum(0)
    w, move = np.zeros(len(names)), np.zeros((kinds, kinds))
    state = [np.zeros(len(w) + move.size) for _ in range(2)]
    for step in range(1, passes + 1):
        score = x @ w
        ahead = np.full((texts_, steps + 1, kinds), -np.inf)
        ahead[:, 0, 0] = 0
        for t in range(1, steps + 1):
            on = last >= t
            ahead[on, t, 0] = _logsum(ahead[on, t - 1] + move[None, :, 0], 1)
            i = by_end[t]
            if len(i):
                np.logaddexp.at(ahead, (text[i], t, kind[i]), _logsum(ahead[text[i], begin[i]] + move.T[kind[i]], 1) + score[i])
        z = _logsum(ahead[np.arange(texts_), last], 1)
        behind = np.full((texts_, steps + 1, kinds), -np.inf)
        behind[np.arange(texts_), last] = 0
        flow = np.zeros((kinds, kinds))
        share = np.zeros(len(rows))
        for t in range(steps - 1, -1, -1):
            on = np.flatnonzero(last > t)
            out = behind[on, t + 1, 0]
            flow[:, 0] += np.exp(ahead[on, t] + move[None, :, 0] + out[:, None] - z[on, None]).sum(0)
            behind[on, t] = np.logaddexp(behind[on, t], move[None, :, 0] + out[:, None])
            i = by_begin[t]
            if len(i):
                out = score[i] + behind[text[i], end[i], kind[i]]
                each = np.exp(ahead[text[i], t] + move.T[kind[i]] + out[:, None] - z[text[i], None])
                share[i] = each.sum(1)
                np.add.at(flow.T, kind[i], each)
                np.logaddexp.at(behind, (text[i], t), move.T[kind[i]] + out[:, None])
        slope = np.r_[seen - share @ x, (moves_seen - flow).ravel()] / texts_ - shrink / 10 * np.r_[w, move.ravel()]
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.99 * state[1] + 0.01 * slope * slope
        change = 0.15 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-6)
        w, move = w + change[: len(w)], move + change[len(w) :].reshape(kinds, kinds)
    return Field({n: float(w[i]) for n, i in names.items()}, move)


@cache
def default_field(count: int = SAMPLE, passes: int = PASSES) -> Field:
    """The field learned from ``count`` texts made by rule; the tables have no labels."""
    return train(list(labelled_texts(count)), passes)


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The base spans of a text, and those together with what the field adds."""
    base = base_spans(text)
    added = field.decode(candidates(text, base))
    return base, sorted(base + added, key=_order)


_SPAN = "array<struct<kind:string,start:long,end:long>>"


def personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans`` for every row: the spans of the fixed patterns, and all, as
    arrays of (kind, start, end) in code points, end exclusive, by start, then kind.

    Spans that the field adds overlap no others.  Null and empty texts have none; rows
    that repeat, or have a null id, have theirs each; other columns play no part; an
    empty table gives an empty result.
    """
    field = field or default_field()
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in spans]
        for b in batches:
            found = [all_spans(t, field) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([as_rows(f[i]) for f in found], kind) for i in (0, 1)]], ["doc_id", "base", "spans"])

    return in_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base {_SPAN}, spans {_SPAN}")


def personal_data_digest(docs: DataFrame, field: Field | None = None, **columns) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every
    row of ``personal_data``: counts and digest of base spans, all spans as text, and how
    many the field has added."""
    found = personal_data(docs, field, **columns)
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with its spans replaced by their kinds; of overlapping ones the first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_personal_data(docs: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by ``[kind]``; all rows and
    other columns stay, null texts too."""
    field = field or default_field()
    at = position(docs, text_col)
    rows = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [None if t is None else mask(t, all_spans(t, field)[1]) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at).name, pa.array(clean, pa.string()))

    return in_arrow(rows, run, rows.schema, text_at=at).toDF(*docs.columns)
