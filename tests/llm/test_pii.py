"""Personal data: patterns against plain regular expressions, decoding and training against
all segmentations, and held-out accuracy."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from quorial.llm import pii as P

KIND = "doc_id long, text string"


def plain_base(text):
    """The contract's patterns as they are written."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in digits(m[0])][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(x * 2 // 10 + x * 2 % 10 for x in d[1::2])) % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], P.KINDS.index(s[2])))


def noisy(rng):
    parts = ["a@b.c", "x.y@z", "@", "a@b.c@d.e", "@a.b", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "000255.0.0.1", ".", "4349000490986231", "4349 0004 9098 6231", "4349-0004-9098-6231-", "+1 (269) 555-3296", "+49", "++12345678901", "+1 2 3", "é@é.fr", "7", " ", "-", "%+-_@h-.co", "(", ")", "\n", "ß"]
    return "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 14)))


def test_base_spans():
    rng = random.Random(1)
    for _ in range(4000):
        text = noisy(rng)
        assert P.base_spans(text) == plain_base(text), text
    for long in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "a.b@" * 50_000, "+1(" * 100_000):
        P.base_spans(long)


@pytest.fixture(scope="module")
def field():
    return P.default_field()


def segmentations(found):
    """All sets of candidates that don't overlap."""
    for k in range(len(found) + 1):
        for chosen in itertools.combinations(found, k):
            if all(a.end <= b.start for a, b in itertools.pairwise(sorted(chosen, key=lambda c: c.start))):
                yield sorted(chosen, key=lambda c: c.start)


def value(field, found, chosen):
    places = sorted({p for c in found for p in (c.start, c.end)})
    starts, t, y, total = {c.start: c for c in chosen}, 0, 0, 0.0
    while t < len(places) - 1:
        c = starts.get(places[t])
        to = P.KINDS.index(c.kind) + 1 if c else 0
        total += field.moves[y, to] + (field.score(c) if c else 0)
        y, t = to, places.index(c.end) if c else t + 1
    return total


def small_islands(count):
    out = []
    for text, _ in P.labelled_texts(400, seed=31):
        island = []
        for c in P.candidates(text):
            if island and c.start > max(x.end for x in island):
                break
            island.append(c)
        if 2 <= len(island) <= 9:
            out.append(island)
    return out[:count]


def test_decoding_is_the_best_segmentation(field):
    for island in small_islands(60):
        best = max(segmentations(island), key=lambda s: value(field, island, s))
        got = field.decode(island)
        assert value(field, island, best) == pytest.approx(value(field, island, [c for s in got for c in island if (c.start, c.end, c.kind) == s]))
        assert got == [(c.start, c.end, c.kind) for c in best]


def test_training_follows_the_likelihood():
    """Steps raise the likelihood computed over all segmentations, without weights' price."""
    labelled = [(t, s) for t, s in P.labelled_texts(200, seed=3) if 1 <= len(P.candidates(t)) <= 9 and not set(s) - {(c.start, c.end, c.kind) for c in P.candidates(t)}][:30]
    assert len(labelled) > 10

    def likelihood(f):
        out = 0.0
        for text, spans in labelled:
            found = P.candidates(text)
            total = [value(f, found, s) for s in segmentations(found)]
            mine = value(f, found, [c for c in found if (c.start, c.end, c.kind) in set(spans)])
            out += mine - max(total) - math.log(sum(math.exp(v - max(total)) for v in total))
        return out / len(labelled)

    values = [likelihood(P.train(labelled, passes)) for passes in (0, 1, 5, 40)]
    assert values == sorted(values) and values[-1] > -0.3
    assert P.train([], 3).weights == {}


def test_gradient(monkeypatch):
    """One Adam step goes the way of a numeric slope, weight by weight."""
    labelled = [(t, s) for t, s in P.labelled_texts(60, seed=8) if 2 <= len(P.candidates(t)) <= 8 and not set(s) - {(c.start, c.end, c.kind) for c in P.candidates(t)}][:5]
    f = P.train(labelled, 1)

    def likelihood(weights, moves):
        g, out = P.Field(weights, moves), 0.0
        for text, spans in labelled:
            found = P.candidates(text)
            out += value(g, found, [c for c in found if (c.start, c.end, c.kind) in set(spans)]) - math.log(sum(math.exp(value(g, found, s)) for s in segmentations(found)))
        return out

    zero = np.zeros((5, 5))
    for name, w in f.weights.items():
        slope = (likelihood({name: 1e-4}, zero) - likelihood({name: -1e-4}, zero)) / 2e-4
        assert abs(slope) < 1e-3 or np.sign(slope) == np.sign(w), name


def test_held_out_texts(field):
    right = wrong = missed = 0
    for text, spans in P.labelled_texts(600, seed=77):
        got, want = set(field.decode(P.candidates(text))), set(spans)
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("erntou +1 (269) 555-3296 4524132264652876 and", [("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")]),
        ("7536784127813050 4845168114407329 x", [("card", "4845168114407329")]),
        ("write to jo dot smith at example dot org now", [("email", "jo dot smith at example dot org")]),
        ("mail: kim7 [at] mail [dot] net", [("email", "kim7 [at] mail [dot] net")]),
        ("server 10[.]20[.]30[.]40 is up", [("ip", "10[.]20[.]30[.]40")]),
        ("gech. 99.114.106.61 4080166431094600 Er", [("ip", "99.114.106.61"), ("card", "4080166431094600")]),
    ],
)
def test_what_the_patterns_miss(field, text, want):
    got = [(k, text[a:b]) for a, b, k in P.all_spans(text, field)[1]]
    assert [w for w in want if w in got] == want


def test_plain_texts_stay_clean(field):
    rng = random.Random(4)
    for _ in range(300):
        text = " ".join("".join(rng.choices("abcdeghinorstu", k=rng.randint(1, 8))) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(80))
        text += f" it was at the end. Then. token = \"{''.join(rng.choices('0123456789abcdef', k=40))}\" in {rng.randint(1900, 2030)} and {rng.randint(1, 99999)}"
        base, every = P.all_spans(text, field)
        assert every == base and len(base) <= 1  # digits of a token can pass for a card's


def test_query(spark, field):
    rng = random.Random(6)
    rows = [(i, noisy(rng)) for i in range(80)] + [(i, t) for i, (t, _) in enumerate(P.labelled_texts(60, seed=12))]
    rows += [(1, None), (2, ""), (None, "a@b.c"), (3, "x " * 200_000 + "a@b.c"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, KIND).selectExpr("doc_id", "text", "1 AS spans", "'q' AS kind", "2 AS Base")
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans, r.n_added) for r in P.personal_data_digest(df).collect()), key=repr)
    listed = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
    want = []
    for i, text in rows:
        base, every = plain_base(text or ""), P.all_spans(text or "", field)[1]
        assert set(base) <= set(every)
        want.append((i, *[sum(k == x[2] for x in base) for k in P.KINDS], hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(every) - len(base)))
    assert got == sorted(want, key=repr)
    assert P.personal_data_digest(df.limit(0)).count() == 0
    clean = P.redact_personal_data(df)
    assert clean.columns == df.columns and clean.dtypes == df.dtypes
    by = sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr)
    assert by == sorted(((i, None if t is None else P.mask(t, P.all_spans(t, field)[1])) for i, t in rows), key=repr)
    assert (None, "[email]") in by
