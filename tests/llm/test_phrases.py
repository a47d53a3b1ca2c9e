"""Phrases against plain counts."""

import random
import re
from collections import Counter

import pytest

from quorial.llm import phrases as P

KIND = "doc_id long, text string, lang string"


def plain(rows, least, top=2000):
    """Every phrase of up to five words counted in a dictionary."""
    counts, n = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + k] for q, b in cand.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= 100 * f[q[i : i + k]]}
        found = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((" ".join(p), a, f[p[:k]], f[p[k:]], n[lang], score))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(found[:top])]
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r) for r in P.phrases(df, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, docs=60):
    rng = random.Random(seed)
    words = ["the", "of", "Öl", "new", "york", "city", "hall", "a", "b", "x" * 60, "über", "é"]
    rows = []
    for i in range(docs):
        out = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 4)):
            out.insert(rng.randint(0, len(out)), "New  York\tCity")
        text = "".join(w + rng.choice([" ", " ", " ", ", ", ".", "\r\n", "! "]) for w in out)
        rows.append((i, text, rng.choice(["en", "de", None])))
    return rows


@pytest.mark.parametrize("least", [3, 12])
def test_phrases(spark, least):
    rows = corpus(least)
    df = spark.createDataFrame(rows, KIND).repartition(3)
    assert mined(df, least=least) == plain(rows, least)
    assert mined(df, least=least, top=5) == plain(rows, least, 5)


def test_odd_rows(spark):
    rows = [*corpus(1, 20), *corpus(1, 20), (1, None, "en"), (2, "", None), (None, "a a a a a a a a", "en"), (3, " .,; ", "en"), (4, "one word " * 40_000, "long"), (5, "w" * 100_000, "long")]
    df = spark.createDataFrame(rows, KIND)
    assert mined(df, least=4) == plain(rows, 4)
    wide = df.selectExpr("text", "lang", "1 AS id", "'x' AS word", "2 AS n", "'y' AS phrase", "3 AS W1", "4 AS a")
    assert mined(wide, least=4) == plain(rows, 4)
    assert mined(df.limit(0)) == []
    assert mined(df.where("text = ''")) == []


@pytest.mark.parametrize("most", [1, 12, 60])
def test_large_prefixes_are_projected_on(spark, monkeypatch, most):
    rng = random.Random(9)
    rows = [(i, " ".join(["hot pair " + " ".join(rng.choices("abcdef", k=4)) for _ in range(40)]) + " stop here now", "en") for i in range(20)]
    df = spark.createDataFrame(rows, KIND).repartition(4)
    monkeypatch.setattr(P, "MOST", most)
    monkeypatch.setattr(P, "BLOCK", 7)
    depths = []
    real = P._projected_on
    monkeypatch.setattr(P, "_projected_on", lambda blocks, depth: depths.append(depth) or real(blocks, depth))
    assert mined(df, least=3) == plain(rows, 3)
    assert depths == {1: [1, 2, 3, 4], 12: [1, 2, 3], 60: [1, 2]}[most][: len(depths)] and depths


def test_blocks():
    rng = P.np.random.default_rng(2)
    rows = P._combined([P.np.r_[rng.integers(1, 4, (5, 500)), P.np.ones((1, 500), P.np.int64)]])
    assert rows[-1].sum() == 500 and rows.shape[1] == len({tuple(c) for c in rows[:5].T.tolist()})
    for depth in (1, 2, 4):
        b = P._blocks(rows, depth)
        back = [P._unpacked(x) for x in b.column(3).to_pylist()]
        assert (P.np.concatenate(back, 1) == rows).all()
        assert all((r[:depth] == P.np.array(p)[:, None]).all() for r, p in zip(back, b.column(0).to_pylist(), strict=True))
        assert b.column(1).to_pylist() == [r.shape[1] for r in back] and b.column(2).to_pylist() == [int(r[-1].sum()) for r in back]
    assert P._blocks(rows[:, :0], 1).num_rows == 0


def test_words_of_one_number_get_another(spark, monkeypatch):
    rows = corpus(4, 15)
    df = spark.createDataFrame(rows, KIND)
    seeds = []
    real = P._word_counts

    def colliding(r, seed):
        seeds.append(seed)
        out = real(r, seed)
        return out.withColumn("id", P.F.lit(5).cast("long")) if seed == 0 else out

    monkeypatch.setattr(P, "_word_counts", colliding)
    assert mined(df, least=4) == plain(rows, 4)
    assert seeds == [0, 1]


def test_scores_beyond_64_bits(spark):
    df = spark.range(1).selectExpr("3000000000000L AS a", "90000000000000000L AS n", "4000000000000L AS l", "5000000000000L AS r")
    got = df.selectExpr("(CAST(1000 AS decimal(38,0)) * a * n) div (CAST(l AS decimal(38,0)) * r) AS s").first().s
    assert got == 1000 * 3 * 10**12 * 9 * 10**16 // (4 * 10**12 * 5 * 10**12)
