"""Toxicity, fingerprints, near copies and decontamination against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from quorial.llm import components as K
from quorial.llm import fingerprints as P
from quorial.llm import ngram_join as J
from quorial.llm import toxicity as X
from quorial.llm.common import ascii_words, word_hashes
from quorial.llm.components import components
from quorial.llm.decontaminate import SuffixAutomaton, benchmark_hits, decontaminate

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOC)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 7))) for _ in range(n))


# --- toxicity ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        bad, text = i % 4 == 0, prose(rng, 40) + " you there"
        if bad:
            text += f" you {rng.choice(['grumbok', 'snarfel', 'zotwick'])} " + prose(rng, 5)
        rows.append((i, text))
        labels.append((i, None if i % 50 == 7 else 1, int(bad)))
    hidden = [(1000, "you gruuuumb0k"), (1001, "well s n a r f e l here"), (1002, "what a zotwiiiick!"), (1003, prose(rng, 30)), (1004, None), (1005, ""), (1003, "x")]
    rows += hidden
    label_df = spark.createDataFrame(labels + [(0, 1, 0), (5000, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    return docs(spark, rows), label_df, dict(rows[:240])


def test_toxicity(toxic):
    df, labels, _ = toxic
    out = X.toxicity(df, labels).collect()
    assert len(out) == df.count()
    by = {r.doc_id: r for r in out}
    assert [by[i].predicted for i in (1000, 1001, 1002, 1004, 1005)] == [1, 1, 1, 0, 0]
    held = [r for r in out if r.doc_id < 240 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum((r.predicted == 1) == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_clean_documents_stay(toxic):
    df, labels, _ = toxic
    kept = X.keep_clean(df, labels)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not {1000, 1001, 1002} & set(ids) and {1004, 1005} <= set(ids) and ids.count(1003) == 2
    assert X.toxicity(df, labels.limit(0)).where("predicted = 1").count() == 0
    assert X.toxicity(df.limit(0), labels).count() == 0


def test_odd_tables_and_ties(toxic, spark):
    df, labels, texts = toxic
    wide = df.withColumnRenamed("lang", "score").withColumnRenamed("source", "key").withColumnRenamed("n_chars", "Text")
    more = spark.createDataFrame([(3000, "grumbok " * 30_000, "", "", None), (3001, "plain " * 30_000, "", "", None), (3001, "plain " * 30_000, "", "", None), (None, "you zotw1ck", "", "", None)], wide.schema)
    wide = wide.union(more)
    out = X.toxicity(wide, labels).collect()
    assert len(out) == wide.count() and {(r.doc_id, r.predicted) for r in out if r.doc_id is None or r.doc_id >= 3000} == {(3000, 1), (3001, 0), (None, 1)}
    scores = {}
    for r in X.toxicity(df.union(df), labels).collect():
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(v) == 1 for i, v in scores.items() if i != 1003)
    kept = X.keep_clean(wide, labels)
    assert kept.columns == wide.columns and kept.where("doc_id = 3001").count() == 2 and kept.where("doc_id = 3000 OR doc_id IS NULL").count() == 0


@pytest.fixture(scope="module")
def reading(spark):
    text = "idiot worthless stupid trash hello world " * 20 + "the bill ball " * 9 + "гад " * 9
    words = X.word_counts(spark.createDataFrame([(text,)], "text string")).cache()
    model = spark.sparkContext.broadcast(X.log_probabilities(X.trigram_counts(words)))

    def read(*tokens, spaced=False):
        odd = [o for t in tokens for o in (X.spaced_runs(t) if spaced else X.words_and_odd(t)[1])]
        found = X.restored(spark.createDataFrame([(o,) for o in odd], "odd string"), model, words).collect()
        return {w for r in found for w in r.words}

    return read, X.Restorer(model.value)


def test_restoration(reading):
    read, _ = reading
    assert {"idiot", "worthless", "stupid", "trash"} <= read("1d10t", "w0rthl355", "$tupid", "tr4sh.", "stuuuupid")
    assert {"idiot"} <= read("an i.d.1.o.t here", spaced=True) and {"idiot"} <= read("so i  d  i  o  t here", spaced=True)
    assert read("idіоt") == {"idiot"} and X.words_and_odd("2024") == ([], [])
    # counts of words tell doubled letters and i from l, where characters don't
    assert read("гадддд") == {"гад"} and "ball" in read("ba11") and "bill" in read("b1ll")


def test_paths_against_every_reading(reading):
    _, restorer = reading
    rng = random.Random(3)
    for n in range(300):
        token = "".join(rng.choice("abst013$|!66éаг-") * rng.choice([1, 1, 2, 3]) for _ in range(rng.randint(1, 5)))
        spaced = n % 2 == 0
        best = {}
        for way in itertools.product(*restorer.lattice(token, spaced)):
            text = "".join(t for t, _ in way)
            cost = sum(w for _, w in way) + sum(restorer.likelihood(w) for w in text.split(" "))
            best[text] = min(cost, best.get(text, 1e9))
        got = restorer.paths(token, spaced, most=10**6)
        assert dict((t, pytest.approx(w)) for w, t in got) == best
        assert restorer.paths(token, spaced)[0][0] == pytest.approx(min(best.values()))


def test_rules_follow_the_counts(spark):
    rng = random.Random(5)
    rows = [(prose(rng, 12) + (" vile" if i % 2 and i < 40 else "") + (" mean thing" if i % 3 == 0 else ""), None, int(bool(i % 2 and i < 40))) for i in range(90)]
    rows += [(rows[1][0], None, 1)] * 3 + [("hidden", ["vile"], 1), ("", None, 0)]
    rules = dict(X.learn_rules(spark.createDataFrame(rows, "text string, restored array<string>, toxic int")))
    has = [X.features(ascii_text.split()) | X.features(more or []) for ascii_text, more, _ in rows]
    assert set(rules) == {"vile"}
    bad = sum(t for f, (*_, t) in zip(has, rows, strict=True) if "vile" in f)
    assert rules["vile"] == pytest.approx((bad + 0.1) / (sum("vile" in f for f in has) + 0.2))


# --- fingerprints -----------------------------------------------------------------


def test_fingerprints_follow_the_next_document(spark):
    rng = random.Random(6)
    rows = [(i * 3, prose(rng, rng.randint(0, 30)) + " the " + prose(rng, 4)) for i in range(60)] + [(500, None), (501, ""), (502, "Ünï 🙂 the çé"), (503, "the of the"), (None, "no id")]
    df = docs(spark, rows)
    out = {r.doc_id: r for r in P.fingerprints(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(out) == len(rows)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = (set(P.signatures(x).tolist()) for x in (t, edited, nxt))
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))
        assert set(P.unpacked(r.fingerprint).tolist()) == a and r.edited_fingerprint == P.packed(P.signatures(edited))
    one = P.fingerprints(docs(spark, [(1, "the lone text")])).first()
    assert one.near_next == 1.0
    assert P.fingerprints(df.limit(0)).count() == 0


def test_near_fingerprints_against_all_pairs(spark):
    rng = random.Random(8)
    base = [("the ".join(prose(rng, 3) + " " for _ in range(12))) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base + [b + " the last word" for b in base] + [base[0], "the", None])]
    sets = {}
    for i, t in rows:
        sets.setdefault(P.packed(P.signatures(t or "")), i)
    want = {}
    for (f, i), (g, j) in itertools.combinations(sets.items(), 2):
        a, b = set(P.unpacked(f).tolist()), set(P.unpacked(g).tolist())
        if len(a & b) / len(a | b) >= 0.8:
            want[min(i, j), max(i, j)] = len(a & b) / len(a | b)
    got = {(r.a, r.b): r.likeness for r in P.near_copies(docs(spark, rows)).collect()}
    assert want and got == pytest.approx(want)


# --- n-gram join ------------------------------------------------------------------


def brute_join(rows):
    sets = [(i, frozenset(J.ngrams([t or ""], 5)[0].tolist())) for i, t in rows]
    links, parent = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if len(x & y) / len(x | y) >= 0.8:
            links[a] += 1
            links[b] += 1
            parent[find(b)] = find(a)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, low[find(k)], links[k]) for k, (i, _) in enumerate(sets))


def near_group(rng, n, size=120):
    base = prose(rng, size).split()
    out = []
    for _ in range(n):
        words = list(base)
        words[rng.randrange(size)] = "changed" + str(rng.randrange(9))
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block,grams", [(256, 400_000), (8, 400_000), (256, 700)])
def test_join_against_all_pairs(spark, monkeypatch, block, grams):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "GRAMS", grams)
    rng = random.Random(9)
    rows = [(i, prose(rng, 60)) for i in range(30)]
    rows += [(100 + k, t) for k, t in enumerate(near_group(rng, 40))]
    rows += [(200 + k, rows[3][1]) for k in range(12)] + [(300, "short one"), (301, "Short, ONE"), (302, ""), (303, None), (304, "!!"), (200, rows[3][1])]
    # one id for several texts, of one group and of others
    a, b = prose(rng, 80), prose(rng, 80)
    rows += [(5, a), (5, b), (400, a + " more"), (401, b + " more"), (402, b + " more of it"), (400, prose(rng, 30)), (101, a + " more")]
    rows += [(500, "long word " * 30_000 + prose(rng, 3000)), (501, "long word " * 30_000)]
    rows.append((502, rows[-2][1] + " end"))
    df = docs(spark, rows).withColumnRenamed("lang", "class_id").withColumnRenamed("source", "digest").withColumnRenamed("n_chars", "n_links")
    got = sorted(tuple(r) for r in J.ngram_join(df).collect())
    assert got == brute_join(rows)
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    low = {(i, c) for i, c, _ in got}
    assert sorted({r.doc_id for r in kept.collect()}) == sorted({c for _, c in low})
    assert [r.text for r in kept.where("doc_id = 200").collect()] == [] and kept.where("doc_id = 5").count() == 3


def test_join_odd_tables(spark):
    assert J.ngram_join(docs(spark, [(1, "a")]).limit(0)).count() == 0
    nulls = [tuple(r) for r in J.ngram_join(docs(spark, [(None, "same text here"), (4, "same text here"), (None, "alone")])).collect()]
    assert sorted(nulls, key=repr) == sorted([(None, None, 1), (4, 4, 1), (None, None, 0)], key=repr)
    kept = J.keep_one(docs(spark, [(1, "a b c"), (2, "A b c"), (None, "a b c"), (3, "z")]))
    assert kept.columns == DOC.replace(" long", "").replace(" string", "").split(", ") and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]


def broadcasts(spark, run):
    """Of the executions that ``run`` starts: how many there are, and how many broadcast a table."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()

    def known():
        bus.waitUntilEmpty()
        seen = store.executionsList()
        return {x.executionId(): x for x in map(seen.apply, range(seen.size()))}

    before = max(known(), default=-1)
    run()
    plans = [x.physicalPlanDescription() for k, x in known().items() if k > before]
    return len(plans), sum("BroadcastExchange" in p for p in plans)


def copies_of_three(spark):
    rng = random.Random(11)
    parts = [prose(rng, 60) for _ in range(3)]
    return docs(spark, [(k, parts[k % 3] + f" end{k}" * (k % 5 > 0)) for k in range(30)])


def test_keep_one_sends_no_table_through_the_driver(spark):
    kept = []
    runs, sent = broadcasts(spark, lambda: kept.extend(r.doc_id for r in J.keep_one(copies_of_three(spark)).collect()))
    assert sorted(kept) == [0, 1, 2] and runs > 8 and sent == 0


def test_join_sends_no_table_through_the_driver(spark):
    classes = []
    runs, sent = broadcasts(spark, lambda: classes.extend(r.class_id for r in J.ngram_join(copies_of_three(spark)).collect()))
    assert sorted(classes) == [0] * 10 + [1] * 10 + [2] * 10 and runs > 8 and sent == 0


def test_hashes_tell_words_apart():
    rng = random.Random(7)
    texts = ["", "  ", "Ünï the 🙂x", "a" * 47 + " " + "a" * 48 + " " + "a" * 49 + " " + "a" * 50, prose(rng, 400), "the", "x-THE the2"] + [prose(rng, rng.randint(0, 9)) for _ in range(50)]
    h, starts = word_hashes(texts)
    words = [w for t in texts for w in ascii_words(t)]
    assert np.diff(starts).tolist() == [len(ascii_words(t)) for t in texts] and len(h) == len(words)
    assert len(set(zip(h.tolist(), words, strict=True))) == len(set(h.tolist())) == len(set(words))
    alone = [g.tolist() for t in texts for g in J.ngrams([t], 5)]
    together = J.ngrams(texts, 5)
    assert alone == [g.tolist() for g in together] and all(g == sorted(set(g)) for g in alone)
    a, b = J._seeds(6)
    for g, sig in zip(together, J.signatures(together, 3, 2), strict=True):
        low = [min((int(x) * int(p) + int(q)) % 2**64 for x in g) for p, q in zip(a, b, strict=True)]
        same = J.signatures([g], 3, 2)[0]
        assert sig.tolist() == same.tolist() and len(low) == 6


def test_banding():
    bands, rows = J.banding(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 160


@pytest.mark.parametrize("edges", [100_000, 10])
def test_components_write_few_edges_in_few_files(spark, monkeypatch, edges):
    files, stored = [], K.stored

    def noted(df, name):
        out = stored(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(K, "stored", noted)
    monkeypatch.setattr(K, "EDGES", edges, raising=False)
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set(merged, "false")
        out = {r.node: r.root for r in components(spark.createDataFrame([(i, i - i % 10) for i in range(60)], "u long, v long")).collect()}
    finally:
        spark.conf.unset(merged)
    assert out == {i: i - i % 10 for i in range(60)}
    assert len(files) > 2 and max(files[1:]) <= (1 if edges > 54 else 4)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 130), 100)}


# --- decontamination ----------------------------------------------------------------


def brute_hits(items, words, window):
    hit, found = [False] * len(words), set()
    for n, item in enumerate(items):
        k = min(window, len(item))
        spans = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if item else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in spans:
                found.add(n)
                hit[i : i + k] = [True] * k
    return hit, found


def test_automaton_against_all_windows():
    rng = random.Random(1)
    for _ in range(600):
        letters = [bytes([97 + i]) for i in range(rng.choice([2, 3, 6]))]
        window = rng.choice([2, 3, 8])
        items = [[rng.choice(letters) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(0, 5))]
        words = [rng.choice([*letters, b"zz"]) for _ in range(rng.randint(0, 40))] + (items[0] if items else [])
        hit, by_short, found = SuffixAutomaton([(str(i), w) for i, w in enumerate(items)], window).scan(words)
        assert (hit.tolist(), found) == brute_hits(items, words, window)
        assert by_short.tolist() == brute_hits([x if len(x) < window else [] for x in items], words, window)[0]


def test_hits_and_removal(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (10, "Short, item"), (2, None), (3, "!!"), (None, "x y")], "item_id long, text string")
    rows = [(1, "A ONE two three-four five six seven eight z Short item"), (2, "clean text"), (3, None), (4, ""), (1, "clean text"), (5, "short item")]
    out = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in benchmark_hits(docs(spark, rows), bench).collect())
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out == sorted([(1, 12, 10, 2, digest("1,10"), True), (2, 2, 0, 0, digest(""), False), (3, 0, 0, 0, digest(""), False), (4, 0, 0, 0, digest(""), False), (1, 2, 0, 0, digest(""), False), (5, 2, 2, 1, digest("10"), False)])
    kept = {(r.doc_id, r.text) for r in decontaminate(docs(spark, [*rows[1:5], (7, "a b c d e f g h i j k one two three four five six seven eight, end")]), bench).collect()}
    assert kept == {(2, "clean text"), (3, None), (4, ""), (1, "clean text"), (7, "a b c d e f g h i j k , end")}
    assert decontaminate(docs(spark, rows), bench).where("doc_id = 5").count() == 0
    assert benchmark_hits(docs(spark, rows), bench.limit(0)).where("n_items > 0").count() == 0
    assert benchmark_hits(docs(spark, rows).limit(0), bench).count() == 0


def brute_removal(items, text, window=8, longest=8, coverage=0.5):
    """Words that stay, or None for a document that goes."""
    words = ascii_words(text)
    hit, _ = brute_hits(items, words, window)
    if sum(hit) > coverage * len(words):
        return None
    short, _ = brute_hits([i if len(i) < window else [] for i in items], words, window)
    out, k = [], 0
    for on, run in itertools.groupby(hit):
        n = len(list(run))
        if not on or (n < longest and not any(short[k : k + n])):
            out += words[k : k + n]
        k += n
    return out


@pytest.mark.parametrize("longest", [8, 11])
def test_blocks_of_items_give_the_same(spark, monkeypatch, longest):
    from quorial.llm import decontaminate as D

    rng = random.Random(3)
    items = [(i, prose(rng, 12)) for i in range(9)] + [(9, "short item"), (3, prose(rng, 9))]
    part = lambda: " ".join(rng.choice(items)[1].split()[: rng.choice([8, 9, 12])])
    # of two items that lie in different blocks neither alone covers half of the first document
    rows = [(100, " ".join(items[0][1].split()[:10] + prose(rng, 12).split() + items[1][1].split()[:10])), (101, None), (102, ""), (100, items[2][1])]
    rows += [(i, prose(rng, 20) + " " + part() + " " + prose(rng, rng.randint(0, 9)) + " " + part()) for i in range(40)]
    rows += [(500, "word " * 40_000 + items[4][1]), (0, rows[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, rows).withColumnRenamed("lang", "spans").withColumnRenamed("source", "digest")
    hits = lambda: sorted(map(tuple, benchmark_hits(df, bench).collect()))
    left = lambda: sorted([tuple(r) for r in decontaminate(df, bench, longest=longest).collect()], key=repr)
    one, kept = hits(), left()
    want = {(i, t): brute_removal([ascii_words(x) for _, x in items], t or "", longest=longest) for i, t in rows}
    assert sorted((i for i, _, *_ in kept), key=repr) == sorted((i for i, t in rows if want[i, t] is not None), key=repr)
    for i, words in {(r[0], tuple(ascii_words(r[1] or ""))) for r in kept}:
        assert any(i == k[0] and v is not None and tuple(v) == words for k, v in want.items())
    assert decontaminate(df, bench).columns == df.columns and all(ascii_words(t) for _, t in items)
    for size in (1000, 150):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        assert hits() == one and left() == kept
