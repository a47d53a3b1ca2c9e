"""Tool calls, secrets, licences and the archive."""

import hashlib
import json
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quorial.llm import archive as W
from quorial.llm import licenses as C
from quorial.llm import queries as Q
from quorial.llm import secrets as S
from quorial.llm import tool_calls as T

TOOLS = {"add": {"a": ("integer", True), "b": ("integer", True), "note": ("string", False)}}
CALL = "group long, id string, name string, arguments string, after string, at long"


def linked(spark, calls, results):
    out = T.link_tool_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, "group long, id string, content string, at long"), TOOLS)
    return {(r.group, r.id): r for r in out.collect()}


def test_links_order_and_schemas(spark):
    calls = [
        (1, "c", "add", '{"b": 2, "a":1}', "b", 5), (1, "b", "add", '{"a":"1","x":0}', "a", 3), (1, "a", "add", "not json", None, 1), (1, "d", "other", "{}", "gone", 7),
        (1, "a", "add", '{"a":9}', None, 2), (2, "a", "add", '{"a":1,"b":null}', "b", 1), (2, "b", "add", "[1]", "a", 2), (None, "a", "add", "{}", None, 1), (1, None, "add", "{}", None, 1),
    ]
    out = linked(spark, calls, [(1, "a", "ok", 2), (1, "b", None, 1), (9, "z", "?", 1), (1, "a", "again", 9)])
    assert {k: r.level for k, r in out.items()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 0, (2, "a"): None, (2, "b"): None, (9, "z"): None}
    assert {k: r.status for k, r in out.items()} == {(1, "a"): "linked", (1, "b"): "early", (1, "c"): "unanswered", (1, "d"): "unanswered", (2, "a"): "unanswered", (2, "b"): "unanswered", (9, "z"): "orphan"}
    broken = {k: r.broken for k, r in out.items()}
    assert broken == {(1, "a"): ["*"], (1, "b"): ["a", "b", "+x"], (1, "c"): [], (1, "d"): ["*"], (2, "a"): ["b"], (2, "b"): ["*"], (9, "z"): None}
    assert out[1, "c"].json == '{"arguments":{"a":1,"b":2},"id":"c","level":2,"name":"add","status":"unanswered"}'


KINDS = {"s": ("string", True), "i": ("integer", False), "n": ("number", False), "b": ("boolean", False), "l": ("array", False), "o": ("object", False), "z": ("null", True)}


def brute_links(calls, results, tools):
    """Every call and result by plain loops."""
    first_call, first_result, out = {}, {}, {}
    for g, i, name, arguments, after, at in calls:
        if g is not None and i is not None:
            first_call.setdefault((g, i), []).append((at, name, arguments, after))
    for g, i, content, at in results:
        if g is not None and i is not None:
            first_result.setdefault((g, i), []).append((at, content or "", content))
    chosen = {k: min(v, key=lambda x: x[:3]) for k, v in first_call.items()}
    right = {"string": lambda v: isinstance(v, str), "integer": lambda v: type(v) is int, "number": lambda v: type(v) in (int, float), "boolean": lambda v: isinstance(v, bool), "array": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict), "null": lambda v: v is None}
    for key in {*chosen, *first_result}:
        if key not in chosen:
            out[key] = (None, "orphan", None)
            continue
        at, name, arguments, after = chosen[key]
        level, seen, now = 0, {key}, after
        while now is not None and (key[0], now) in chosen:
            level, here = level + 1, (key[0], now)
            if here in seen:
                level = None
                break
            seen.add(here)
            now = chosen[here][3]
        back = min(first_result[key])[0] if key in first_result else None
        status = "unanswered" if back is None else "early" if back < at else "linked"
        try:
            value = json.loads(arguments)
        except ValueError:
            value = None
        broken = ["*"]
        if isinstance(value, dict) and name in tools:
            broken = []
            for field, (kind, required) in sorted(tools[name].items()):
                missing = field not in value or (value[field] is None and kind != "null")
                if required if missing else not right[kind](value[field]):
                    broken.append(field)
            broken += [f"+{k}" for k in sorted(set(value) - set(tools[name]))]
        out[key] = (level, status, broken)
    return out


def test_links_against_plain_loops(spark):
    rng = random.Random(8)
    values = ['"x"', "1", "1.5", "true", "null", "[1]", '{"a": 2}']
    tools = {"t": KINDS, "u": {"a": ("integer", True)}}
    calls, results = [], []
    for k in range(400):
        i = rng.choice([None, *map(str, range(14))])
        fields = ", ".join(f'"{f}": {rng.choice(values)}' for f in rng.sample([*KINDS, "extra"], rng.randint(0, 7)))
        arguments = rng.choice([f"{{{fields}}}"] * 5 + ["[1]", "no json", '{"a": 3}'])
        calls.append((rng.choice([None, *range(12)]), i, rng.choice(["t", "t", "u", "v"]), arguments, rng.choice([None, *map(str, range(16))]), k))
        results.append((rng.choice([None, *range(12)]), rng.choice([None, *map(str, range(16))]), rng.choice([None, "ok"]), rng.randint(0, 400)))
    calls.append((99, "long", "t", json.dumps({"s": "word " * 40_000, "z": None}), None, 1))
    out = T.link_tool_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, "group long, id string, content string, at long"), tools).collect()
    want = brute_links(calls, results, tools)
    assert {(r.group, r.id): (r.level, r.status, r.broken) for r in out} == want and len(out) == len(want)
    assert all(r.valid == (None if r.broken is None else not r.broken) for r in out)
    for r in out:
        record = json.loads(r.json)
        assert record["status"] == r.status and record["id"] == r.id and list(record) == sorted(record)


def test_levels_of_graphs_against_plain_loops(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(40):
        n = rng.randint(1, 14)
        ids = [str(i) for i in range(n)]
        after = {}
        for k, i in enumerate(ids):
            # mostly earlier calls; now and then any, which can close a circle, and unknown ones
            pool = ids[:k] if rng.random() < 0.95 else ids
            after[i] = rng.sample(pool, min(len(pool), rng.choice([0, 1, 1, 1, 2, 3]))) + rng.choice([[], [], ["gone"], [None]])
            rows.append((g, i, rng.choice([after[i], after[i] + after[i]])))
        known = {i: [x for x in set(a) if x in after] for i, a in after.items()}
        level: dict = {}
        for _ in ids:
            level |= {i: max([level[x] + 1 for x in a], default=0) for i, a in known.items() if i not in level and all(x in level for x in a)}
        want |= {(g, i): level.get(i) for i in ids}
    rows.append((99, "none", None))
    got = T.levels(spark.createDataFrame(rows, "group long, id string, after array<string>")).collect()
    assert {(r.group, r.id): r.level for r in got} == want | {(99, "none"): 0} and len(got) == len(want) + 1
    assert None in want.values() and max(v or 0 for v in want.values()) > 5


def test_calls_after_several_others(spark):
    calls = [(1, "a", "add", '{"a":1,"b":2}', [], 1), (1, "b", "add", "{}", ["a"], 2), (1, "c", "add", "{}", ["a", "b"], 3), (1, "d", "add", "{}", None, 4), (1, "e", "add", "{}", ["d", "c"], 5)]
    df = spark.createDataFrame(calls, CALL.replace("after string", "after array<string>"))
    results = spark.createDataFrame([(1, "c", "ok", 9)], "group long, id string, content string, at long")
    out = T.link_tool_calls(df, results, TOOLS)
    assert {r.id: (r.level, r.status) for r in out.collect()} == {"a": (0, "unanswered"), "b": (1, "unanswered"), "c": (2, "linked"), "d": (0, "unanswered"), "e": (3, "unanswered")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan


def test_conversations_equal_their_twin(spark, tmp_path):
    rng = random.Random(6)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None]
    texts = ["", None, 'a "b" \\ / c', "tab\tline\nend\r", "é 字 \U0001f600", "\x01\x1f", "x" * 50_000]
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(500)]
    path = str(tmp_path / "c.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = c.sql(Q.ORACLE_SQL["op4_tool_calls"])
    got = T.conversation_calls(spark.read.parquet(path)).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())) and len(got) > 100


def test_long_chains(spark):
    calls = [(1, str(i), "add", "{}", str(i - 1) if i else None, i) for i in range(70)]
    assert {int(k[1]): r.level for k, r in linked(spark, calls, []).items()} == {i: i for i in range(70)}
    assert linked(spark, [], []) == {}


def test_conversations(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", 'say "hi"\n'), (1, 2, "assistant", "hi"), (1, 3, "user", None), (2, 0, "assistant", "alone"), (None, 0, "user", "x"), (1, 1, "user", 'say "hi"\n')]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, status string")
    out = {(r.conv_id, r.call_id): r for r in T.conversation_calls(df).collect()}
    assert {k: (r.level, r.status, r.broken) for k, r in out.items()} == {
        (1, "call-0"): (0, "unanswered", ""), (1, "call-1"): (1, "linked", ""), (1, "call-3"): (2, "unanswered", "text"), (2, "call--1"): (None, "orphan", ""),
    } or out[2, "call--1"].broken is None
    assert json.loads(out[1, "call-1"].json)["arguments"] == {"text": 'say "hi"\n', "turn": 1}
    assert T.conversation_calls(df.limit(0)).count() == 0


KEY = "AKIA" + "Q7ZP2M4XK9W1RT5B"
SECRETS = [
    (1, f"the {KEY}, of"), (2, 'note token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'), (3, "and password=e1c093f22d3955eaac oué"), (4, "card 4279055890764913 paid"),
    (5, "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"), (6, None), (7, ""), (8, "only plain words antidisestablishmentarianism"), (1, f"the {KEY}, of"),
]


def brute_candidates(text):
    """(place, value, features) of every candidate, by plain loops and ``re``."""
    import re

    key = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-")
    named = re.compile(S.NAMED)
    share = lambda v, test: sum(map(test, v)) / max(len(v), 1)
    words, out = re.split(r"[ \t\n\x0b\f\r]+", text or ""), []
    for place, word in enumerate(words):
        # maximal runs of a key's characters, and those before them
        found, at = [], 0
        while at < len(word):
            if word[at] not in key:
                at += 1
                continue
            end = at
            while end < len(word) and word[end] in key:
                end += 1
            marks = 0
            while end + marks < len(word) and word[end + marks] == "=":
                marks += 1
            stop = end + marks if marks in (1, 2) and not (end + marks < len(word) and word[end + marks] in key) else end
            if end - at >= 12 or named.search(word[:at]):
                found.append((at, stop))
            at = stop
        for k, (a, b) in enumerate(found):
            value = word[a:b]
            left = found[k - 1][1] if k else 0
            lead, tail = word[left:a], word[b : found[k + 1][0] if k + 1 < len(found) else len(word)]
            if re.match(r"[\"'`]?[=:]", lead):
                lead = (word[slice(*found[k - 1])] if k else "") + lead
            if not (any(c.isdigit() for c in value) or named.search(lead)):
                continue
            own = re.search(S.OWN_LEAD, lead)
            own, mine = own[0] if own else lead, re.match(S.OWN_TAIL, tail)[0]
            before = " ".join(words[max(place - 2, 0) : place]) if k == 0 else ""
            after = f"{mine} {words[place + 1] if place + 1 < len(words) else ''}" if k == len(found) - 1 else mine
            login = bool(re.search(r"://[^/@:]*:$", own)) and mine.startswith("@")
            kind = ["a" if "a" <= c <= "z" else "B" if "A" <= c <= "Z" else "1" if c.isdigit() else c for c in value]
            beside = f"{before} {own}"
            covered, low, i = 0, value.lower(), 0
            parts = sorted(set(S.DICTIONARY), key=lambda w: (-len(w), w))
            while i < len(low):
                n = next((len(p) for p in parts if low.startswith(p, i)), 0)
                covered, i = covered + n, i + max(n, 1)
            flags = {
                "length": len(value), "digits": share(value, str.isdigit), "uppers": share(value, str.isupper), "lowers": share(value, str.islower), "marks": share(value, lambda c: not c.isalnum()),
                "shifts": sum(x != y for x, y in zip(kind, kind[1:])) / max(len(value) - 1, 1), "classes": any(c.isdigit() for c in value) + any(c.isupper() for c in value) + any(c.islower() for c in value),
                "hex": all(c in "0123456789abcdef" for c in value), "covered": covered / len(value), "issued": bool(re.search(S.ISSUED, value)),
                "assigned": bool(re.search(r"[=:][\"'`]?$", own) or re.search(r"[=:]\s*$", before)), "near": bool(re.search(S.NEAR, beside)) or login, "far": bool(re.search(S.FAR, f"{beside} {after}")),
                "in_path": bool(re.search(r"://|^[./~]|@|\\", own + value + mine) or own.endswith("/")) and not login, "path_code": 0, "all_digits": value.isdigit(),
                "luhn_like": bool(re.fullmatch(r"[3-6][0-9]{12,18}", value)),
            }
            out.append((place, value, {n: float(v) for n, v in flags.items()}))
    return out


def secret_texts(seed, count):
    rng = random.Random(seed)
    values = [KEY, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "hunter2", "abcdefabcdefabcdef", "4279055890764913", "dGVzdA12345678==", "x", "my-file_name/2024-01", "s3cr3t+pass/word=", "contentversion99"]
    marks = ['{"token":"%s"}', "password=%s", "?access_token=%s&user=1", "https://u:%s@host/db", "export A=%s;export B=%s", "api_key: %s", "(%s),", "commit %s", "%s", "id=%s,%s,%s", "le mot", "auth='%s'", "./%s", "plain words"]
    texts = []
    for _ in range(count):
        parts = [rng.choice(marks) for _ in range(rng.randint(0, 5))]
        texts.append(rng.choice([" ", "  ", "\n"]).join(p % tuple(rng.choice(values) for _ in range(p.count("%s"))) for p in parts))
    return texts


def test_candidates_against_plain_loops(spark):
    texts = [*secret_texts(5, 150), r"C:\\keys\\a1b2c3d4e5f6g7h8 end", "\\\\share\\0123456789abcdef"]
    assert sum(len(brute_candidates(t)) for t in texts) > 200
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id int, text string").withColumn("words", S.words_of(F.col("text")))
    got = {r.id: r.x for r in df.select("id", S.candidates("words", F.lit("")).alias("x")).collect()}
    assert not got[-1]
    for i, text in enumerate(texts):
        want = brute_candidates(text)
        assert [(x.place, x.c.value) for x in got[i]] == [w[:2] for w in want], text
        for x, (_, _, features) in zip(got[i], want, strict=True):
            assert {n: x.c[n] for n in S.FEATURES} == pytest.approx(features, abs=1e-9), (text, x.c.value)


def test_secrets(spark):
    df = spark.createDataFrame([(i, t, "p") for i, t in SECRETS], "doc_id long, text string, value string")
    out = S.secret_scan(df).collect()
    assert sorted(r.doc_id for r in out) == [1, 1, 2, 3, 4, 5] and {r.doc_id for r in out if r.is_secret} == {1, 2, 3}
    clean = {(r.doc_id, r.text) for r in S.redact(df).collect()}
    assert (1, "the [secret], of") in clean and (6, None) in clean and (7, "") in clean and (4, SECRETS[3][1]) in clean and len(clean) == 8
    both = df.withColumnRenamed("value", "Text").withColumn("c0", F.lit("x"))
    assert {(r.doc_id, r[1]) for r in S.redact(both).collect()} == clean and S.redact(both).columns == both.columns
    assert S.redact(df).columns == df.columns and S.secret_scan(df.limit(0)).count() == 0


def test_redaction_against_plain_loops(spark):
    import re

    texts = [*secret_texts(6, 120), "", None]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")
    secrets: dict = {}
    for r in S.secret_scan(df).where("is_secret").collect():
        secrets.setdefault(r.doc_id, set()).add(r.value)
    assert len(secrets) > 40
    named = re.compile(S.NAMED)
    for r in S.redact(df).collect():
        want = texts[r.doc_id]
        for value in sorted(secrets.get(r.doc_id, ()), key=lambda v: (-len(v), v)):
            if len(value) >= 12:
                want = want.replace(value, "[secret]")
                continue
            # only where it is assigned to a credential's name and ends
            parts, at = "", 0
            for m in re.finditer(re.escape(value) + r"(?![A-Za-z0-9+/_\-])", want):
                parts += want[at : m.start()] + ("[secret]" if named.search(want[: m.start()]) else m[0])
                at = m.end()
            want = parts + want[at:]
        assert r.text == want


def test_forest_expression_is_the_forest(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = S.labelled_findings(spark, 800).select(S.described(F.col("word"), F.col("before"), F.col("after"), F.col("path")).alias("c"), F.col("label").cast("double").alias("label"))
    rows = VectorAssembler(inputCols=S.FEATURES, outputCol="features").transform(rows.select("c", "c.*", "label"))
    model = RandomForestClassifier(numTrees=5, maxDepth=4, seed=3).fit(rows)
    score = S.forest([t.toDebugString for t in model.trees])
    both = model.transform(rows).select("prediction", "label", score(F.col("c")).alias("s"), vector_to_array("probability")[1].alias("p"))
    assert both.where("(s > 0.5) <> (prediction = 1) AND abs(p - 0.5) > 0.1").count() == 0
    assert both.where("(s > 0.5) = (label = 1)").count() > 0.97 * 800


def test_held_out_findings(spark):
    score = S.train(S.labelled_findings(spark, 3000, 1))
    test = S.labelled_findings(spark, 1000, 2).select(S.described(F.col("word"), F.col("before"), F.col("after"), F.col("path")).alias("c"), "label")
    assert test.where((score(F.col("c")) >= 0.5) == (F.col("label") == 1)).count() > 970


def license_rows():
    rng = random.Random(5)
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choices("work license the of software permission free version under any granted".split(), k=rng.randint(0, 14))) for _ in range(rng.randint(0, 5))]
        if i % 3 == 0:
            words = rng.choice(C.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "other"
            lines.insert(0, "\n".join([" ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])]) + "\n" if i % 2 else " ".join(words))
        rows.append((i, "\n".join(lines)))
    rows.append((600, " ".join([next(t[1] for t in C.TEMPLATES if t[0] == "ISC")] * 9)))
    return [*rows, (500, None), (501, ""), (502, "\n \n"), (0, rows[0][1])]


def test_licences_against_all_templates(spark):
    *rows, again = license_rows()
    twice = C.license_scan(spark.createDataFrame([*rows, again], "doc_id long, text string")).where("doc_id = 0").count()
    assert twice == 2 * C.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").count() > 0
    got = sorted(tuple(r) for r in C.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    c = duckdb.connect()
    c.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(c.execute(C.oracle()).fetchall())
    assert got == want and len(got) > 20 and (600, 0, "ISC") in {r[:3] for r in got}


HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TWO = " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THREE = "Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"


LICENSED = [
    (HEADER.format("General", "2"), {"GPL-2.0"}),
    (HEADER.format("General", "3"), {"GPL-3.0"}),
    (HEADER.format("Affero General", "3"), {"AGPL-3.0"}),
    (HEADER.format("Lesser General", "2.1"), {"LGPL-2.1"}),
    (HEADER.format("Lesser General", "3"), {"LGPL-3.0"}),
    (HEADER.format("General", "4"), set()),
    ("This work is licensed under the GNU Affero General Public License, version 3.", {"AGPL-3.0"}),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"CC-BY-SA-4.0"}),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", {"CC-BY-NC-ND-4.0"}),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", {"CC-BY-NC-4.0"}),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", {"CC-BY-3.0"}),
    ("Licensed under CC BY-NC 4.0.", {"CC-BY-NC-4.0"}),
    ("Licensed under CC BY-SA 4.0.", {"CC-BY-SA-4.0"}),
    ("Licensed under the Apache License, Version 1.1.", {"Apache-1.1"}),
    (BSD, {"BSD"}),
    (BSD + BSD_TWO, {"BSD-2-Clause"}),
    (f"{BSD}{BSD_TWO} 3. {BSD_THREE}", {"BSD-3-Clause"}),
    (BSD_THREE, {"BSD-3-Clause"}),
    (f"{FEE}.", {"0BSD"}),
    (f"{FEE}, provided that the above copyright notice and this permission notice appear in all copies.", {"ISC"}),
    (f"first words then {FEE}, provided that the above copyright notice and this permission notice appear in all copies. and many more words " * 3, {"ISC"}),
    ('This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.', {"MPL-2.0"}),
    ("This is free and unencumbered software released into the public domain.", {"Unlicense"}),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", {"CC0-1.0"}),
    ("Copyright 2019 Somebody. Released under the MIT License", {"MIT"}),
]


def test_names_of_families(spark):
    rows = [(i, text) for i, (text, _) in enumerate(LICENSED)]
    got = {i: set() for i, _ in rows}
    for r in C.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].add(r.license)
    assert {text: got[i] for i, (text, names) in enumerate(LICENSED) if got[i] != names} == {}


def test_archive(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (2, None, big), (4, "http://c", "small"), (5, "http://d", "small"), (6, "http://e", None), (7, "http://f", "é" * 60), (1, "http://b\r\nX: y", big), (None, "n", big)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, header string")
    root = f"file://{tmp_path}/w"
    out = sorted((tuple(r) for r in W.archive_round_trip(df, root).collect()), key=repr)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = html == big and i != 1
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert out == sorted(want, key=repr)
    back = {r.page_id: r for r in W.read_archive(spark, root).collect()}
    head, _, body = bytes(back[7].record).partition(b"\r\n\r\n")
    assert body.decode() == "é" * 60 + "\r\n\r\n" and b"Content-Length: 120" in head and head.startswith(b"WARC/1.1\r\n")
    head, _, body = bytes(back[3].record).partition(b"\r\n\r\n")
    assert body == b"\r\n\r\n" and b"Content-Length: 0" in head and bytes(back[3].payload).decode() == big
    assert spark.read.parquet(f"{root}/payloads").count() == 4
    assert W.archive_round_trip(df.limit(0)).count() == 0
    bad = spark.read.parquet(f"{root}/payloads").withColumn("payload", F.lit(b"other"))
    bad.write.parquet(f"{root}2/payloads")
    spark.read.parquet(f"{root}/headers").write.parquet(f"{root}2/headers")
    with pytest.raises(Exception, match="damaged payload"):
        W.read_archive(spark, f"{root}2").select("payload_digest").collect()


def test_archive_twin_with_copies(spark):
    """The registered twin on pages of which many have equal payloads."""
    from quorial.llm.queries import ORACLE_SQL

    rng = random.Random(3)
    bodies = [None, "", "x" * 99, "x" * 100, *["<p>" + "".join(rng.choices("abé\r\n", k=rng.choice([50, 120, 5000]))) for _ in range(12)], "big " * 300_000]
    rows = [(i, f"http://{i}", rng.choice(bodies)) for i in rng.sample(range(10**9), 150)]
    out = W.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    c = duckdb.connect()
    c.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = c.execute(ORACLE_SQL["op10_warc"]).fetchall()
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr) and sum(r.record_type == "revisit" for r in out) > 40


def test_archive_ids_cannot_forge_headers(spark):
    ids = ["a\r\nWARC-Type: revisit\r\nX: <y>", "b%0A>", "plain"]
    df = spark.createDataFrame([(i, None, "body " * 40) for i in ids], "page_id string, url string, html string")
    out = {r.page_id: (r.record_type, r.refers_to) for r in W.archive_round_trip(df).collect()}
    first = min(ids)
    assert out == {i: ("response", None) if i == first else ("revisit", first) for i in ids}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghilmnoprstu", k=5))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for i in range(120):
        bad = i % 3 == 0
        docs.append((i, text(30) + (" vile grumbok" if bad else "")))
        labels.append((i, 1, int(bad)))
    item = text(12)
    docs += [(200, docs[1][1]), (201, text(40) + " " + item), (202, item), (203, f"see {KEY} now"), (204, "gr0mbok gruuumbok vile")]
    d = f"file://{tmp_path}"
    full = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    full.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = full
    for name, stage in P.STAGES:
        after = stage(spark, now, d)
        if name != "tokens":
            assert after.columns == full.columns
        now = after.cache()
        if name == "secrets":
            kept = {r.doc_id: r.text for r in now.collect()}
            assert all(r.n_chars == len(r.text) for r in now.collect())
    want = {i for i, t in docs if "vile" not in t} - {200, 202}
    assert set(kept) == want and kept[203] == "see [secret] now" and item not in kept[201]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {}
    for i, t in kept.items():
        ids = library.encode(t, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        tokens[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    for out in (now, P.run(spark, d)):
        assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()} == tokens and set(tokens) == want
    empty = full.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, d)
        assert empty.count() == 0
