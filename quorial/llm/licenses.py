"""Licence scans with DataFrame functions only.

Lines, paragraphs and windows of words are compared with licence templates by the Dice
coefficient of their sets of word bigrams.  Bounds on the sizes, and words that a match can't do
without, prune what is compared.
"""

from __future__ import annotations

import functools
import json
import math
import operator
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
#: Fixed: the parts of the names of Creative Commons licences.
_CC = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
_CC_KINDS = ["BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND"]

#: Fixed: licence names and texts to compare with, some with words that a match needs or
#: must not have besides those of ``words_that_decide``.  ``BSD`` is what its variants share.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    *[(f"{short}-{v}", f"This work is licensed under the GNU {long}General Public License, version {v.removesuffix('.0')}.") for short, long, v in (("GPL", "", "2.0"), ("GPL", "", "3.0"), ("LGPL", "Lesser ", "2.1"), ("LGPL", "Lesser ", "3.0"), ("AGPL", "Affero ", "3.0"))],
    *[(f"{short}-{v}", _GNU.format(long, v.removesuffix(".0"))) for short, long, v in (("GPL", "", "2.0"), ("GPL", "", "3.0"), ("LGPL", "Lesser ", "2.1"), ("LGPL", "Lesser ", "3.0"), ("AGPL", "Affero ", "3.0"))],
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    *[(f"CC-{kind}-{v}", f"Licensed under CC {kind} {v}.") for kind in _CC_KINDS for v in ("3.0", "4.0")],
    *[(f"CC-{kind}-{v}", f"This work is licensed under a Creative Commons {'-'.join(_CC[x] for x in kind.split('-'))} {v} {where} License.") for kind in _CC_KINDS for v, where in (("3.0", "Unported"), ("4.0", "International"))],
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.", ["provided"], []),
    ("0BSD", f"{_GRANT}.", ["granted"], ["provided"]),
    ("BSD", _BSD),
    ("BSD-2-Clause", f"{_BSD} 1. {_BSD_1} 2. {_BSD_2}"),
    ("BSD-3-Clause", f"{_BSD} 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_3}"),
    ("BSD-3-Clause", _BSD_3),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Fixed: words that tell licences of one family apart.
APART = ["affero", "lesser", "noncommercial", "sharealike", "noderivatives", "nc", "sa", "nd", "neither"]
#: Fixed: words that any text has.
COMMON = "the of and to in a is was for on that with it as be by are from or an at this not under you may".split()
#: Least Dice coefficient of a match.
LEAST = 0.75


def normal_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))) if len(words) > 1 else words


def words_that_decide(template: tuple) -> tuple[list[str], list[str]]:
    """Words that a match must have, whatever its likeness (a template's numbers and those
    of ``APART``, less numbers of one-digit lists), and those that it must not have."""
    _, text, needs, bars = (*template, [], [])[:4] if len(template) == 2 else template
    own = set(normal_words(text))
    version = set(re.findall(r"(?i)(?:version|v|%s)[ .]+(\d+)" % "|".join([*_CC, *_CC.values(), "Unported"]), text))
    return sorted(version | own & set(APART) | set(needs)), sorted(set(APART) - own | set(bars))


_TEMPLATE = "license:string, grams:array<string>, words:array<string>, needs:array<string>, bars:array<string>, n:int, fewest:int, least:int"


def prepared(templates: list[tuple], least: float) -> F.Column:
    """The templates as one constant array of structs, so that what is done with each is
    written once: its bigrams, words, deciding words and number of words, and how many
    of its words and bigrams a match has at least."""
    out, span = [], least / (2 - least)
    for t in templates:
        words = normal_words(t[1])
        grams = bigrams(words)
        if grams:
            own = Counter(w for g in grams for w in set(g.split()))
            needs, bars = words_that_decide(t)
            out.append({"license": t[0], "grams": grams, "words": sorted(own), "needs": needs, "bars": bars, "n": len(words), "fewest": fewest_words(own, len(grams), span), "least": math.ceil(span * len(grams) - 1e-9)})
    return F.from_json(F.lit(json.dumps(out)), f"array<struct<{_TEMPLATE}>>")


def allowed(words: F.Column, t: F.Column) -> F.Column:
    """Whether words have all that a template needs, and none that it bars."""
    return (F.size(F.array_intersect(words, t["needs"])) == F.size(t["needs"])) & ~F.arrays_overlap(words, t["bars"])


def needed_words(templates: list[tuple[str, str]], least: float) -> list[str]:
    """Words of which a unit that matches any template has at least one.

    A match shares at least ``least / (2 - least)`` of a template's bigrams.  So words
    that cover more of its bigrams than a match can lack can't all be missing.  Of each
    template the longest words go first, and the most common words last.
    """
    out: set[str] = set()
    for text in (t[1] for t in templates):
        grams = bigrams(normal_words(text))
        lack = len(grams) - math.ceil(least / (2 - least) * len(grams) - 1e-9)
        covered = {g for g in grams if set(g.split()) & out}
        words = sorted({w for g in grams for w in g.split()}, key=lambda w: (w in COMMON, -len(w), w))
        for w in words:
            if len(covered) > lack:
                break
            if w not in out:
                out.add(w)
                covered |= {g for g in grams if w in g.split()}
    return sorted(out)


def units_of(text: F.Column) -> F.Column:
    """Lines, then the paragraphs of more than one line."""
    return F.concat(F.split(text, "\n"), F.filter(F.split(text, "\n[ \t]*\n"), lambda p: p.contains("\n")))


def words_of(text: F.Column) -> F.Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def pairs_of(words: F.Column) -> F.Column:
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))


def likest(grams: F.Column, words: F.Column, known: F.Column, least: float) -> F.Column:
    """A struct of the best Dice coefficient, negative, and its licence, of the templates
    whose size and deciding words allow it."""
    n, span = F.size(grams), least / (2 - least)

    def score(t: F.Column) -> F.Column:
        own = F.size(t["grams"])
        fits = (n >= own * span - 1e-9) & (n <= own / span + 1e-9)
        dice = F.when(fits & allowed(words, t), 2.0 * F.size(F.array_intersect(grams, t["grams"])) / (n + own)).otherwise(0.0)
        # the likest, then the first name
        return F.struct((-F.round(dice, 6)).alias("less"), t["license"].alias("license"))

    return F.array_min(F.transform(known, score))


def fewest_words(own: Counter, size: int, span: float) -> int:
    """How many of a template's words a match has at least.  ``own`` has the number of
    bigrams each is in; a bigram is lost through at most two missing words."""
    lack, lost, missing = size - math.ceil(span * size - 1e-9), 0, 0
    for n in sorted(own.values()):
        lost += n
        if lost > 2 * lack:
            break
        missing += 1
    return len(own) - missing


#: A word in the place of a line or paragraph that matches as a whole.
_TAKEN = "unitthatmatchesasawhole"


def license_windows(rows: DataFrame, templates: list[tuple], known: F.Column, least: float, any_needed: Callable[[F.Column], F.Column]) -> DataFrame:
    """``doc_id, unit, license, dice`` for windows of as many words as a template has,
    wherever they begin, outside the lines and paragraphs that match as a whole.

    A window may begin at a bigram of the template's, as one that begins elsewhere is
    no likelier than the next.  Of windows that overlap the likest counts, of equal ones
    the longest.
    """
    once = lambda c: F.explode(F.array(c))  # noqa: E731; else filters make it anew for each use
    docs = rows.where(any_needed(F.col("text"))).select("doc_id", "text", once(words_of(F.col("text"))).alias("words"))
    # texts that lack too many words, and then bigrams, of each template have no such window
    docs = docs.select("doc_id", "text", "words", once(F.array_intersect("words", F.array_distinct(F.flatten(F.transform(known, lambda t: t["words"]))))).alias("own"))
    docs = docs.where(F.exists(known, lambda t: F.size(F.array_intersect("own", t["words"])) >= t["fewest"]))
    parts = F.concat(pairs_of(F.col("words")), "words")
    docs = docs.select("doc_id", "text", once(F.array_intersect(parts, F.array_distinct(F.flatten(F.transform(known, lambda t: t["grams"]))))).alias("own"))
    docs = docs.where(F.exists(known, lambda t: F.size(F.array_intersect("own", t["grams"])) >= t["least"]))

    def taken(unit: F.Column) -> F.Column:
        # one-element arrays, so that what several expressions use is made once
        made = F.transform(F.array(words_of(unit)), lambda w: F.struct(w.alias("words"), F.array_distinct(F.when(F.size(w) > 1, pairs_of(w)).otherwise(w)).alias("grams")))
        best = F.transform(made, lambda x: likest(x["grams"], x["words"], known, least))
        return any_needed(unit) & (F.get(best, F.lit(0))["less"] <= -least)

    lines = lambda p: F.array_join(F.transform(F.split(p, "\n"), lambda x: F.when(taken(x), F.lit(_TAKEN)).otherwise(x)), "\n")
    rest = F.array_join(F.transform(F.split("text", "\n[ \t]*\n"), lambda p: F.when(p.contains("\n") & taken(p), F.lit(_TAKEN)).otherwise(lines(p))), "\n\n")
    docs = docs.select("doc_id", F.size(units_of(F.col("text"))).alias("before"), once(words_of(rest)).alias("words")).select("*", once(pairs_of(F.col("words"))).alias("pairs"))
    # where any template's bigram, or only word, is: found once for all templates
    hits = lambda parts, grams: F.array_compact(F.transform(parts, lambda g, i: F.when(g.isin(grams), F.struct(g.alias("gram"), i.alias("at")))))
    made = [bigrams(normal_words(t[1])) for t in templates]
    docs = docs.select("*", once(hits("pairs", sorted({g for x in made for g in x if " " in g}))).alias("hits"), once(hits("words", sorted({g for x in made for g in x if " " not in g}) or [""])).alias("alone"))

    def windows(t: F.Column) -> F.Column:
        def scored(i: F.Column) -> F.Column:
            window = F.transform(F.array(F.array_distinct(F.when(t["n"] > 1, F.slice("pairs", i + 1, F.greatest(t["n"] - 1, F.lit(1)))).otherwise(F.slice("words", i + 1, F.lit(1))))), lambda w: F.round(2.0 * F.size(F.array_intersect(w, t["grams"])) / (F.size(w) + F.size(t["grams"])), 6))
            return F.struct((-F.get(window, F.lit(0))).alias("less"), (-t["n"]).alias("shorter"), t["license"].alias("license"), i.alias("start"), (i + t["n"]).alias("end"))

        own = F.filter(F.when(t["n"] > 1, F.col("hits")).otherwise(F.col("alone")), lambda h: F.array_contains(t["grams"], h["gram"]))
        found = F.transform(own, lambda h: scored(h["at"]))
        return F.filter(found, lambda x: (x["less"] <= -least) & allowed(F.slice("words", x["start"] + 1, t["n"]), t))

    docs = docs.select("doc_id", "before", once(F.array_sort(F.flatten(F.transform(known, windows)))).alias("found")).where(F.size("found") > 0)
    none = F.slice("found", F.lit(1), F.lit(0))
    apart = lambda kept, x: ~F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
    best = F.aggregate("found", none, lambda kept, x: F.when(apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    docs = docs.select("doc_id", "before", F.explode(best).alias("x"))
    return docs.select("doc_id", (F.col("before") + F.col("x.start")).alias("unit"), F.col("x.license").alias("license"), (-F.col("x.less")).alias("dice"))


def license_scan(docs: DataFrame, templates: list[tuple] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, unit, license, dice`` for each line or paragraph that matches, and for
    each window of words elsewhere that does.

    ``unit`` counts the lines of a text from 0, then its paragraphs of more than one
    line, and then the words where windows can begin, with one word in place of each
    line or paragraph that matches.  Words are runs of letters and digits in lower case; a unit of one word
    has it in place of bigrams.  A match has the version and the other words that tell a
    template from others of its family (``words_that_decide``), and none of theirs.  A
    template is a name, a text and, if wanted, more needed and barred words.  Of several templates the likest counts, of equal ones
    the first name.  Null and empty texts have no match; repeated rows match each by
    itself; an empty table gives an empty result.
    """
    templates = TEMPLATES if templates is None else templates
    rows = pick(docs, doc_id=id_col, text=text_col)
    known = prepared(templates, least)
    words_needed = needed_words(templates, least)
    needed = F.array(*[F.lit(w) for w in words_needed])

    def any_needed(text: F.Column) -> F.Column:
        # texts without any of these have no unit with one, and aren't taken apart; short
        # words are looked for as words, others anywhere, so a part stands for the whole
        long = [w for w in words_needed if len(w) > 3]
        long = [w for w in long if not any(x in w and x != w for x in long)]
        short = "|".join(w for w in words_needed if len(w) <= 3)
        tests = lambda t: [t.contains(w) for w in long] + ([t.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{short})(?![\p{{L}}\p{{N}}])")] if short else [])
        return F.get(F.transform(F.array(F.lower(text)), lambda t: functools.reduce(operator.or_, tests(t))), F.lit(0))

    span = least / (2 - least)
    sizes = [len(bigrams(normal_words(t[1]))) for t in templates]
    # before bigrams are made: words of a unit bound its bigrams from above
    fewest = math.ceil(min(sizes) * span)
    units = rows.where(any_needed(F.col("text"))).select("doc_id", F.posexplode(units_of(F.col("text"))).alias("unit", "line"))
    # exploded one-element arrays, so that neither filters nor lambdas make them anew
    once = lambda c: F.explode(F.array(c))
    units = units.select("doc_id", "unit", once(words_of(F.col("line"))).alias("words")).where((F.size("words") > fewest) & F.arrays_overlap("words", needed))
    units = units.select("doc_id", "unit", "words", once(F.array_distinct(F.when(F.size("words") > 1, pairs_of(F.col("words"))).otherwise(F.col("words")))).alias("grams"))
    units = units.select("doc_id", "unit", likest(F.col("grams"), F.col("words"), known, least).alias("best"))
    units = units.select("doc_id", "unit", F.col("best.license").alias("license"), (-F.col("best.less")).alias("dice")).where(F.col("dice") >= least)
    return units.unionByName(license_windows(rows, templates, known, least, any_needed))


def oracle(templates: list[tuple] | None = None, least: float = LEAST) -> str:
    """Lines and paragraphs in DuckDB's SQL, without the pruning.  Windows of words
    inside other lines are beyond it, and are tested on fixtures."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda xs: f"[{', '.join(map(quote, xs))}]::VARCHAR[]"
    values = ", ".join(f"({quote(t[0])}, {listed(bigrams(normal_words(t[1])))}, {', '.join(map(listed, words_that_decide(t)))})" for t in (templates or TEMPLATES))
    return f"""
        WITH t(license, grams, needs, bars) AS (VALUES {values}),
        u AS (SELECT doc_id, list_concat(string_split(text, chr(10)), list_filter(string_split_regex(text, '\\n[ \\t]*\\n'), lambda p: contains(p, chr(10)))) AS units FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, unnest(range(len(units))) AS unit, unnest(units) AS line FROM u),
        w AS (SELECT doc_id, unit, list_filter(string_split(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM l),
        g AS (SELECT doc_id, unit, words, CASE WHEN len(words) > 1 THEN list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) ELSE words END AS grams FROM w),
        s AS (SELECT doc_id, unit, license, round(2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)), 6) AS dice FROM g, t WHERE len(g.grams) > 0 AND list_has_all(words, needs) AND NOT list_has_any(words, bars)),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) AS rank FROM s)
        SELECT doc_id, CAST(unit AS INTEGER) AS unit, license, dice FROM r WHERE rank = 1 AND dice >= {least}"""
