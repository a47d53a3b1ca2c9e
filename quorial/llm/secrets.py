"""Secret scans with DataFrame functions only.

Strings that could be credentials are found by pattern; a random forest over their
length, character transitions, dictionary coverage, path and neighbouring words,
trained from labelled findings, removes false positives.  The forest is applied as
one SQL expression, so scanning and redaction need neither join nor shuffle.
"""

from __future__ import annotations

import json
import random
import re
import string

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, pick, position

#: Fixed: a candidate, anywhere in a word; marks of equality before more of a value assign it.
#: Behind the name of a credential it may be of any length.
_NAME = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth(?:orization)?|bearer|credential|private[_\-]?key|client[_\-]?secret)[\"'`]?[=:][\"'`]?"
VALUE = rf"(?:[A-Za-z0-9+/_\-]{{12,}}|(?<=(?i:{_NAME}))[A-Za-z0-9+/_\-]+)(?:={{1,2}}(?![A-Za-z0-9+/_\-=]))?"
NAMED = rf"(?i){_NAME}$"
#: Fixed: what lies between a value and the nearest assignment, and the end of what belongs to it.
OWN_LEAD, OWN_TAIL = r"[^,;&?]*[=:][^,;&?]*$", r"^[^,;&]*"
#: Fixed: texts without this have no candidate.
ANY = rf"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{{12}}|(?i:{_NAME})[A-Za-z0-9+/_\-]"
#: Fixed: words beside a credential, and words beside other long strings.
NEAR = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth(orization)?|bearer|credential|private[_\-]?key|client[_\-]?secret)"
FAR = r"(?i)(commit|sha\d*|md5|checksum|digest|hash|rev(ision)?|version|build|uuid|guid|isbn|order|invoice|phone|card|account|serial|tracking|http|www|file|path|img|id)"
#: Fixed: prefixes that issuers give their keys.
ISSUED = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abprs]-|sk-|pk_|rk_|AIza|eyJ|glpat-|npm_|SG\.)"
#: Fixed: common parts of words and names.
DICTIONARY = """
the and for that with this from have are not you was all can has but one out use new get set test user name data file path list item type code text
page link home main base view model index order table value image style class group event state error start stop begin end time date year month
version release build config default example sample demo local public static content message string number object
tion ment ing ung ung keit lich schaft heit aire elle eau eux ment cion mente ado
""".split()

FEATURES = ["length", "digits", "uppers", "lowers", "marks", "shifts", "classes", "hex", "covered", "issued", "assigned", "near", "far", "in_path", "path_code", "all_digits", "luhn_like"]


def _share(value: F.Column, pattern: str) -> F.Column:
    return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))) / F.greatest(F.length(value), F.lit(1))


def values_of(word: F.Column) -> F.Column:
    """All candidates of a word in their order, each with what is before and behind it
    up to the next one, as structs of value, lead and tail."""
    found = F.regexp_extract_all(word, F.lit(VALUE), F.lit(0))
    # one more than there are values
    gaps = F.split(word, VALUE, -1)
    # a long name in front of a value is a candidate itself, and the value's lead
    lead = lambda i: F.when(F.get(gaps, i).rlike(r"^[\"'`]?[=:]"), F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(gaps, i))).otherwise(F.get(gaps, i))
    return F.transform(found, lambda v, i: F.struct(v.alias("value"), lead(i).alias("lead"), F.get(gaps, i + 1).alias("tail"), (i == 0).alias("first"), (i == F.size(found) - 1).alias("last")))


def described(word: F.Column, before: F.Column, after: F.Column, path: F.Column) -> F.Column:
    """A struct with the last candidate of a word and its features."""
    last = F.element_at(F.concat(F.array(F.struct(F.lit("").alias("value"), F.lit("").alias("lead"), F.lit("").alias("tail"), F.lit(True).alias("first"), F.lit(True).alias("last"))), values_of(word)), -1)
    return described_value(last, before, after, path)


def described_value(part: F.Column, before: F.Column, after: F.Column, path: F.Column) -> F.Column:
    """A struct with one of ``values_of`` a word and its features.  Words beside count
    for the values next to them, and of the word itself what belongs to the value."""
    value = part["value"]
    own = F.regexp_extract(part["lead"], OWN_LEAD, 0)
    lead = F.when(own != "", own).otherwise(part["lead"])
    tail = F.regexp_extract(part["tail"], OWN_TAIL, 0)
    before = F.when(part["first"], before).otherwise("")
    after = F.when(part["last"], F.concat_ws(" ", tail, after)).otherwise(tail)
    # name:password@host
    login = lead.rlike(r"://[^/@:]*:$") & tail.startswith("@")
    # places where the kind of character changes, as a share of all
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1")
    shifts = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1
    beside = F.concat_ws(" ", before, lead)
    words = "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w)))
    flag = lambda c: c.cast("double")
    out = {
        "length": F.length(value),
        "digits": _share(value, "[0-9]"),
        "uppers": _share(value, "[A-Z]"),
        "lowers": _share(value, "[a-z]"),
        "marks": _share(value, "[^A-Za-z0-9]"),
        "shifts": shifts / F.greatest(F.length(value) - 1, F.lit(1)),
        "classes": flag(value.rlike("[0-9]")) + flag(value.rlike("[A-Z]")) + flag(value.rlike("[a-z]")),
        "hex": flag(value.rlike("^[0-9a-f]+$")),
        "covered": _share(F.lower(value), words),
        "issued": flag(value.rlike(ISSUED)),
        "assigned": flag(lead.rlike(r"[=:][\"'`]?$") | before.rlike(r"[=:]\s*$")),
        "near": flag(beside.rlike(NEAR) | login),
        "far": flag(F.concat_ws(" ", beside, after).rlike(FAR)),
        "in_path": flag((F.concat(lead, value, tail).rlike(r"://|^[./~]|@|\\") | lead.endswith("/")) & ~login),
        "path_code": flag(F.coalesce(path, F.lit("")).rlike(r"(?i)\.(py|js|ts|java|go|rb|env|ya?ml|json|ini|cfg|sh|tf)$")),
        "all_digits": flag(value.rlike("^[0-9]+$")),
        "luhn_like": flag(value.rlike("^[3-6][0-9]{12,18}$")),
    }
    return F.struct(value.alias("value"), *[F.coalesce(out[n].cast("double"), F.lit(0.0)).alias(n) for n in FEATURES])


def candidates(words: str, path: F.Column) -> F.Column:
    """Array of (place, value and features) of a text's words: every part of one that
    has at least 12 characters of a key and a digit, or is assigned to a credential's name.  ``words`` names a column, so that
    the split isn't done again for each word."""
    places = F.transform(words, lambda w, i: F.when(w.rlike(VALUE), i))
    word = lambda i: F.coalesce(F.get(words, i), F.lit(""))
    parts = lambda i: F.filter(values_of(word(i)), lambda v: v["value"].rlike("[0-9]") | v["lead"].rlike(NAMED))
    one = lambda i, v: F.struct(i.alias("place"), described_value(v, F.concat_ws(" ", word(i - 2), word(i - 1)), word(i + 1), path).alias("c"))
    return F.flatten(F.transform(F.array_compact(places), lambda i: F.transform(parts(i), lambda v: one(i, v))))


def words_of(text: F.Column) -> F.Column:
    """Words between white space; none for texts without a candidate."""
    return F.when(text.rlike(ANY), F.split(text, r"\s+")).otherwise(F.array().cast("array<string>"))


def labelled_findings(spark: SparkSession, count: int = 6_000, seed: int = 11) -> DataFrame:
    """Labelled findings to train from: word, before, after, path, label.

    ``count`` rows made by rule: keys in the formats of issuers and assignments of
    random strings are secrets; card and phone numbers, checksums, identifiers,
    addresses, paths and long words are not.  Besides them an eighth as many short
    assignments: of passwords, and of words and numbers that stand for none.
    """
    rng = random.Random(seed)
    hexes = lambda lo, hi: "".join(rng.choices("0123456789abcdef", k=rng.randint(lo, hi)))
    upper = lambda n: "".join(rng.choices(string.ascii_uppercase + string.digits, k=n))
    mixed = lambda lo, hi: "".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(lo, hi)))
    digits = lambda n: "".join(rng.choices(string.digits, k=n))
    plain = lambda: rng.choice(["the", "of then", "und die", "pour le", "que la", "notes", "then sent", "erst an", "thion. The", "en.", "ou, de"])
    key = lambda: rng.choice(["password", "passwd", "secret", "token", "api_key", "client_secret", "auth_token", "access_key"])
    kinds = [
        (1, lambda: (f"AKIA{upper(16)}", plain())),
        (1, lambda: (f"{key()}={hexes(14, 40)}", plain())),
        (1, lambda: (f'"{hexes(32, 40)}"', f"{plain()} {key()} =")),
        (1, lambda: (rng.choice(["ghp_", "sk-", "xoxb-", "glpat-", "npm_"]) + mixed(24, 36), plain())),
        (1, lambda: (f'{key()}:"{mixed(16, 40)}"', plain())),
        (1, lambda: (mixed(20, 40), f"{key()}:")),
        (0, lambda: (f"4{digits(15)}", plain())),
        (0, lambda: (rng.choice(["4", "5", "37", "6"]) + digits(rng.randint(13, 15)), rng.choice(["card", "account no", "order", plain()]))),
        (0, lambda: (hexes(40, 40), rng.choice(["commit", "rev", "sha1", "checksum"]))),
        (0, lambda: (hexes(32, 64), rng.choice(["md5", "sha256", "digest", "file hash", "hash"]))),
        (0, lambda: ("-".join(hexes(n, n) for n in (8, 4, 4, 4, 12)), rng.choice(["uuid", "request id", "id", plain()]))),
        (0, lambda: (f"https://www.example.com/page/list-{digits(6)}", plain())),
        (0, lambda: ("_".join([rng.choice(["content", "version", "release", "default"]), rng.choice(["message", "object", "number"]), digits(2)]), plain())),
        (0, lambda: (f"/home/user/data/file_{digits(4)}", plain())),
        (0, lambda: (f"{rng.choice(['2019', '2021', '2024'])}-{digits(4)}_{digits(6)}", rng.choice(["build", "version", "date", "invoice"]))),
        (0, lambda: (f"+{digits(13)}", rng.choice(["phone", "tel", "call", plain()]))),
    ]
    rows = []
    for i in range(count):
        label, make = kinds[i % len(kinds)]
        word, before = make()
        word += rng.choice(["", "", "", ",", ".", "%%%", "***"])
        rows.append({"word": word, "before": before, "after": plain(), "path": rng.choice(["", "notes.txt", "a.py", "conf.yml"]), "label": label})
    empty = ["None", "null", "true", "false", "required", "optional", "str", "undefined", "hidden", "enabled", "disabled", "your_password", "changeme", "0", "1", "30", "3600"]
    short = lambda: rng.choice([mixed(6, 11), "".join(rng.choices(string.ascii_lowercase, k=rng.randint(4, 8))) + digits(rng.randint(1, 4)), "-".join(mixed(3, 4) for _ in range(3))])
    for i in range(count // 8):
        value = short() if i % 2 else rng.choice([rng.choice(DICTIONARY), rng.choice(empty), "_".join(rng.choices(DICTIONARY, k=2))])
        mark = rng.choice(["", "", '"', "'"])
        rows.append({"word": f"{key()}{rng.choice('=:')}{mark}{value}{mark}", "before": plain(), "after": plain(), "path": rng.choice(["", "notes.txt", "a.py", "conf.yml"]), "label": i % 2})
    kind = "array<struct<word:string,before:string,after:string,path:string,label:int>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def train(findings: DataFrame, trees: int = 20, depth: int = 5, seed: int = 7):
    """Trains the forest and returns a function from a struct of features to the
    probability that a finding is a secret, as a column expression."""
    rows = findings.select(described(F.col("word"), F.col("before"), F.col("after"), F.col("path")).alias("c"), F.col("label").cast("double").alias("label"))
    rows = rows.where("label IS NOT NULL AND c.value <> ''").select("c.*", "label")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5).fit(rows)
    return forest([t.toDebugString for t in model.trees])


def forest(trees: list[str]):
    """Trees as nested conditions.  A leaf predicts a class; the share of trees that
    predict 1 is the probability."""
    parsed = [_tree(t) for t in trees]

    def vote(node, c: F.Column) -> F.Column:
        if not isinstance(node, tuple):
            return F.lit(node)
        feature, cut, low, high = node
        return F.when(c[FEATURES[feature]] <= cut, vote(low, c)).otherwise(vote(high, c))

    def score(c: F.Column) -> F.Column:
        total = F.lit(0.0)
        for t in parsed:
            total = total + vote(t, c)
        return total / len(parsed)

    return score


def _tree(text: str):
    """Reads one tree as it is printed: If (feature i <= x) ... Else ... Predict: y."""
    lines = [x.strip() for x in text.splitlines() if "If (" in x or "Else (" in x or "Predict" in x]

    def read(k: int):
        if m := re.match(r"Predict: ([\d.]+)", lines[k]):
            return float(m[1]), k + 1
        m = re.match(r"If \(feature (\d+) <= (-?[\d.E\-]+)\)", lines[k])
        low, k2 = read(k + 1)
        high, k3 = read(k2 + 1)  # over the line with Else
        return (int(m[1]), float(m[2]), low, high), k3

    return read(0)[0]


def secret_scan(docs: DataFrame, findings: DataFrame | None = None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """``doc_id, word_no, value, score, is_secret`` for every candidate.

    ``findings`` (word, before, after, path, label) defaults to ``labelled_findings``,
    which is bounded.  ``path_col`` may name a column with a file path.  Null and empty
    texts have no candidates; repeated rows have theirs each; an empty table gives an
    empty result.
    """
    score = train(findings if findings is not None else labelled_findings(docs.sparkSession))
    rows = pick(docs, doc_id=id_col, text=text_col, **({"path": path_col} if path_col else {}))
    path = F.col("path") if path_col else F.lit("")
    split = rows.withColumn("words", words_of(F.col("text"))).where(F.size("words") > 0)
    found = split.select("doc_id", F.explode(candidates("words", path)).alias("x"))
    found = found.select("doc_id", F.col("x.place").alias("word_no"), F.col("x.c").alias("c"))
    return found.select("doc_id", "word_no", F.col("c.value").alias("value"), F.round(score(F.col("c")), 6).alias("score")).withColumn("is_secret", F.col("score") >= least)


def redact(docs: DataFrame, findings: DataFrame | None = None, least: float = 0.5, mask: str = "[secret]", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mask``; all rows and
    other columns stay.

    Null and empty texts stay as they are, repeated rows are treated alike, and an empty
    table gives an empty result.  Of values that overlap the longer goes first.  A value
    found once in a text goes wherever it stands in it; one of under 12 characters only
    where it is assigned to a credential's name.
    """
    score = train(findings if findings is not None else labelled_findings(docs.sparkSession))
    rows, text = numbered(docs), f"c{position(docs, text_col)}"
    path = F.col(f"c{position(docs, path_col)}") if path_col else F.lit("")
    split = rows.withColumn(_WORDS, words_of(F.col(text)))
    found = F.filter(candidates(_WORDS, path), lambda x: score(x["c"]) >= least)
    # longer values first, so that one inside another can't break it
    values = F.array_sort(F.array_distinct(F.transform(found, lambda x: F.struct((-F.length(x["c"]["value"])).alias("n"), x["c"]["value"].alias("v")))))
    # a short one can be part of other words, and goes only where it is assigned
    assigned = lambda v: F.concat(F.lit(rf"(?<=(?i:{_NAME}))\Q"), v, F.lit(r"\E(?![A-Za-z0-9+/_\-])"))
    in_place = lambda t, v: F.regexp_replace(t, assigned(v), F.lit(mask.replace("\\", r"\\").replace("$", r"\$")))
    clean = F.aggregate(values, F.col(text), lambda t, x: F.when(F.length(x["v"]) < 12, in_place(t, x["v"])).otherwise(F.replace(t, x["v"], F.lit(mask))))
    return split.withColumn(text, clean).drop(_WORDS).toDF(*docs.columns)


#: A column of ``redact``'s own, gone in its result.
_WORDS = "words of the text, split"
