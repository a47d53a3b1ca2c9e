"""Tool-call linking with DataFrame functions only.

Calls and results meet by identifier in one shuffled hash join; calls are put in
topological order over the calls they depend on, one or several; arguments are validated
against schemas; and each record is written as canonical JSON (keys in order, no
blanks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pick, sorted_side, stored

#: Fields of a tool: name -> (JSON kind, required).
Schema = dict[str, tuple[str, bool]]

#: Fixed: how a variant's type begins, by JSON kind.
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT", "null": "VOID"}


def canonical(json: F.Column) -> F.Column:
    """JSON text with object keys in order and no blanks; null where it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def _broken(tool: Schema, parsed: F.Column) -> F.Column:
    """The fields that break a tool's schema, in order; ``*`` for what is no object."""
    checks = []
    for name, (kind, required) in sorted(tool.items()):
        value = F.try_variant_get(parsed, f"$.{name}", "variant")
        # a null stands for a missing value, but where null is what the schema asks for
        missing = value.isNull() if kind == "null" else value.isNull() | F.is_variant_null(value)
        wrong = ~F.coalesce(F.schema_of_variant(value), F.lit("VOID")).rlike(f"^(?:{_KINDS[kind]})")
        checks.append(F.when(F.when(missing, F.lit(required)).otherwise(wrong), F.lit(name)))
    known = F.array(*[F.lit(n) for n in tool]).cast("array<string>")
    keys = F.map_keys(F.from_json(F.to_json(parsed), "map<string,string>"))
    extra = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit("+"), k))
    object_ = F.schema_of_variant(parsed).startswith("OBJECT")
    return F.when(object_, F.concat(F.array_compact(F.array(*checks)), F.coalesce(extra, F.array().cast("array<string>")))).otherwise(F.array(F.lit("*")))


def _before(calls: DataFrame) -> F.Column:
    """The identifiers that a call comes after, as an array; one identifier is one of one."""
    if calls.schema["after"].dataType.typeName() == "array":
        return F.array_distinct(F.array_compact(F.coalesce("after", F.array().cast("array<string>"))))
    return F.array_compact(F.array("after"))


def levels(calls: DataFrame) -> DataFrame:
    """``group, id, level``: the longest way of calls that must come before, along
    ``after``, an identifier or an array of them.

    Calls with one predecessor form chains, which pointers shorten by doubling: each
    call learns how far it is behind its anchor, a call with no predecessor or with
    several.  The rounds of this grow with the logarithm of the longest chain.  Calls
    with several predecessors, if there are any, are then solved over these anchors
    only, in as many rounds as they follow one another.  A predecessor that doesn't
    exist counts as none; null identifiers in an array are left out.  Calls on a
    circle, or behind one, have no level.
    """
    ids = calls.select("group", "id").distinct()
    known = ids.select(F.col("group").alias("g"), F.col("id").alias("i"))
    edges = calls.select("group", "id", F.explode(_before(calls)).alias("to")).distinct()
    edges = stored(edges.join(sorted_side(known), (F.col("group") == F.col("g")) & (F.col("to") == F.col("i"))).select("group", "id", "to"), "edges")
    alone = edges.groupBy("group", "id").agg(F.count("*").alias("n"), F.min("to").alias("to"))
    # where a call's pointer leads, how far that is, and whether it leads on
    state = ids.join(sorted_side(alone), ["group", "id"], "left").select(
        "group", "id", F.when(F.col("n") == 1, F.col("to")).otherwise(F.col("id")).alias("to"), F.when(F.col("n") == 1, 1).otherwise(0).alias("far"), F.coalesce(F.col("n") == 1, F.lit(False)).alias("open"),
        (F.coalesce("n", F.lit(0)) > 1).alias("joint"),
    )
    before, rounds = None, 0
    while True:
        state = stored(state, "levels")
        if before is None:
            longest = state.groupBy("group").count().agg(F.max("count")).first()[0] or 0
        else:
            discard(before)
        # a chain without a circle is done once the pointers reach over its group
        if 2**rounds > longest or state.where("open").isEmpty():
            break
        before = state
        there = state.select(F.col("group").alias("g"), F.col("id").alias("i"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("open").alias("on"))
        step = state.where("open").join(sorted_side(there), (F.col("group") == F.col("g")) & (F.col("to") == F.col("i")))
        step = step.select("group", "id", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"), F.col("on").alias("open"), "joint")
        state = state.where("NOT open").unionByName(step)
        rounds += 1
    closed = state.where("NOT open")
    if state.where("joint").isEmpty():
        return state.select("group", "id", F.when(~F.col("open"), F.col("far")).alias("level"))
    solved = _joints(edges, state)
    led = closed.join(sorted_side(solved.select("group", F.col("id").alias("to"), "at")), ["group", "to"]).select("group", "id", (F.col("at") + F.col("far")).alias("level"))
    return ids.join(sorted_side(led), ["group", "id"], "left")


def _joints(edges: DataFrame, state: DataFrame) -> DataFrame:
    """``group, id, at``: the levels of anchors, those on or behind circles left out."""
    joints = state.where("joint").select("group", "id")
    roots = state.where("NOT open AND NOT joint AND to = id").select("group", "id", F.lit(0).alias("at"))
    place = state.where("NOT open").select("group", F.col("id").alias("to"), F.col("to").alias("anchor"), "far")
    # a predecessor on a circle has no anchor and keeps its joint waiting
    waits = edges.join(sorted_side(joints), ["group", "id"]).join(sorted_side(place), ["group", "to"], "left").groupBy("group", "id", "anchor").agg(F.max(F.col("far") + 1).alias("far"))
    waits, fresh, solved = stored(waits.withColumn("at", F.lit(None).cast("int")), "waits"), stored(roots, "solved"), []
    while not fresh.isEmpty():
        solved.append(fresh)
        news = fresh.select("group", F.col("id").alias("anchor"), F.col("at").alias("new"))
        told = waits.join(sorted_side(news), ["group", "anchor"], "left").select("group", "id", "anchor", "far", F.coalesce("at", F.col("new") + F.col("far")).alias("at"))
        told, old = stored(told, "waits"), waits
        ready = told.groupBy("group", "id").agg(F.bool_and(F.col("at").isNotNull()).alias("ready"), F.max("at").alias("at"))
        fresh = stored(ready.where("ready").select("group", "id", "at"), "solved")
        waits = stored(told.join(sorted_side(fresh.select("group", "id")), ["group", "id"], "left_anti"), "waits")
        discard(old, told)
    out = roots.limit(0) if not solved else solved[0]
    for more in solved[1:]:
        out = out.unionByName(more)
    return out


#: Results in a partition of the hash join, about.
RESULTS = 500_000


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: dict[str, Schema]) -> DataFrame:
    """One row per call, and per result without a call.

    ``calls``: group, id, name, arguments (JSON text), after (an id, an array of ids, or
    null), at (place).
    ``results``: group, id, content, at.  Of calls with one group and id the first in
    place stays, then the smaller name and arguments; of results likewise.  Rows whose
    group or id is null can't be linked and are left out.

    Returns ``group, id, level, status, valid, broken, json``.  ``status`` is linked,
    unanswered, orphan, or early where the result comes before its call.  ``broken``
    lists fields that are missing or of a wrong kind, ``+name`` for unknown ones, and
    ``*`` for arguments that are no object or of an unknown tool.  Other columns, whatever
    their names, play no part; repeated rows count once; empty tables: empty result.
    """
    calls = calls.where("group IS NOT NULL AND id IS NOT NULL")
    results = results.where("group IS NOT NULL AND id IS NOT NULL")
    one_call = calls.groupBy("group", "id").agg(F.min(F.struct("at", "name", "arguments", "after")).alias("c"))
    one_result = results.groupBy("group", "id").agg(F.min(F.struct("at", "content")).alias("r"))
    deep = levels(one_call.select("group", "id", F.col("c.after").alias("after")))
    # the hash table of a partition has about RESULTS rows at most, whatever the setting
    spark = calls.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-results.count() // RESULTS))
    placed = one_call.join(sorted_side(deep), ["group", "id"], "left").repartition(parts, "group", "id")
    joined = placed.join(one_result.repartition(parts, "group", "id").hint("shuffle_hash"), ["group", "id"], "full_outer")
    parsed = F.try_parse_json(F.col("c.arguments"))
    broken = F.array(F.lit("*"))
    for name, schema in tools.items():
        broken = F.when(F.col("c.name") == name, F.coalesce(_broken(schema, parsed), F.array(F.lit("*")))).otherwise(broken)
    status = (
        F.when(F.col("c").isNull(), "orphan").when(F.col("r").isNull(), "unanswered").when(F.col("r.at") < F.col("c.at"), "early").otherwise("linked")
    )
    out = joined.select("group", "id", "level", "c", "r", status.alias("status"), F.when(F.col("c").isNotNull(), broken).alias("broken"))
    # arguments that are no JSON are left out of the record
    record = F.to_json(F.struct(parsed.alias("arguments"), F.col("id").alias("id"), F.col("level").alias("level"), F.col("c.name").alias("name"), F.col("r.content").alias("result"), F.col("status").alias("status")))
    return out.select("group", "id", "level", "status", (F.size("broken") == 0).alias("valid"), "broken", record.alias("json"))


#: Tools of plain conversations: a system turn sets the instructions, a user turn asks.
CHAT_TOOLS: dict[str, Schema] = {
    "instruct": {"text": ("string", True), "turn": ("integer", True)},
    "ask": {"text": ("string", True), "turn": ("integer", True)},
}


def turns_as_calls(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations.

    A system or user turn is a call, numbered by its turn, that comes after the system
    or user turn two before it or, failing that, the one before it; an assistant turn
    is the result of the turn before it.  Other roles are left out.  A null text is
    missing from the arguments, which breaks the schema.
    """
    rows = pick(conversations, group=conv_col, turn=turn_col, role=role_col, text=text_col)
    name = F.when(F.col("role") == "system", "instruct").when(F.col("role") == "user", "ask")
    label = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    asks = rows.where(F.col("role").isin("system", "user"))
    there = asks.select("group", F.explode(F.array(F.col("turn") + 1, F.col("turn") + 2)).alias("turn"), F.col("turn").alias("before")).groupBy("group", "turn").agg(F.max("before").alias("before"))
    arguments = F.to_json(F.struct("text", "turn"))
    calls = asks.join(sorted_side(there), ["group", "turn"], "left").select("group", label(F.col("turn")).alias("id"), name.alias("name"), arguments.alias("arguments"), label(F.col("before")).alias("after"), F.col("turn").alias("at"))
    results = rows.where(F.col("role") == "assistant").select("group", label(F.col("turn") - 1).alias("id"), F.col("text").alias("content"), F.col("turn").alias("at"))
    return calls, results


def conversation_calls(conversations: DataFrame) -> DataFrame:
    """``conv_id, call_id, level, status, valid, broken, json`` of plain conversations, for
    the rows of ``turns_as_calls``.  Rows with a null conversation or turn are left out,
    repeated turns count once, a null text breaks the schema, and an empty table gives an
    empty result."""
    calls, results = turns_as_calls(conversations)
    linked = link_tool_calls(calls, results, CHAT_TOOLS)
    return linked.select(F.col("group").alias("conv_id"), F.col("id").alias("call_id"), "level", "status", "valid", F.array_join("broken", ",").alias("broken"), "json")
