"""Walks over graphs of any depth by doubling.

A round joins the ways of one length with themselves, which gives those of twice the
length, so a graph of depth d takes about log2(d) rounds.  What nodes know about the
``2**k`` steps next to them becomes, in the same round, what they know about ``2**(k+1)``.
Each round's tables are written and end its lineage.  Nodes and ways are joined by
sort-merge joins, and only nodes that ways of a round end at, if counted few, are broadcast.  A graph with a circle has ways of
every length, and raises ``ValueError`` once they are longer than it has nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import FEW, dropped, few, written


def nodes(links: DataFrame) -> DataFrame:
    """``node, is_leaf, is_root``."""
    ends = links.select(F.col("parent").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("child", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg((F.max("up") == 0).alias("is_leaf"), (F.max("down") == 0).alias("is_root"))


def inner(links: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    """A function that makes a table a side of a join by inner nodes: only its rows of these,
    broadcast, if the graph has few of them; else for a sort-merge join."""
    heads = written(links.select(F.col("parent").alias("_head")).distinct(), "heads")
    if heads.count() > FEW:
        return lambda df, node: df.hint("merge")
    return lambda df, node: F.broadcast(df.join(F.broadcast(heads), F.col(node) == F.col("_head"), "left_semi"))


def ways(links: DataFrame, at: Callable[[DataFrame, str], DataFrame] | None = None) -> Iterator[tuple[int, DataFrame]]:
    """For 1, 2, 4, ... steps the ways of exactly that length, ``low, high, paths``: for
    each two nodes the number of ways from the lower one up to the higher (a double, as in
    a circle it grows with every round)."""
    at = at or inner(links)
    now = written(links.select(F.col("child").alias("low"), F.col("parent").alias("high"), F.lit(1.0).alias("paths")).distinct(), "ways")
    length, most = 1, None
    while now.limit(1).count():
        if most is None:
            most = nodes(links).count()
        if length > most:
            raise ValueError("the graph has a circle")
        yield length, now
        a, b = now.alias("a"), few(at(now, "low")).alias("b")
        longer = a.join(b, F.col("a.high") == F.col("b.low")).groupBy(F.col("a.low").alias("low"), F.col("b.high").alias("high")).agg(F.sum(F.col("a.paths") * F.col("b.paths")).alias("paths"))
        before, now, length = now, written(longer, "ways"), 2 * length
        dropped(before)
    dropped(now)


def walked(links: DataFrame, start: DataFrame, grow: Callable[..., DataFrame]) -> DataFrame:
    """``start`` after a round for each length of ways: ``grow(state, ways, length, inner)``."""
    at = inner(links)
    state = written(start, "state")
    for length, way in ways(links, at):
        before, state = state, written(grow(state, way, length, at), "state")
        dropped(before)
    return state


def from_above(links: DataFrame, start: DataFrame, best: Callable, add_length: bool = True) -> DataFrame:
    """``node, value``: ``best`` (F.min or F.max) of what nodes above a node know, ``start``
    (node, value; null: nothing) and, with ``add_length``, the steps to them."""
    pick = F.least if best is F.min else F.greatest

    def grow(state: DataFrame, way: DataFrame, length: int, at: Callable) -> DataFrame:
        value = F.col("value") + length if add_length else F.col("value")
        known = at(state.where("value IS NOT NULL"), "node").select(F.col("node").alias("high"), value.alias("far"))
        far = way.join(known, "high").groupBy(F.col("low").alias("node")).agg(best("far").alias("far"))
        return state.join(far.hint("merge"), "node", "left").select("node", pick("value", "far").alias("value"))

    return walked(links, start, grow)


def levels(links: DataFrame) -> DataFrame:
    """``node, level``: the fewest steps from a root.  Circles raise ``ValueError``."""
    start = nodes(links).select("node", F.when(F.col("is_root"), 0).alias("value"))
    return from_above(links, start, F.min).select("node", F.col("value").alias("level"))


def topological(links: DataFrame) -> DataFrame:
    """``node, generation, place``: the most steps from a root, and a place in an order in
    which parents come before children: by generation, then by name.

    Places are counted in ranges of names within a generation, so no task orders all."""
    start = nodes(links).select("node", F.lit(0).alias("value"))
    found = from_above(links, start, F.max).select("node", F.col("value").alias("generation"))
    found = found.withColumn("_start", F.substring("node", 1, 4))
    counts = found.groupBy("generation", "_start").agg(F.count("*").alias("_n"))
    own = Window.partitionBy("generation").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_near", F.coalesce(F.sum("_n").over(own), F.lit(0)))
    # one row a generation
    sums = counts.groupBy("generation").agg(F.sum("_n").alias("_all"))
    sums = sums.select("generation", F.coalesce(F.sum("_all").over(Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_far"))
    rows = found.join(counts.hint("merge"), ["generation", "_start"]).join(sums, "generation")
    return rows.select("node", "generation", (F.col("_far") + F.col("_near") + F.row_number().over(Window.partitionBy("generation", "_start").orderBy("node")) - 1).alias("place"))


def below(links: DataFrame, node: str) -> DataFrame:
    """``node, depth, paths`` for what lies below a node: the ways of each length to it."""
    start = links.sparkSession.createDataFrame([(node, 0, 1.0)], "node string, depth int, paths double")

    def grow(state: DataFrame, way: DataFrame, length: int, at: Callable) -> DataFrame:
        known = few(at(state, "node")).select(F.col("node").alias("high"), "depth", F.col("paths").alias("_p"))
        far = way.join(known, "high").groupBy(F.col("low").alias("node"), (F.col("depth") + length).alias("depth")).agg(F.sum(F.col("paths") * F.col("_p")).alias("paths"))
        return state.unionByName(far)

    return walked(links, start, grow).where("depth > 0")


def rolled_up(links: DataFrame, leaf: DataFrame, columns: list[str]) -> DataFrame:
    """``node, columns``: for every node the sums over all leaves below it, once for every
    way to them; leaves keep their own, and those that ``leaf`` lacks have 0."""
    kinds = nodes(links)
    zero = lambda c: F.coalesce(F.when(F.col("is_leaf"), F.col(c)), F.lit(0.0)).cast("double").alias(c)
    start = kinds.join(leaf.select("node", *columns).hint("merge"), "node", "left").select("node", *[zero(c) for c in columns])

    def grow(state: DataFrame, way: DataFrame, length: int, at: Callable) -> DataFrame:
        far = way.join(state.hint("merge"), F.col("low") == F.col("node")).groupBy(F.col("high").alias("node")).agg(*[F.sum(F.col("paths") * F.col(c)).alias(f"_far_{c}") for c in columns])
        return state.join(far.hint("merge"), "node", "left").select("node", *[(F.col(c) + F.coalesce(f"_far_{c}", F.lit(0.0))).alias(c) for c in columns])

    return walked(links, start, grow)


def first_parents(links: DataFrame) -> DataFrame:
    """``parent, child`` with one parent each, the first by name."""
    return links.groupBy("child").agg(F.min("parent").alias("parent")).select("parent", "child")


def nearest(links: DataFrame, marks: DataFrame) -> DataFrame:
    """``node, mark``: the mark (``marks``: node, mark) of the node itself or else of the
    nearest one above it, going by ``first_parents``; null where none is marked."""
    start = nodes(links).select("node").join(few(marks.select("node", "mark")), "node", "left")

    def grow(state: DataFrame, way: DataFrame, length: int, at: Callable) -> DataFrame:
        known = at(state.where("mark IS NOT NULL"), "node").select(F.col("node").alias("high"), F.col("mark").alias("_far"))
        far = way.join(known, "high").select(F.col("low").alias("node"), "_far")
        return state.join(far.hint("merge"), "node", "left").select("node", F.coalesce("mark", "_far").alias("mark"))

    return walked(first_parents(links), start, grow)


def handed_down(steps: DataFrame, root: str, value: float) -> DataFrame:
    """``node, value`` for the root and all below it: a child has its parent's value times
    ``a`` plus ``b``.  ``steps``: parent, child, a, b, with one parent for each child.

    Ways of twice the length have the two steps' factors put together."""
    spark, at = steps.sparkSession, inner(steps)
    state = written(spark.createDataFrame([(root, float(value))], "node string, value double"), "state")
    way = written(steps.select(F.col("child").alias("low"), F.col("parent").alias("high"), "a", "b"), "ways")
    length, most = 1, None
    while way.limit(1).count():
        if most is None:
            most = steps.count() + 1
        if length > most:
            raise ValueError("the graph has a circle")
        far = way.join(at(state, "node"), F.col("high") == F.col("node")).select(F.col("low").alias("node"), (F.col("value") * F.col("a") + F.col("b")).alias("value"))
        a, b = way.alias("x"), at(way, "low").alias("y")
        longer = a.join(b, F.col("x.high") == F.col("y.low")).select("x.low", "y.high", (F.col("x.a") * F.col("y.a")).alias("a"), (F.col("y.b") * F.col("x.a") + F.col("x.b")).alias("b"))
        old, state, way, length = (state, way), written(state.unionByName(far), "state"), written(longer, "ways"), 2 * length
        dropped(*old)
    dropped(way)
    return state
