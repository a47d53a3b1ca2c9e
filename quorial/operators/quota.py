"""Quota cascades: historical capacity, top-down shares, hedges, overrides, new hires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lookup
from ..functions.tables import written
from .graphs import below, handed_down, nodes, rolled_up, topological


def attainment_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "_Attainment" in c]


def leaf_capacity(columns: list[str]) -> Column:
    """Sum of the quarters, with each that is not over 0 replaced by the mean of those
    that are; null quarters are left out and not replaced."""
    if not columns:
        return F.lit(0.0)
    known = F.array_compact(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]))
    good = F.filter(known, lambda v: v > 0)
    total = F.aggregate(good, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(good) > 0, F.size(known) * total / F.size(good)).otherwise(0.0)


def capacity_rollup(df: DataFrame, path: list[str], value: str = "capacity") -> DataFrame:
    """``node, level, value`` on all levels of complete paths, by one rollup."""
    names = [f"p{i}" for i in range(len(path))]
    rows = df.select(*[F.col(c).cast("string").alias(n) for c, n in zip(path, names, strict=True)], F.col(value).cast("double").alias("v"))
    out = rows.rollup(*names).agg(F.sum("v").alias(value), F.grouping_id().alias("gid"))
    level = F.lit(len(path) - 1) - F.bit_count("gid")
    node = F.element_at(F.array(*names), (level + 1).cast("int"))
    return out.where(F.bit_count("gid") < len(path)).select(node.alias("node"), level.cast("int").alias("level"), value)


def cascade(df: DataFrame, path: list[str], target: float, hedge: float | dict[str, float] = 1.0, overrides: dict[str, float] | None = None, root: str | None = None, capacity: str = "capacity") -> DataFrame:
    """``node, level, quota`` for a table of complete, strict paths with leaf capacity.

    Every inner node's quota times its hedge is shared among its children by capacity,
    evenly where that is 0.  In teams of leaves overridden leaves get their amounts
    first; leaves without capacity or override get an even share of all; what is left
    goes to the others by capacity and stays undealt if there are none.  ``root`` starts
    at another node; the levels above get nothing.

    Levels are aggregated from the one below, and each row carries the quotas above it
    down to the leaves, so the table is walked once; every inner node is told by the
    first of its leaves.
    """
    names = [f"p{i}" for i in range(len(path))]
    leaf = df.select(*[F.col(c).cast("string").alias(n) for c, n in zip(path, names, strict=True)], F.col(capacity).alias("cap"))
    tables = [leaf]
    for depth in range(len(path) - 1, 0, -1):
        tables.insert(0, tables[0].groupBy(*names[:depth]).agg(F.sum("cap").alias("cap")))
    factor = (lambda node: lookup(node, hedge, 1.0)) if isinstance(hedge, dict) else (lambda node: F.lit(float(hedge)))
    amount = lookup(F.col(names[-1]), overrides or {}, None).cast("double")
    start = lambda i, quota: quota if root is None else F.when(F.col(names[i]) == root, F.lit(float(target))).otherwise(quota)
    top = tables[0].select(names[0], start(0, F.lit(float(target)) if root is None else F.lit(None).cast("double")).alias("q0"))
    for i in range(1, len(path)):
        team = Window.partitionBy(*names[:i])
        rows = tables[i].join(top, names[:i]).withColumn("pool", F.col(f"q{i - 1}") * factor(F.col(names[i - 1])))
        n, total = F.count("*").over(team), F.sum("cap").over(team)
        if i < len(path) - 1:
            quota = F.col("pool") * F.when(total > 0, F.try_divide(F.col("cap"), total)).otherwise(1 / n)
        else:
            rows = rows.withColumn("over", amount)
            fresh = F.col("over").isNull() & (F.col("cap") == 0)
            old = F.col("over").isNull() & (F.col("cap") > 0)
            share = F.col("pool") / n
            rest = F.col("pool") - F.coalesce(F.sum("over").over(team), F.lit(0.0)) - share * F.sum(fresh.cast("int")).over(team)
            weight = F.sum(F.when(old, F.col("cap"))).over(team)
            quota = F.when(F.col("over").isNotNull(), F.col("over")).when(fresh, share).otherwise(rest * F.try_divide(F.col("cap"), weight))
            quota = F.when(F.col("pool").isNotNull(), quota)
        above = [c for c in top.columns if c not in names]
        top = rows.select(*names[: i + 1], *above, start(i, quota).alias(f"q{i}"), (F.row_number().over(team.orderBy(names[i])) == 1).alias(f"first{i}"))
    told = []
    for i in range(len(path)):
        first = F.lit(True)
        for k in range(i + 1, len(path)):
            first = first & F.col(f"first{k}")
        told.append(F.when(first & F.col(f"q{i}").isNotNull(), F.struct(F.col(names[i]).alias("node"), F.lit(i).alias("level"), F.col(f"q{i}").alias("quota"))))
    return top.select(F.inline(F.array_compact(F.array(*told))))


def cascade_graph(links: DataFrame, capacities: DataFrame, target: float, root: str, hedge: float | dict[str, float] = 1.0, overrides: dict[str, float] | None = None) -> DataFrame:
    """``node, quota`` for the root and all below it, in a graph of any shape and depth
    (``parent, child``) with leaf ``node, capacity``.

    Capacities count once for every way down to a leaf.  Teams that mix leaves and inner
    nodes are shared by capacity, without overrides.  A node with several parents has the
    share that the last of those with a quota gives it, in ``topological`` order.  A
    team's sums are made first, so that what is left is to hand quotas down, by doubling.
    A circle raises ``ValueError``."""
    links = links.select("parent", "child").distinct()
    kinds = nodes(links).select("node", "is_leaf")
    caps = rolled_up(links, capacities, ["capacity"]).withColumnRenamed("capacity", "cap")
    team = Window.partitionBy("parent")
    rows = links.join(caps.withColumnRenamed("node", "child").hint("merge"), "child").join(kinds.withColumnRenamed("node", "child").hint("merge"), "child")
    rows = rows.withColumn("whole", F.bool_and("is_leaf").over(team)).withColumn("over", F.when(F.col("whole"), lookup(F.col("child"), overrides or {}, None).cast("double")))
    fresh = F.col("whole") & F.col("over").isNull() & (F.col("cap") == 0)
    n, total = F.count("*").over(team), F.sum("cap").over(team)
    weight = F.sum(F.when(F.col("over").isNull() & ~fresh, F.col("cap"))).over(team)
    share = F.when(F.col("whole"), F.coalesce(F.try_divide(F.col("cap"), weight), F.lit(0.0))).otherwise(F.when(total > 0, F.try_divide(F.col("cap"), total)).otherwise(1 / n))
    factor = lookup(F.col("parent"), hedge, 1.0) if isinstance(hedge, dict) else F.lit(float(hedge))
    # quota = pool * a + b
    a = F.when(F.col("over").isNotNull(), 0.0).when(fresh, 1 / n).otherwise(share * (1 - F.sum(fresh.cast("int")).over(team) / n))
    b = F.when(F.col("over").isNotNull(), F.col("over")).when(fresh, 0.0).otherwise(-share * F.coalesce(F.sum("over").over(team), F.lit(0.0)))
    steps = rows.select("parent", "child", (a * factor).cast("double").alias("a"), b.cast("double").alias("b"))
    if links.groupBy("child").count().where("count > 1").limit(1).count():
        heads = written(below(links, root).select("node").distinct().union(links.sparkSession.createDataFrame([(root,)], "node string")).distinct(), "reached")
        order = heads.join(topological(links).hint("merge"), "node").select(F.col("node").alias("parent"), "place")
        steps = steps.join(order.hint("merge"), "parent").groupBy("child").agg(F.max(F.struct("place", "parent", "a", "b")).alias("last")).select("child", "last.parent", "last.a", "last.b")
    return handed_down(written(steps, "steps"), root, target).withColumnRenamed("value", "quota")


def over_assignment(quotas: DataFrame, leaf_level: int, target: float) -> DataFrame:
    """Sum of the leaves' quotas, and by how much it exceeds the target."""
    return quotas.where(F.col("level") == leaf_level).agg(F.sum("quota").alias("leaf_total")).withColumn("over_pct", F.col("leaf_total") / target - 1)
