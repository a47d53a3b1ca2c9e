"""Pipeline coverage: diagnosis with inherited thresholds, and zero-sum redistribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.columns import lookup, ratio
from .graphs import levels, nearest, rolled_up
from .hierarchy import managers

Thresholds = dict[str, tuple[float, float]]
#: Healthy and at-risk coverage where nothing else is said.
DEFAULT = (3.0, 1.5)


def inherited(steps: list[Column], thresholds: Thresholds) -> tuple[Column, Column]:
    """Thresholds of the nearest node among ``steps`` (self first), else the default."""
    own = {k: v for k, v in thresholds.items() if k != "_default"}
    for healthy, _ in [*own.values(), thresholds.get("_default", DEFAULT)]:
        if healthy <= 0:
            raise ValueError("a healthy threshold must be over 0")
    base = thresholds.get("_default", DEFAULT)
    each = [F.coalesce(*[lookup(s, {n: v[k] for n, v in own.items()}, None).cast("double") for s in steps], F.lit(float(base[k]))) for k in (0, 1)]
    return each[0], each[1]


def node_paths(df: DataFrame, path: list[str]) -> DataFrame:
    """``node, level, steps`` (self first, then its parents) and the leaves' ``pipeline``
    summed, for every node of complete paths; one aggregation over all levels."""
    names = [F.col(c).cast("string") for c in path]
    parts = F.array(*[F.struct(F.lit(i).alias("level"), F.reverse(F.array(*names[: i + 1])).alias("steps")) for i in range(len(path))])
    rows = df.select(F.explode(parts).alias("x"), F.col("Current_Pipeline").cast("decimal(18,2)").alias("v"))
    return rows.groupBy("x.level", "x.steps").agg(F.coalesce(F.sum("v").cast("double"), F.lit(0.0)).alias("pipeline")).select(F.element_at("steps", 1).alias("node"), "level", "steps", "pipeline")


def risk(coverage: Column, healthy: Column, at_risk: Column) -> Column:
    return F.when(coverage >= healthy, "Healthy").when(coverage >= at_risk, "Moderate").when(coverage >= 1.0, "At Risk").otherwise("Critical")


def diagnose(df: DataFrame, path: list[str], quotas: DataFrame, thresholds: Thresholds) -> DataFrame:
    """Coverage and risk of every node that has a quota."""
    joined = node_paths(df, path).join(quotas.select("node", "level", "quota"), ["node", "level"])
    steps = [F.try_element_at("steps", F.lit(i)) for i in range(1, len(path) + 1)]
    healthy, at_risk = inherited(steps, thresholds)
    coverage = ratio(F.col("pipeline"), F.col("quota"))
    return joined.select(
        F.col("node").alias("Node"), F.col("level").alias("Level"), F.round("quota", 2).alias("Cascaded_Quota"), F.round("pipeline", 2).alias("Pipeline"),
        F.round(coverage, 4).alias("Coverage_Ratio"), healthy.alias("Healthy_Threshold"), at_risk.alias("At_Risk_Threshold"), risk(coverage, healthy, at_risk).alias("Risk_Status"),
    )


def risk_summary(diagnosis: DataFrame) -> DataFrame:
    return diagnosis.groupBy("Risk_Status").agg(F.count("*").alias("nodes"), F.sum("Cascaded_Quota").alias("quota"), F.sum("Pipeline").alias("pipeline"), F.avg("Coverage_Ratio").alias("mean_coverage"))


def adjust(df: DataFrame, path: list[str], quotas: DataFrame, thresholds: Thresholds, mode: str = "flag_only", max_pct: float = 0.20, locks: dict[str, float] | set[str] | None = None) -> DataFrame:
    """``node, level, quota, adjusted``.

    Lock amounts hold in either mode and for any node; a set of locks keeps quotas as
    they are.  ``redistribute`` moves quota within each team of leaves from those with
    spare coverage to those under the at-risk threshold, never more than ``max_pct`` of
    anyone's quota; every team keeps its sum.
    """
    if mode not in ("flag_only", "redistribute"):
        raise ValueError(f"mode {mode!r} is neither flag_only nor redistribute")
    locks = locks or {}
    amounts = locks if isinstance(locks, dict) else {}
    start = quotas.withColumn("q", F.coalesce(lookup(F.col("node"), amounts, None).cast("double"), F.col("quota")))
    if mode == "flag_only":
        return start.select("node", "level", "quota", F.col("q").alias("adjusted"))
    locked = F.col("node").isin(*locks) if locks else F.lit(False)
    leaf = node_paths(df, path).where(F.col("level") == len(path) - 1).join(start, ["node", "level"])
    steps = [F.try_element_at("steps", F.lit(i)) for i in range(1, len(path) + 1)]
    healthy, at_risk = inherited(steps, thresholds)
    rows = leaf.withColumn("healthy", healthy).withColumn("at_risk", at_risk).withColumn("free", ~locked)
    done = _moved(rows, Window.partitionBy(F.slice("steps", 2, len(path))), max_pct).select("node", "level", "quota", "adjusted")
    return start.where(F.col("level") < len(path) - 1).select("node", "level", "quota", F.col("q").alias("adjusted")).unionByName(done)


def _moved(rows: DataFrame, team: WindowSpec, max_pct: float) -> DataFrame:
    """``rows`` (q, pipeline, healthy, at_risk, free) with ``adjusted``, moved in teams."""
    rows = rows.withColumn("cov", ratio(F.col("pipeline"), F.col("q")))
    donor = F.col("free") & (F.col("cov") >= F.col("healthy"))
    taker = F.col("free") & (F.col("cov") < F.col("at_risk"))
    spare = F.try_divide(F.col("cov") - F.col("healthy"), F.col("cov"))
    rows = rows.withColumn("give", F.when(donor, F.greatest(F.lit(0.0), F.least(F.col("q") * max_pct, F.col("q") * spare))))
    rows = rows.withColumn("need", F.when(taker, F.when(F.col("cov") > 0, F.greatest(F.lit(0.0), F.try_divide(F.col("at_risk") - F.col("cov"), F.col("at_risk")))).otherwise(1.0)))
    rows = rows.withColumn("S", F.sum("give").over(team)).withColumn("N", F.sum("need").over(team)).withColumn("members", F.sum(F.col("free").cast("int")).over(team))
    works = (F.col("members") >= 2) & (F.col("S") > 0) & (F.col("N") > 0)
    rows = rows.withColumn("inc", F.when(works & F.col("need").isNotNull(), F.least(F.col("S") * F.try_divide(F.col("need"), F.col("N")), F.col("q") * max_pct)))
    rows = rows.withColumn("D", F.sum("inc").over(team))
    # the donor's side is written last and wins
    new = F.when(works & F.col("give").isNotNull(), F.col("q") - F.col("give") * F.try_divide(F.col("D"), F.col("S"))).when(F.col("inc").isNotNull(), F.col("q") + F.col("inc")).otherwise(F.col("q"))
    return rows.withColumn("adjusted", new)


def graph_thresholds(links: DataFrame, thresholds: Thresholds) -> DataFrame:
    """``node, healthy, at_risk``: those of the node itself or of the nearest one above it
    (by first parents), else the default, in a graph of any shape."""
    own = [k for k in thresholds if k != "_default"]
    inherited([F.lit(None).cast("string")], thresholds)  # refuses thresholds that aren't over 0
    marks = links.sparkSession.createDataFrame([(k, k) for k in own], "node string, mark string")
    base = thresholds.get("_default", DEFAULT)
    limit = lambda k: F.coalesce(lookup(F.col("mark"), {n: float(thresholds[n][k]) for n in own}, None).cast("double"), F.lit(float(base[k])))
    return nearest(links, marks).select("node", limit(0).alias("healthy"), limit(1).alias("at_risk"))


def diagnose_graph(links: DataFrame, pipelines: DataFrame, quotas: DataFrame, thresholds: Thresholds) -> DataFrame:
    """``diagnose`` for a graph of any shape and depth: ``links`` (parent, child), leaf
    ``pipelines`` (node, pipeline) and ``quotas`` (node, quota).  A node's pipeline counts
    once for every way down to a leaf, its level is the fewest steps from a root."""
    links = links.select("parent", "child").distinct()
    facts = rolled_up(links, pipelines, ["pipeline"]).join(levels(links).hint("merge"), "node").join(graph_thresholds(links, thresholds).hint("merge"), "node")
    joined = facts.join(quotas.select("node", "quota").hint("merge"), "node")
    coverage = ratio(F.col("pipeline"), F.col("quota"))
    return joined.select(
        F.col("node").alias("Node"), F.col("level").alias("Level"), F.round("quota", 2).alias("Cascaded_Quota"), F.round("pipeline", 2).alias("Pipeline"),
        F.round(coverage, 4).alias("Coverage_Ratio"), F.col("healthy").alias("Healthy_Threshold"), F.col("at_risk").alias("At_Risk_Threshold"), risk(coverage, F.col("healthy"), F.col("at_risk")).alias("Risk_Status"),
    )


def adjust_graph(links: DataFrame, pipelines: DataFrame, quotas: DataFrame, thresholds: Thresholds, mode: str = "flag_only", max_pct: float = 0.20, locks: dict[str, float] | set[str] | None = None) -> DataFrame:
    """``node, quota, adjusted``: ``adjust`` for a graph of any shape and depth.

    A team is the children of a node of which all are leaves; leaves beside inner nodes
    keep their quotas.  A member without a quota has none to give.  A leaf in several
    teams raises ``ValueError`` in ``redistribute``, as its teams would depend on an order."""
    if mode not in ("flag_only", "redistribute"):
        raise ValueError(f"mode {mode!r} is neither flag_only nor redistribute")
    locks = locks or {}
    start = quotas.select("node", "quota", F.coalesce(lookup(F.col("node"), locks if isinstance(locks, dict) else {}, None).cast("double"), F.col("quota")).alias("q"))
    if mode == "flag_only":
        return start.select("node", "quota", F.col("q").alias("adjusted"))
    links = links.select("parent", "child").distinct()
    members = links.join(managers(links).select(F.col("node").alias("parent")), "parent").select(F.col("parent").alias("team"), F.col("child").alias("node"))
    double = members.groupBy("node").count().where("count > 1").limit(1).collect()
    if double:
        raise ValueError(f"{double[0].node!r} is in more than one team")
    known = members.join(start.hint("merge"), "node", "left").join(pipelines.select("node", "pipeline").hint("merge"), "node", "left").join(graph_thresholds(links, thresholds).hint("merge"), "node")
    locked = F.col("node").isin(*locks) if locks else F.lit(False)
    rows = known.select("team", "node", "healthy", "at_risk", F.coalesce("q", F.lit(0.0)).alias("q"), F.coalesce("pipeline", F.lit(0.0)).alias("pipeline"), (~locked).alias("free"))
    done = _moved(rows, Window.partitionBy("team"), max_pct).select("node", "adjusted")
    return start.join(done.hint("merge"), "node", "left").select("node", "quota", F.coalesce("adjusted", "q").alias("adjusted"))


def zero_sum(adjusted: DataFrame, parents: DataFrame, max_pct: float = 0.20) -> DataFrame:
    """Per team: its sum before and after, the largest share moved, and whether the team
    kept its sum within 1 and everyone stayed within the cap.  ``parents``: node, team."""
    rows = adjusted.join(parents, "node")
    moved = F.when(F.col("quota") > 0, F.abs(F.col("adjusted") - F.col("quota")) / F.col("quota")).otherwise(0.0)
    out = rows.groupBy("team").agg(F.sum("quota").alias("before"), F.sum("adjusted").alias("after"), F.max(moved).alias("most_moved"))
    return out.withColumn("ok", (F.abs(F.col("before") - F.col("after")) <= 1.0) & (F.col("most_moved") <= max_pct + 0.001))


def top_movers(adjusted: DataFrame, leaf_level: int, n: int = 3) -> DataFrame:
    """The n leaves that lost the largest share and the n that gained the largest."""
    rows = adjusted.where((F.col("level") == leaf_level) & (F.col("quota") > 0)).select("node", "quota", "adjusted", F.round((F.col("adjusted") - F.col("quota")) / F.col("quota") * 100, 4).alias("pct"))
    down = rows.orderBy("pct", "node").limit(n).withColumn("side", F.lit("down"))
    return down.unionByName(rows.orderBy(F.desc("pct"), "node").limit(n).withColumn("side", F.lit("up")))
