"""Organisation graphs as DataFrames of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import below, levels, nodes, rolled_up, topological

__all__ = ["below", "children", "descendants", "edges", "leaf_metrics", "leaves", "levels", "managers", "merge_attributes", "nodes", "rolled_up", "topological", "validate_tree"]


def edges(df: DataFrame, path: list[str], mode: str = "adjacent") -> DataFrame:
    """``parent, child`` of a flat path table.

    ``adjacent``: a null breaks the path on both sides.  ``compact``: nulls are left
    out, so a node hangs under the next higher one that is known.
    """
    steps = F.array(*[F.col(c).cast("string") for c in path])
    if mode == "compact":
        steps = F.array_compact(steps)
    elif mode != "adjacent":
        raise ValueError(f"mode {mode!r} is neither adjacent nor compact")
    pairs = F.zip_with(F.slice(steps, F.lit(1), F.greatest(F.size(steps) - 1, F.lit(0))), F.slice(steps, F.lit(2), F.size(steps)), lambda a, b: F.struct(a.alias("parent"), b.alias("child")))
    return df.select(F.explode(pairs).alias("e")).select("e.*").where("parent IS NOT NULL AND child IS NOT NULL").distinct()


def leaf_metrics(df: DataFrame, path: list[str], metrics: list[str]) -> DataFrame:
    """Metrics of the nodes in the last path column whose parent is known; where a leaf
    has several rows the last value that is not null in row order counts (``row_no``
    if the table has it)."""
    order = F.col("row_no") if "row_no" in df.columns else F.monotonically_increasing_id()
    rows = df.where(F.col(path[-1]).isNotNull() & F.col(path[-2]).isNotNull()).withColumn("_at", order)
    return rows.groupBy(F.col(path[-1]).cast("string").alias("node")).agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), F.col("_at"))).alias(m) for m in metrics])


def merge_attributes(rows: DataFrame, order: str, key: str = "node") -> DataFrame:
    """Attributes given for a node more than once: later values overwrite earlier ones."""
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rows.columns if c not in (key, order)])


def children(links: DataFrame, node: str) -> DataFrame:
    return links.where(F.col("parent") == node).select(F.col("child").alias("node"))


def descendants(links: DataFrame, node: str) -> DataFrame:
    """``node, depth`` below a node, once for each depth at which a way leads to it.
    Circles raise ``ValueError``."""
    return below(links, node).select("node", "depth")


def leaves(links: DataFrame, node: str) -> DataFrame:
    """Leaves below a node; none for a leaf."""
    return descendants(links, node).select("node").distinct().join(links.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def managers(links: DataFrame) -> DataFrame:
    """Nodes of which all children are leaves, with their number."""
    kinds = nodes(links).select(F.col("node").alias("child"), "is_leaf")
    return links.join(kinds, "child").groupBy("parent").agg(F.bool_and("is_leaf").alias("all"), F.count("*").alias("team_size")).where("all").select(F.col("parent").alias("node"), "team_size")


def validate_tree(links: DataFrame) -> None:
    """Raises unless every node has one parent and there is no circle."""
    double = links.groupBy("child").count().where("count > 1").limit(1).collect()
    if double:
        raise ValueError(f"{double[0].child!r} has more than one parent")
    levels(links)
