"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, sorted_side, stored

#: Edges that a task writes, about, so that few edges are not written in many files.
EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (u, v); the root is the smallest node
    of its component.

    Each round links all larger neighbours of a node to its smallest one, then all
    smaller ones.  The number of edges never grows, and rounds are few even for long
    chains.  Edges are written to the shared folder after every round, and the round
    before is deleted; none are broadcast.  Repeated edges count once; edges with a null end or from a node
    to itself are left out, and no edges give no nodes.
    """
    ends = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    known = stored(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state, parts = None, _tasks(known.count())
    while True:
        both = known.union(known.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(sorted_side(low), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sorted_side(least), "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before, known = known, stored(small.coalesce(parts), "edges")
        discard(before)
        r = known.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (r.n, r.h):
            break
        state, parts = (r.n, r.h), _tasks(r.n)
    leaf = known.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    root = known.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return leaf.union(root.join(sorted_side(leaf), "node", "left_anti")).coalesce(parts)


def _tasks(edges: int) -> int:
    return max(1, -(-edges // EDGES))
