"""Graphs of any shape against plain walks."""

import random

import pytest

from quorial.operators import graphs as G
from quorial.operators import hierarchy as H
from quorial.operators import pipeline as P
from quorial.operators import quota as Q

EDGE = "parent string, child string"


def as_dict(df, value, key="node"):
    return {r[key]: r[value] for r in df.collect()}


class Walk:
    """A graph in dictionaries, walked node by node."""

    def __init__(self, links):
        self.names = sorted({x for e in links for x in e})
        self.down = {n: sorted({c for p, c in links if p == n}) for n in self.names}
        self.up = {n: sorted({p for p, c in links if c == n}) for n in self.names}

    def total(self, node, leaf):
        return sum(self.total(c, leaf) for c in self.down[node]) if self.down[node] else leaf.get(node, 0.0)

    def order(self):
        generation = {}
        while len(generation) < len(self.names):
            for n in self.names:
                if n not in generation and all(p in generation for p in self.up[n]):
                    generation[n] = max((generation[p] + 1 for p in self.up[n]), default=0)
        return generation, sorted(self.names, key=lambda n: (generation[n], n))

    def level(self, node):
        return min((self.level(p) + 1 for p in self.up[node]), default=0)

    def mark(self, node, marks):
        while node not in marks and self.up[node]:
            node = self.up[node][0]
        return node if node in marks else None

    def cascade(self, root, target, caps, hedge, overrides):
        quotas = {root: target}
        for node in self.order()[1]:
            kids = self.down[node]
            if node not in quotas or not kids:
                continue
            pool, cap = quotas[node] * hedge, {k: self.total(k, caps) for k in kids}
            if all(not self.down[k] for k in kids):
                given = {k: overrides[k] for k in kids if k in overrides}
                fresh = [k for k in kids if k not in given and cap[k] == 0]
                old = [k for k in kids if k not in given and cap[k] > 0]
                rest = pool - sum(given.values()) - pool / len(kids) * len(fresh)
                quotas |= given | {k: pool / len(kids) for k in fresh} | {k: rest * cap[k] / sum(cap[o] for o in old) for k in old}
            else:
                all_ = sum(cap.values())
                quotas |= {k: pool * (cap[k] / all_ if all_ else 1 / len(kids)) for k in kids}
        return quotas


def shapes():
    rng = random.Random(7)
    for n, more in ((12, 0), (40, 25)):
        links = [(f"n{rng.randint(0, i - 1):02d}", f"n{i:02d}") for i in range(1, n)]
        links += [tuple(f"n{x:02d}" for x in sorted(rng.sample(range(n), 2))) for _ in range(more)]
        yield links


@pytest.mark.parametrize("links", list(shapes()))
def test_walks(spark, links):
    rng = random.Random(len(links))
    w, e = Walk(links), spark.createDataFrame(links + links[:2], EDGE)
    caps = {n: float(rng.choice([0, 0, 10, 20, 35])) for n in w.names if not w.down[n]}
    leaf = spark.createDataFrame(list(caps.items()), "node string, capacity double")
    generation, order = w.order()
    rows = {r.node: (r.generation, r.place) for r in G.topological(e).collect()}
    assert rows == {n: (generation[n], i) for i, n in enumerate(order)}
    assert as_dict(G.levels(e), "level") == {n: w.level(n) for n in w.names}
    assert as_dict(G.rolled_up(e, leaf, ["capacity"]), "capacity") == {n: w.total(n, caps) for n in w.names}
    marks = {"n01", "n05", "n07"}
    assert as_dict(G.nearest(e, spark.createDataFrame([(m, m) for m in marks], "node string, mark string")), "mark") == {n: w.mark(n, marks) for n in w.names}
    root = "n00" if len(links) < 20 else "n01"
    got = as_dict(Q.cascade_graph(e, leaf, 1000.0, root, 1.1, {"n11": 5.0}), "quota")
    assert got == pytest.approx(w.cascade(root, 1000.0, caps, 1.1, {"n11": 5.0}))


def test_a_chain_of_five_thousand(spark):
    n = 5000
    e = spark.range(n).selectExpr("concat('c', id) AS parent", "concat('c', id + 1) AS child")
    assert H.levels(e).where("level <> int(substring(node, 2))").count() == 0


def test_circles_are_refused(spark):
    e = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], EDGE)
    for run in (H.levels, H.topological, lambda x: H.leaves(x, "r")):
        with pytest.raises(ValueError, match="circle"):
            run(e)
    with pytest.raises(ValueError, match="circle"):
        Q.cascade_graph(e, spark.createDataFrame([("c", 1.0)], "node string, capacity double"), 1.0, "r")


def test_last_parent_wins(spark):
    """x hangs under a and, deeper, under c; only the share that c gives counts, and both
    ways to x count in the capacity of r."""
    e = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "x"), ("a", "y"), ("b", "c"), ("c", "x"), ("c", "z")], EDGE)
    leaf = spark.createDataFrame([("x", 10.0), ("y", 30.0), ("z", 10.0)], "node string, capacity double")
    assert as_dict(G.rolled_up(e, leaf, ["capacity"]), "capacity")["r"] == 60
    q = as_dict(Q.cascade_graph(e, leaf, 600.0, "r"), "quota")
    assert q == pytest.approx({"r": 600, "a": 400, "b": 200, "c": 200, "x": 100, "y": 300, "z": 100})
    # from a only, c has no quota and gives none
    assert as_dict(Q.cascade_graph(e, leaf, 600.0, "a"), "quota") == pytest.approx({"a": 600, "x": 150, "y": 450})


def test_jagged_teams(spark):
    """The team under m shares; i9 beside an inner node keeps its quota."""
    links = [("g", "m"), ("g", "i9"), ("m", "i0"), ("m", "i1"), ("m", "i2")]
    e = spark.createDataFrame(links, EDGE)
    pipes = spark.createDataFrame([("i0", 400.0), ("i1", 200.0), ("i2", 50.0), ("i9", 0.0)], "node string, pipeline double")
    quotas = spark.createDataFrame([("g", 310.0), ("m", 300.0), ("i9", 10.0), ("i0", 100.0), ("i1", 100.0), ("i2", 100.0)], "node string, quota double")
    out = as_dict(P.adjust_graph(e, pipes, quotas, {"_default": (3.0, 1.5)}, "redistribute"), "adjusted")
    assert {k: round(v, 6) for k, v in out.items()} == {"g": 310, "m": 300, "i9": 10, "i0": 80, "i1": 100, "i2": 120}
    locked = as_dict(P.adjust_graph(e, pipes, quotas, {"_default": (3.0, 1.5)}, "redistribute", locks={"i2": 70.0}), "adjusted")
    assert locked["i2"] == 70 and locked["i0"] == 100
    d = {r.Node: r for r in P.diagnose_graph(e, pipes, quotas, {"m": (1.0, 0.5)}).collect()}
    assert (d["g"].Pipeline, d["m"].Level, d["i0"].Risk_Status, d["i2"].Risk_Status, d["i9"].Risk_Status) == (650, 1, "Healthy", "Moderate", "Critical")
    with pytest.raises(ValueError, match="more than one team"):
        P.adjust_graph(e.union(spark.createDataFrame([("i9", "i0")], EDGE)), pipes, quotas, {}, "redistribute")
    with pytest.raises(ValueError):
        P.adjust_graph(e, pipes, quotas, {}, "other")


def test_sides_of_joins_are_counted(spark, monkeypatch):
    """Only inner nodes are broadcast, and only few."""
    from quorial.operators import graphs

    links = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "x"), ("a", "y")], "parent string, child string")
    state = spark.createDataFrame([(n,) for n in "rabxy"], "node string")
    assert sorted(r.node for r in graphs.inner(links)(state, "node").collect()) == ["a", "r"]
    monkeypatch.setattr(graphs, "FEW", 1)
    assert graphs.inner(links)(state, "node").count() == 5
