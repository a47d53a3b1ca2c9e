"""Hierarchies, quotas, commits and pipeline on hand-computed inputs."""

import pytest
from pyspark.sql import functions as F

from quorial.operators import commit as C
from quorial.operators import hierarchy as H
from quorial.operators import pipeline as P
from quorial.operators import quota as Q
from quorial.sources import readers as R

TEAM = ["Corp", "Mgr", "IC"]


def team(spark, people):
    names = [f"Q{i + 1}_Attainment" for i in range(len(next(iter(people.values()))))]
    rows = [("Corp", "Mgr_A", k, *map(float, v)) for k, v in people.items()]
    df = spark.createDataFrame(rows, "Corp string, Mgr string, IC string, " + ", ".join(f"{n} double" for n in names))
    return df.withColumn("capacity", Q.leaf_capacity(Q.attainment_columns(df)))


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


HIRES = {"T1": (100e3, 120e3, 110e3, 130e3), "T2": (200e3, 180e3, 190e3, 210e3), "T3": (150e3, 160e3, 170e3, 140e3), "Partial": (0, 0, 0, 150e3), "New": (0, 0, 0, 0)}


def test_eight_quarters(spark):
    df = team(spark, {"IC_A": range(100, 180, 10), "IC_B": range(200, 280, 10)})
    assert as_dict(df, "IC", "capacity") == {"IC_A": 1080.0, "IC_B": 1880.0}
    q = as_dict(Q.cascade(df, TEAM, 1000), "node", "quota")
    assert q["IC_A"] == pytest.approx(364.86, abs=0.01) and q["IC_B"] == pytest.approx(635.14, abs=0.01)


@pytest.mark.parametrize("graph", [False, True])
def test_new_hires(spark, graph):
    df = team(spark, HIRES)
    assert as_dict(df, "IC", "capacity") == {"T1": 460e3, "T2": 780e3, "T3": 620e3, "Partial": 600e3, "New": 0}
    if graph:
        out = Q.cascade_graph(H.edges(df, TEAM), df.select(F.col("IC").alias("node"), "capacity"), 100e3, "Corp")
    else:
        out = Q.cascade(df, TEAM, 100e3)
    q = as_dict(out, "node", "quota")
    assert [round(q[k], 2) for k in ("New", "T1", "T2", "T3", "Partial")] == [20000.0, 14959.35, 25365.85, 20162.60, 19512.20]


@pytest.mark.parametrize("graph", [False, True])
def test_override(spark, graph):
    df = team(spark, {"IC_1": [100e3] * 4, "IC_2": [200e3] * 4, "IC_S": [50e3] * 4})
    over = {"IC_S": 500e3}
    if graph:
        out = Q.cascade_graph(H.edges(df, TEAM), df.select(F.col("IC").alias("node"), "capacity"), 1e6, "Corp", overrides=over)
    else:
        out = Q.cascade(df, TEAM, 1e6, overrides=over)
    q = as_dict(out, "node", "quota")
    assert [round(q[k], 2) for k in ("IC_1", "IC_2", "IC_S")] == [166666.67, 333333.33, 500000.0]


def test_hedge_compounds(spark):
    q = Q.cascade(team(spark, HIRES), TEAM, 1000, 1.05)
    assert Q.over_assignment(q, 2, 1000).first().over_pct == pytest.approx(1.05**2 - 1)


def test_null_quarters_are_not_imputed(spark):
    df = spark.createDataFrame([("a", 10.0, None, -5.0), ("b", None, None, None)], "IC string, Q1_Attainment double, Q2_Attainment double, Q3_Attainment double")
    assert as_dict(df.withColumn("c", Q.leaf_capacity(Q.attainment_columns(df))), "IC", "c") == {"a": 20.0, "b": 0.0}


def test_all_new_team_and_undealt_rest(spark):
    df = team(spark, {"N1": [0.0], "O": [0.0]})
    q = as_dict(Q.cascade(df, TEAM, 100, overrides={"O": 30.0}), "node", "quota")
    assert q["N1"] == 50 and q["O"] == 30


def test_null_in_path(spark):
    df = spark.createDataFrame([("Corp", None, "IC_X"), ("Corp", "M", "IC_Y")], "a string, b string, c string")
    adjacent = {tuple(r) for r in H.edges(df, ["a", "b", "c"]).collect()}
    assert adjacent == {("Corp", "M"), ("M", "IC_Y")}
    assert ("Corp", "IC_X") in {tuple(r) for r in H.edges(df, ["a", "b", "c"], "compact").collect()}


def test_leaves_levels_managers(spark):
    e = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "x"), ("a", "y")], "parent string, child string")
    assert {r.node for r in H.leaves(e, "r").collect()} == {"b", "x", "y"}
    assert H.leaves(e, "x").count() == 0
    assert as_dict(H.levels(e), "node", "level") == {"r": 0, "a": 1, "b": 1, "x": 2, "y": 2}
    assert as_dict(H.managers(e), "node", "team_size") == {"a": 2}
    H.validate_tree(e)
    with pytest.raises(ValueError):
        H.validate_tree(e.union(spark.createDataFrame([("b", "x")], e.schema)))
    with pytest.raises(ValueError):
        H.validate_tree(spark.createDataFrame([("p", "q"), ("q", "p"), ("r", "s")], e.schema))


def test_merged_attributes(spark):
    df = spark.createDataFrame([("n", 1, 5.0, None), ("n", 2, None, "x"), ("n", 3, 7.0, None)], "node string, at int, v double, s string")
    r = H.merge_attributes(df, "at").first()
    assert (r.v, r.s) == (7.0, "x")


def test_bias(spark):
    h = spark.createDataFrame([("A", 400e3, 600e3), ("B", 800e3, 400e3), ("C", 400e3, 400e3), ("D", None, 5.0), (None, 1.0, 9.0)], "Manager_ID string, Historical_Commit double, Historical_Actual_Closed double")
    b = C.bias(h)
    assert as_dict(b, "manager", "bias") == {"A": 1.5, "B": 0.5, "C": 1.0, "D": 1.0}
    now = spark.createDataFrame([(m, 100e3, f) for m, f in (("A", 120e3), ("B", 120e3), ("C", 120e3), ("Z", None), ("A0", 0.0))], "Manager_ID string, Current_Commit double, m double")
    assert as_dict(C.reconcile(now, b), "manager", "forecast") == {"A": 150e3, "B": 50e3, "C": 100e3, "Z": 100e3, "A0": 100e3}
    assert as_dict(C.reconcile(now, b, machine="m"), "manager", "forecast") == {"A": 135e3, "B": 85e3, "C": 110e3, "Z": 100e3, "A0": 50e3}


@pytest.mark.parametrize("quotas,pipes,want", [((100, 100, 100), (400, 200, 50), (80, 100, 120)), ((100, 100, 50), (400, 200, 25), (90, 100, 60))])
def test_redistribute(spark, quotas, pipes, want):
    df = spark.createDataFrame([("M", f"i{k}", float(p)) for k, p in enumerate(pipes)], "M string, IC string, Current_Pipeline double")
    q = spark.createDataFrame([("M", 0, float(sum(quotas)))] + [(f"i{k}", 1, float(v)) for k, v in enumerate(quotas)], "node string, level int, quota double")
    out = as_dict(P.adjust(df, ["M", "IC"], q, {"_default": (3.0, 1.5)}, "redistribute"), "node", "adjusted")
    assert tuple(round(out[f"i{k}"], 6) for k in range(3)) == want
    with pytest.raises(ValueError):
        P.adjust(df, ["M", "IC"], q, {}, "other")


def test_locks_hold_in_flag_only(spark):
    df = spark.createDataFrame([("M", "i", 1.0)], "M string, IC string, Current_Pipeline double")
    q = spark.createDataFrame([("M", 0, 9.0), ("i", 1, 9.0)], "node string, level int, quota double")
    assert as_dict(P.adjust(df, ["M", "IC"], q, {}, locks={"M": 4.0}), "node", "adjusted") == {"M": 4.0, "i": 9.0}


def test_na_is_a_region(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Region,IC,v\nNA,"a, b",1\n,c,NaN\n')
    rows = R.read_csv(spark, f"file://{tmp_path}/x.csv", "Region string, IC string, v double").collect()
    assert [tuple(r) for r in rows] == [("NA", "a, b", 1.0), (None, "c", None)]


def test_mixed_teams_and_refused_graphs(spark):
    links = [("r", "a"), ("r", "x"), ("a", "y"), ("a", "z")]
    e = spark.createDataFrame(links, "parent string, child string")
    caps = spark.createDataFrame([("x", 50.0), ("y", 100.0), ("z", 50.0)], "node string, capacity double")
    q = as_dict(Q.cascade_graph(e, caps, 1000, "r", 1.1, {"x": 1.0}), "node", "quota")
    assert {k: round(v, 6) for k, v in q.items()} == {"r": 1000, "a": 825, "x": 275, "y": 605, "z": 302.5}
    with pytest.raises(ValueError, match="circle"):
        Q.cascade_graph(spark.createDataFrame([("p", "q"), ("q", "p"), ("r", "x")], e.schema), caps, 1000, "r")


def test_vendor_and_sector_names(spark):
    from quorial.operators import contracts as K

    df = spark.createDataFrame([("Carahsoft Technology", "Dept. of the Army"), ("Dell", "Health"), (None, None)], "v string, a string")
    assert [tuple(r) for r in df.select(K.vendor_type(F.col("v")), K.sector(F.col("a"))).collect()] == [("VAR", "DoD"), ("Direct", "Civilian"), ("Direct", "Civilian")]
