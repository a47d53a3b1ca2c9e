"""Territories, contracts and churn on hand-computed inputs."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorial.operators import contracts as K
from quorial.operators import learning as L
from quorial.operators import survival as S
from quorial.operators import territory as T
from quorial.streaming.closes import windowed_bias


def accounts(spark, values, bucket="B"):
    return spark.createDataFrame([(f"A{i + 1}", f"n{i + 1}", bucket, v) for i, v in enumerate(values)], "Account_ID string, Account_Name string, Region string, Estimated_TAM double")


def test_buckets(spark):
    df = spark.createDataFrame([("AMER", "SMB", 1.0), ("AMER", "SMB", 2.0), ("EMEA", "SMB", 3.0), ("EMEA", "Ent", 4.0), (None, "SMB", 5.0)], "r string, s string, Estimated_TAM double")
    assert {(r.bucket, r.accounts, r.total) for r in T.bucket_summary(df, ["r", "s"]).collect()} == {("AMER_SMB", 2, 3.0), ("EMEA_SMB", 1, 3.0), ("EMEA_Ent", 1, 4.0)}
    with pytest.raises(ValueError):
        T.bucketed(df, ["x"])


def test_allocation(spark):
    even = T.allocate(accounts(spark, [100.0] * 6), ["Region"], 2)
    assert {r.Territory_ID: r["count"] for r in even.groupBy("Territory_ID").count().collect()} == {"B_Territory_1": 3, "B_Territory_2": 3}
    out = {r.Account_ID: r.Territory_ID[-1] for r in T.allocate(accounts(spark, [10.0, 9.0, 8.0, 1.0]), ["Region"], 2).collect()}
    assert out == {"A1": "1", "A2": "2", "A3": "2", "A4": "1"}
    one = T.allocate(accounts(spark, [1.0, None]), ["Region"], 1, locks={"A1": "X"})
    assert {r.Territory_ID for r in one.collect()} == {"B_Territory_1"}


def test_locks_name_a_territory(spark):
    values, locks = [50.0, 40.0, 30.0, 20.0, 10.0], {"A2": "Named"}
    out = {r.Account_ID: r.Territory_ID for r in T.allocate(accounts(spark, values), ["Region"], 2, locks=locks).collect()}
    heap = [(0.0, 0), (0.0, 1), (40.0, 2)]
    names = ["B_Territory_1", "B_Territory_2", "Named"]
    heapq.heapify(heap)
    want = {"A2": "Named"}
    for i in (0, 2, 3, 4):
        t, k = heap[0]
        want[f"A{i + 1}"] = names[k]
        heapq.heapreplace(heap, (t + values[i], k))
    assert out == want


def test_staffing(spark):
    df = spark.createDataFrame([(f"T{i}",) for i in range(1, 6)], "Territory_ID string")
    sellers = T.staff(df, {"AE": 1.0, "SE": 2.0, "BDR": 0.5, "VP": 5.0})
    n = {r.Role: r.n for r in sellers.groupBy("Role").agg(F.count_distinct("Seller_ID").alias("n")).collect()}
    assert n == {"AE": 5, "SE": 3, "BDR": 10, "VP": 1}
    wide = T.roster(sellers, ["AE", "SE", "BDR", "VP"])
    assert wide.columns == ["Territory_ID", "AE", "BDR", "SE", "VP"] and all(", " in r.BDR for r in wide.collect())
    assert T.export_hierarchy(wide, ["VP", "AE"]).columns == ["Global", "VP", "AE", "Territory_ID"]
    with pytest.raises(ValueError):
        T.export_hierarchy(wide, ["CEO"])
    with pytest.raises(ValueError):
        T.staff(df, {"X": 0.0})


def test_suggestions(spark):
    start = accounts(spark, [100.0] * 6).withColumn("Territory_ID", F.when(F.col("Account_ID") <= "A3", "T1").otherwise("T2"))
    moved, log = T.move_accounts(start, [("A1", "T2")])
    assert [tuple(r) for r in log.collect()] == [(0, "A1", "T1", "T2", 100.0)]
    out = T.suggest(moved, "T2", "T1", moved=log).collect()
    assert [(r.kind, r.delta) for r in out] == [("single", 200.0)] * 3 + [("pair", 0.0)] * 2
    less = T.suggest(moved, "T2", "T1", excluded=["A4"], moved=log).collect()
    assert [[a.account_id for a in r.accounts] for r in less] == [["A5"], ["A6"], ["A5", "A6"]]
    with pytest.raises(ValueError):
        T.move_accounts(start, [("A9", "T2")])
    with pytest.raises(ValueError):
        T.suggest(moved, "T9", "T1")


def test_generator(spark):
    df = T.generate_accounts(spark, 5000).toPandas()
    assert df.shape == (5000, 13) and df["Account_ID"].is_unique
    for column, shares in (("Account_Segment", T.ACCOUNT_SEGMENTS), ("Region", T.ACCOUNT_REGIONS)):
        assert df[column].value_counts(normalize=True).to_dict() == pytest.approx({k: v[0] for k, v in shares.items()}, abs=0.03)
    for region, (_, parts) in T.ACCOUNT_REGIONS.items():
        assert set(df[df["Region"] == region]["Sub_Region"]) == set(parts)
    for segment, (_, _, _, mean, spread, value) in T.ACCOUNT_SEGMENTS.items():
        own = df[df["Account_Segment"] == segment]
        assert own["Estimated_TAM"].between(0.5 * value, 2.5 * value).all()
        assert np.log(own["Annual_Revenue"]).median() == pytest.approx(mean, abs=0.15)
    assert (df["Historical_Spend"] > 0).mean() == pytest.approx(0.4, abs=0.03)
    assert df["Existing_Relationship_Rep_ID"].notna().mean() == pytest.approx(0.1, abs=0.02)
    assert df["G2_Intent_Score"].mean() == pytest.approx(50, abs=1.5) and df["Employee_Count"].min() >= 10
    assert sorted(map(repr, T.generate_accounts(spark, 5000).repartition(7).take(1))) and T.generate_accounts(spark, 0).count() == 0


def test_box_and_points(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 100)] + [(None, 5), ("b", None)], "g string, duration int")
    out = {r.g: r for r in K.box(df, "g").collect()}
    assert tuple(out["a"]) == ("a", 2.0, 3.0, 4.0, 1.0, 4.0, 1) and out[None].low == 5.0 and "b" not in out
    points = K.share_lasting(df, "g", [3, 50]).collect()
    assert {(r.g, r.threshold): (r.n, r.share) for r in points} == {("a", 3): (5, 0.6), ("a", 50): (5, 0.2), (None, 3): (1, 1.0), (None, 50): (1, 0.0)}


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "x", 3), (2, "y", 4), (3, None, 3), (4, "z", None)], "id int, c string, n int")
    out, names = S.one_hot(df, ["c", "n"], df.where("id < 4"))
    assert names == ["c_0", "c_1", "n_0", "n_1"]
    assert {r.id: tuple(r[n] for n in names) for r in out.collect()} == {1: (1, 0, 1, 0), 2: (0, 1, 0, 1), 3: (0, 0, 1, 0), 4: (0, 0, 0, 0)}
    with pytest.raises(ValueError):
        S.one_hot(df, ["c"], most=2)


def test_contract_expressions(spark):
    raw = spark.createDataFrame([("a", 1, "ACME Resell", "Army", "2020-10-01", "2021-10-01", "5"), ("b", 1, None, None, "x", "2021-01-01", "?"), ("c", 1, "Z", "Health", "2020-09-30", "2020-09-01", "1")], "award_id string, line int, vendor string, agency string, start string, end string, amount string")
    t = K.typed(raw)
    assert [r.award_id for r in K.clean(t).collect()] == ["a"]
    r = t.select(K.fiscal_year(F.col("start")).alias("fy"), K.vendor_type(F.col("vendor"), ["resell"]).alias("v"), K.sector(F.col("agency"), ["ARMY"]).alias("s")).collect()
    assert [tuple(x) for x in r] == [(2021, "VAR", "DoD"), (None, "Direct", "Civilian"), (2020, "Direct", "Civilian")]


def test_kaplan_meier(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (4, 0)], "time_to_event int, event_observed int")
    s = {r.time: r.survival for r in S.kaplan_meier(df).collect()}
    assert [s[1], s[2]] == [0.8, 0.8] and s[3] == pytest.approx(0.8 / 3) and s[4] == pytest.approx(0.8 / 3)


def test_concordance_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    tables = [[(rng.randint(1, 6), rng.randint(0, 1), float(rng.randint(0, 4))) for _ in range(60)], [(rng.randint(1, 400), rng.randint(0, 1), rng.choice([rng.random(), 0.5])) for _ in range(700)]]
    for data in tables:
        df = spark.createDataFrame([*data, (None, 1, 0.5), (3, None, 0.5), (3, 1, None)], "time_to_event int, event_observed int, risk double")
        c = d = t = 0
        for t1, e1, r1 in data:
            for t2, e2, r2 in data:
                if e1 and (t1 < t2 or (t1 == t2 and not e2)):
                    c, d, t = c + (r1 > r2), d + (r1 < r2), t + (r1 == r2)
        r = S.concordance(df, "risk").first()
        assert (r.concordant, r.discordant, r.tied) == (c, d, t)
    assert S.concordance(df.limit(0), "risk").first().c_index is None


def test_concordance_of_one_risk_and_of_one_time(spark):
    """A constant risk, and a constant time, are no group of their own: no task orders
    them, and Python gets no rows."""
    base = spark.range(900).select((F.col("id") % 300).cast("int").alias("t"), (F.col("id") % 2).cast("int").alias("event_observed"), (F.col("id") % 7).cast("double").alias("x"))
    one_risk = base.select(F.col("t").alias("time_to_event"), "event_observed", F.lit(0.5).alias("risk"))
    r = S.concordance(one_risk, "risk").first()
    rows = [tuple(x) for x in one_risk.collect()]
    want = sum(e and (t < u or (t == u and not f)) for t, e, _ in rows for u, f, _ in rows)
    assert (r.concordant, r.discordant, r.tied, r.c_index) == (0, 0, want, 0.5)
    one_time = base.select(F.lit(3).alias("time_to_event"), "event_observed", F.col("x").alias("risk"))
    r = S.concordance(one_time, "risk").first()
    rows = [tuple(x) for x in one_time.collect()]
    pairs = [(x, y) for _, e, x in rows for _, f, y in rows if e and not f]
    assert (r.concordant, r.discordant, r.tied) == (sum(x > y for x, y in pairs), sum(x < y for x, y in pairs), sum(x == y for x, y in pairs))
    plan = S.concordance(one_risk, "risk")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_running_totals_over_many_ranges(spark):
    import itertools

    data = [(g, t, (t * 7) % 5 + g) for g in range(2) for t in range(600)]
    df = S._ranges(spark.createDataFrame(data, "g int, t int, v int"), "t")
    assert df.select("_range").distinct().count() > 100
    for later in (False, True):
        got = {(r.g, r.t): r.s for r in S.running(df, "t", {"s": F.col("v")}, ["g"], later).collect()}
        for g in range(2):
            own = [v for h, _, v in data if h == g]
            sums = list(itertools.accumulate(own[::-1] if later else own))
            assert [got[g, t] for t in range(600)] == (sums[::-1] if later else sums)


def test_survival_trees_against_plain_sums():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(20, 90))
        t, e = rng.integers(1, 12, n).astype(float), rng.integers(0, 2, n)
        left = rng.random(n) < 0.5
        grid = np.unique(np.r_[t[e == 1], rng.integers(1, 12, 5)])
        d = np.array([((t == g) & (e == 1)).sum() for g in grid])
        y = np.array([(t >= g).sum() for g in grid])
        hazard = np.cumsum(np.divide(d, y, out=np.zeros(len(grid)), where=y > 0)).sum()
        assert L._hazard(t, e, np.array([(grid >= x).sum() for x in t], float)) == pytest.approx(hazard)
        y1, d1 = np.array([(t[left] >= g).sum() for g in grid]), np.array([((t == g) & (e == 1) & left).sum() for g in grid])
        ok = y > 1
        var = (y1[ok] / y[ok] * (1 - y1[ok] / y[ok]) * (y[ok] - d[ok]) / (y[ok] - 1) * d[ok]).sum()
        assert L._log_rank(t, e, left) == pytest.approx(abs((d1[ok] - y1[ok] * d[ok] / y[ok]).sum()) / np.sqrt(var))
    x = rng.random((400, 2))
    tree = L._grow(x, np.ceil(20 * x[:, 0]), np.ones(400, int), np.ones(400), np.random.default_rng(1), 10, 15, None)
    packed = tuple(np.array(c) for c in zip(*tree, strict=True))
    for row, value in zip(x, L._fall(packed, x), strict=True):
        node = tree[0]
        while node[0] >= 0:
            node = tree[node[2] if row[node[0]] <= node[1] else node[3]]
        assert node[1] == value


def test_cox_equals_a_dense_newton(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(250, 2))
    t = rng.exponential(np.exp(-0.5 * x[:, 0] + 0.3 * x[:, 1]))
    e = rng.integers(0, 2, 250)
    df = spark.createDataFrame([(float(a), int(b), float(c), float(d)) for a, b, (c, d) in zip(t, e, x, strict=True)], "time_to_event double, event_observed int, a double, b double")
    beta = np.zeros(2)
    for _ in range(30):
        g, h = -0.01 * beta, -0.01 * np.eye(2)
        for i in np.flatnonzero(e):
            risk = t >= t[i]
            w = np.exp(x[risk] @ beta)
            m = (w[:, None] * x[risk]).sum(0) / w.sum()
            g = g + x[i] - m
            h = h - ((w[:, None, None] * x[risk][:, :, None] * x[risk][:, None, :]).sum(0) / w.sum() - np.outer(m, m))
        beta = beta - np.linalg.solve(h, g)
    assert S.cox(df, ["a", "b"]) == pytest.approx(beta, abs=1e-5)


def test_cox_with_many_features(spark):
    """18 features, of which one-hot ones add up to one, and ties, against dense Newton."""
    import numpy as np

    rng = np.random.default_rng(9)
    n = 600
    kinds = [rng.integers(0, k, n) for k in (5, 3, 4, 3)]
    x = np.column_stack([rng.normal(size=(n, 3)), *[np.eye(k)[c] for k, c in zip((5, 3, 4, 3), kinds, strict=True)]])
    t = np.ceil(rng.exponential(12 * np.exp(-0.6 * x[:, 0] + 0.4 * x[:, 4])))
    e = rng.integers(0, 2, n)
    names = [f"f{i}" for i in range(18)]
    df = spark.createDataFrame([(float(a), int(b), *map(float, r)) for a, b, r in zip(t, e, x, strict=True)], "time_to_event double, event_observed int, " + ", ".join(f"{c} double" for c in names))
    beta = np.zeros(18)
    for _ in range(30):
        g, h, w = x[e == 1].sum(0) - 0.01 * beta, -0.01 * np.eye(18), np.exp(x @ beta)
        for u in np.unique(t[e == 1]):
            risk, d = t >= u, ((t == u) & (e == 1)).sum()
            m = w[risk] @ x[risk] / w[risk].sum()
            g = g - d * m
            h = h - d * ((x[risk] * w[risk][:, None]).T @ x[risk] / w[risk].sum() - np.outer(m, m))
        beta = beta - np.linalg.solve(h, g)
    assert S.cox(df, names) == pytest.approx(beta, abs=1e-5)
    with pytest.raises(ValueError, match="did not settle"):
        S.cox(df, names[:2], steps=1)


def test_auc_is_the_share_of_ordered_pairs(spark):
    data = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)]
    pairs = [(p > n) + (p == n) / 2 for p, y in data if y for n, z in data if not z]
    df = spark.createDataFrame(data, "s double, event_observed int")
    assert S.roc_auc(df, "s").first().auc == pytest.approx(sum(pairs) / len(pairs), abs=1e-6)


def test_cox_finds_the_sign_and_zero_gradient(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    t = np.ceil(rng.exponential(10 * np.exp(-0.8 * x))).astype(int) + 1
    df = spark.createDataFrame([(int(a), int(a < 25), float(b)) for a, b in zip(t, x, strict=True)], "time_to_event int, event_observed int, x double")
    beta = S.cox(df, ["x"])
    assert 0.5 < beta[0] < 1.2
    g = -0.01 * beta[0]
    e = t < 25
    for u in np.unique(t[e]):
        risk = t >= u
        w = np.exp(beta[0] * x[risk])
        g += x[(t == u) & e].sum() - ((t == u) & e).sum() * (w * x[risk]).sum() / w.sum()
    assert abs(g) < 1e-4


def test_importances_sum_to_one(spark):
    df = spark.range(200).select((F.col("id") % 7).cast("double").alias("a"), F.rand(1).alias("b"), ((F.col("id") % 7) > 3).cast("double").alias("label"))
    v = L.forest_importance(df, ["a", "b"], "label", trees=10)
    assert sum(v) == pytest.approx(1) and v[0] > v[1]


def test_survival_forest_orders_risk(spark):
    df = spark.range(240).select(F.col("id").alias("account_id"), (F.col("id") % 2).cast("double").alias("x"), F.rand(2).alias("noise"), F.when(F.col("id") % 2 == 1, 2 + F.col("id") % 3).otherwise(20 + F.col("id") % 5).cast("int").alias("time_to_event"), F.lit(1).alias("event_observed"))
    out = L.survival_forest(df, ["x", "noise"], trees=6).groupBy((F.col("account_id") % 2).alias("x")).agg(F.avg("risk").alias("r"))
    r = {x.x: x.r for x in out.collect()}
    assert r[1] > r[0]


def test_bias_over_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "m", 10.0, 15.0), ("2024-01-02 00:00:00", "m", 10.0, 5.0), ("2024-03-09 00:00:00", "m", 0.0, 5.0)], "t string, Manager_ID string, commit double, closed double").withColumn("t", F.to_timestamp("t"))
    path = f"file://{tmp_path}/closes"
    df.write.parquet(path)
    stream = windowed_bias(spark.readStream.schema(df.schema).parquet(path), "t")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("closes_bias").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((str(r.window.start), r.bias) for r in spark.table("closes_bias").collect())
    assert got == sorted((str(r.window.start), r.bias) for r in windowed_bias(df, "t").collect()) and [b for _, b in got] == [1.0, 1.0]


def test_logistic_baseline_equals_newton(spark):
    """The same split, scaling and categories, fitted by Newton's method in numpy."""
    import numpy as np

    rng = np.random.default_rng(4)
    n = 500
    a, b, c = rng.normal(3, 2, n), rng.normal(size=n), rng.integers(0, 3, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * (a - 3) - b + 0.7 * c - 0.7)))).astype(int)
    rows = [(f"k{i}", float(a[i]), float(b[i]), "xyz"[c[i]], int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "account_id string, a double, b double, c string, event_observed int")
    got = L.churn_baseline(df, ["a", "b"], ["c"], "logistic").first()
    test = {r.account_id for r in S.split(df.withColumn("label", F.col("event_observed").cast("double")), "account_id", 0.2, "label").where("is_test").collect()}
    held = np.array([f"k{i}" in test for i in range(n)])
    z = np.column_stack([a, b])
    x = np.column_stack([(z - z[~held].mean(0)) / z[~held].std(0), np.eye(3)[c], np.ones(n)])
    price = np.r_[np.full(5, 1.0), 0.0]
    w = np.zeros(6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x[~held] @ w))
        slope = x[~held].T @ (p - y[~held]) + price * w
        w -= np.linalg.solve((x[~held] * (p * (1 - p))[:, None]).T @ x[~held] + np.diag(price) + 1e-9 * np.eye(6), slope)
    score = x[held] @ w
    pos, neg = score[y[held] == 1], score[y[held] == 0]
    auc = ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()
    assert got.n_test == held.sum() and got.auc == pytest.approx(auc, abs=0.003)


def test_trees_over_cells_equal_trees_over_rows(spark):
    """With all features tried and no draws, a tree over counted cells is MLlib's over rows."""
    import numpy as np
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 20, 2000), rng.integers(0, 7, 2000), rng.integers(0, 2, 2000)
    y = (rng.random(2000) < 0.2 + 0.02 * a + 0.3 * ((b > 3) ^ (c > 0))).astype(int)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, y, 1.0 + 2 * y, strict=True)], "a double, b double, c double, y double, w double")
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = DecisionTreeClassifier(labelCol="y", weightCol="w", maxDepth=6).fit(rows)
    want = {(r.a, r.b, r.c): r.p for r in model.transform(rows).select("a", "b", "c", vector_to_array("probability")[1].alias("p")).distinct().collect()}
    x = np.array(sorted(want), int)
    n = np.array([[((a == i) & (b == j) & (c == k) & (y == v)).sum() for v in (0, 1)] for i, j, k in x], float)
    share, gains = L._gini_tree(x, n, np.array([1.0, 3.0]), rng, 3, 6)
    assert share == pytest.approx([want[tuple(map(float, r))] for r in x])
    assert gains / gains.sum() == pytest.approx(model.featureImportances.toArray())


def test_forest_work_does_not_grow_with_rows(spark):
    """Trees see counted cells: ten times the rows give as many cells, and near scores."""
    import numpy as np

    one = spark.range(4000).select(F.col("id").alias("account_id"), (F.col("id") * 7919 % 1009).cast("double").alias("a"), F.concat(F.lit("k"), F.col("id") % 3).alias("c"), ((F.col("id") * 7919 % 1009 > 500) != (F.col("id") % 5 == 0)).cast("int").alias("event_observed"))
    ten = one.crossJoin(spark.range(10).select(F.col("id").alias("i"))).withColumn("account_id", F.col("account_id") + 4000 * F.col("i")).drop("i")
    seen, kept = [], L._each_tree

    def counted(cells, *more):
        seen.append(cells.count())
        return kept(cells, *more)

    L._each_tree = counted
    try:
        small, large = (L.churn_baseline(d, ["a"], ["c"], "forest", trees=10).first() for d in (one, ten))
    finally:
        L._each_tree = kept
    assert seen[0] <= 96 and seen[1] <= 96 and abs(large.n_test - 8000) < 3
    assert np.isclose(small.auc, large.auc, atol=0.03) and large.auc > 0.7


def test_grid_counts_all_rows_once(spark):
    """All forests of the grid grow from one table of counts, which has every training row."""
    days = [(i, 1, f"v{i % 60}", "NATION_1" if i % 4 else "NATION_9", float(i % 997), (i * 31) % 2000) for i in range(3000)]
    df = spark.createDataFrame(days, "award_id long, line int, vendor string, agency string, amount double, duration int")
    seen, kept = [], L._each_tree

    def counted(cells, *more):
        seen.append({r.forest: r.n for r in cells.groupBy("forest").agg(F.sum(F.col("n0") + F.col("n1")).alias("n")).collect()})
        return kept(cells, *more)

    L._each_tree = counted
    try:
        out = L.importance_grid(df, ["NATION_1"], [365, 1095, 9999], (10, 25), trees=5).collect()
    finally:
        L._each_tree = kept
    assert seen == [dict.fromkeys(range(4), 2250)]  # no contract lasts 9,999 days
    sums = {}
    for r in out:
        sums[r.threshold, r.tier] = sums.get((r.threshold, r.tier), 0) + r.importance
    assert sorted(sums) == [(365, 10), (365, 25), (1095, 10), (1095, 25)] and all(v == pytest.approx(1) for v in sums.values())


def test_sector_forests_grow_together(spark):
    rows = [(f"v{i % 40}", "NATION_1" if i % 2 else "NATION_9", float(i % 97), 2000 if i % 97 > 48 else 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "vendor string, agency string, amount double, duration int")
    seen, kept = [], L._each_tree
    L._each_tree = lambda cells, *more: (seen.append(cells.agg(F.sum(F.col("n0") + F.col("n1"))).first()[0]), kept(cells, *more))[1]
    try:
        out = {(r.sector, r.feature): r.importance for r in L.importance_by_sector(df, ["NATION_1"], trees=5).collect()}
    finally:
        L._each_tree = kept
    assert seen == [2000] and len(out) == 4 and all(out[s, "amount"] > 0.9 for s in ("DoD", "Civilian"))


def _contract_frame(spark):
    rows = [(i // 3, i % 3, f"v{i % 57}", "NATION_1" if i % 4 else "NATION_9", float(i * 17 % 21), (i * 31) % 2000) for i in range(6000)]
    return spark.createDataFrame(rows, "award_id long, line int, vendor string, agency string, amount double, duration int")


def _watched(run):
    """What ``run`` gives, the rows that it wrote as tables by name, and the cells of its trees."""
    tables, cells, write, grow = {}, [], L.written, L._each_tree

    def counted(df, name):
        out = write(df, name)
        tables[name] = tables.get(name, 0) + out.count()
        return out

    def kept(df, *more):
        cells.extend(map(tuple, df.select(*sorted(df.columns)).collect()))
        return grow(df, *more)

    L.written, L._each_tree = counted, kept
    try:
        return run(), tables, sorted(cells)
    finally:
        L.written, L._each_tree = write, grow


def test_grid_writes_rows_once(spark):
    """What forests train on is the plain split's three quarters, and is not written again."""
    from quorial.operators import contracts as K
    from quorial.operators import survival as S

    df = _contract_frame(spark)
    out, tables, cells = _watched(lambda: L.importance_grid(df, ["NATION_1"], [1825, 365], (10, 25), trees=3).collect())
    assert len(out) == 12 and sum(n for n in tables.values() if n > 1000) == 6000
    plain = S.split(K.with_tiers(df, (10, 25)).withColumn("key", F.concat_ws("/", "award_id", "line")), "key", 0.25).where("NOT is_test").collect()
    assert len(plain) == 4500
    want = {}
    for r in plain:
        for i, (days, top) in enumerate((d, t) for d in (1825, 365) for t in (r.is_top_10, r.is_top_25)):
            n = want.setdefault((int(r.amount), int(top), int(r.agency == "NATION_1"), i), [0, 0])
            n[r.duration >= days] += 1
    assert cells == sorted((*k, *n) for k, n in want.items())


def test_sectors_are_read_together(spark):
    """One look at the contracts each for vendors, bins and cells, with tiers within sectors."""
    rows = [(f"v{i % 57}", "NATION_1" if i % 4 else "NATION_9", float(i * 7919 % 3001) + i % 57, (i * 31) % 2000) for i in range(6000)]
    df = spark.createDataFrame(rows, "vendor string, agency string, amount double, duration int")
    read, write = spark.sparkContext.accumulator(0), L.written

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    def watched(table, name):
        out = write(table, name)
        if name != "contracts":
            return out
        back = out.mapInArrow(seen, out.schema)
        back.written_to = out.written_to
        return back

    L.written = watched
    try:
        out, _, cells = _watched(lambda: L.importance_by_sector(df, ["NATION_1"], trees=3).collect())
        looks = read.value - 6000  # ``_watched`` counts the table as well
    finally:
        L.written = write
    assert len(out) == 4 and looks == 3 * 6000
    want = {}
    for k in (0, 1):
        own, sums = [r for r in rows if (r[1] == "NATION_9") == bool(k)], {}
        for r in own:
            sums[r[0]] = sums.get(r[0], 0) + r[2]
        best = sorted(sums, key=lambda v: (-sums[v], v))[:10]
        for r in own:
            n = want.setdefault((int(r[0] in best), k), [0, 0])
            n[r[3] >= 1825] += 1
    got = {}
    for _, top, k, *n in cells:
        got[top, k] = [x + y for x, y in zip(got.get((top, k), (0, 0)), n, strict=True)]
    assert got == want and {c[0] for c in cells} == set(range(32))


def test_bins_are_compiled(spark):
    """Bins are the counts of borders under a value, by conditions without a lambda."""
    values = [float("-inf"), -1.0, 0.0, 0.5, 1.0, 2.0, 7.5, 8.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for borders in ([], [0.0], [0.0, 1.0], [-1.0, 0.5, 2.0, 7.5, 8.0], [i / 4 for i in range(31)]):
        out = df.select("x", L._bin("x", borders).alias("k"))
        assert {r.x: r.k for r in out.collect()} == {v: sum(b < v for b in borders) for v in values}
        assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    for odd in (None, float("nan")):
        with pytest.raises(Exception, match="x has no value"):
            spark.createDataFrame([(odd,)], "x double").select(L._bin("x", [1.0])).collect()


def test_poisson_draws(spark):
    """Draws of a group of trees have the mean and variance that single trees' sum to."""
    u = (F.col("id") + 0.5) / 20_000
    r = spark.range(20_000).select(L._poisson(u, 0.46).alias("k")).agg(F.avg("k").alias("mean"), F.var_pop("k").alias("var")).first()
    assert r["mean"] == pytest.approx(0.46, abs=0.005) and r["var"] == pytest.approx(0.46, abs=0.01)
