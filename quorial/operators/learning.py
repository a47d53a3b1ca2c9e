"""Classifiers and survival forests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lookup
from ..functions.tables import dropped, written
from .contracts import best_vendors, sector, vendor_sums, with_tiers
from .survival import _ranges, beginning, roc_auc, running, split


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Weights ``n / (2 n_class)`` as ``w``."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    total = sum(counts.values())
    w = F.lit(0.0)
    for value, n in counts.items():
        w = F.when(F.col(label) == value, total / (2 * n)).otherwise(w)
    return df.withColumn("w", w)


# --- random forests over cells ----------------------------------------------------

#: Values of a number that trees tell apart, at most: quantiles where it has more.
BINS = 32
#: Cells that a tree is grown from, at most; tables with more of them go to MLlib's trees.
CELLS = 200_000


def _borders(df: DataFrame, columns: list[str], by: str | None = None) -> dict:
    """Per column the values that end its bins, learned from all rows; with ``by``, which has
    few values, this for each of them."""
    shares, out = [i / BINS for i in range(1, BINS)], {}
    rows = df.groupBy(*([by] if by else [])).agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in columns])
    for found in rows.collect():
        own = df.where(F.col(by).eqNullSafe(F.lit(found[by]))) if by else df
        borders = out[found[by] if by else None] = {c: sorted(set(found[c] or [])) for c in columns}
        for c in columns:
            if len(borders[c]) < BINS - 1:  # a frequent value hides others, or there are few
                values = [r[0] for r in own.select(F.col(c).cast("double")).distinct().limit(BINS + 1).collect() if r[0] is not None]
                borders[c] = sorted(values) if len(values) <= BINS else borders[c]
    return out if by else out[None]


def _bin(column: str, borders: list[float]) -> Column:
    """How many borders are under a value; nulls and NaN raise.  Found by halving, as nested
    conditions, which Spark compiles."""
    value = F.col(column).cast("double")

    def under(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > float(borders[middle]), under(middle + 1, high)).otherwise(under(low, middle))

    return F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit(f"{column} has no value")).cast("int")).otherwise(under(0, len(borders)))


def _gini_tree(x: np.ndarray, n: np.ndarray, price: np.ndarray, rng, tried: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """One tree, grown level by level: per cell the share of label 1 in its leaf, and per
    feature the impurity it takes away.

    ``x`` are the bins of cells, ``n`` how often a cell was drawn with either label, and
    ``price`` the weights of the labels.  A node tries ``tried`` features.  As in MLlib, two
    leaves with the same label are merged in the end."""
    cells, p = x.shape
    wide = x.max(0) + 1
    at, rows, here = np.zeros(cells, np.int64), np.arange(cells), np.zeros(cells, np.int64)
    first, counts, told = 0, n.sum(0)[None].astype(float), []
    for level in range(depth + 1):
        m, weight = len(counts), counts * price
        total = weight.sum(1)
        best, feature, cut = 1e-9 * total, np.full(m, -1), np.zeros(m, np.int64)
        if level < depth:
            asked = rng.random((m, p)).argsort(1).argsort(1) < tried
            plain = np.divide((weight**2).sum(1), total, out=np.zeros(m), where=total > 0)
            for f in range(p):
                if wide[f] < 2:
                    continue
                slot = here * wide[f] + x[rows, f]
                left = np.stack([np.bincount(slot, n[rows, c], m * wide[f]).reshape(m, -1) for c in (0, 1)], 2).cumsum(1)[:, :-1]
                right = (counts[:, None] - left) * price
                left = left * price
                ln, rn = left.sum(2), right.sum(2)
                ok = (ln > 0) & (rn > 0) & asked[:, f, None]
                gain = np.divide((left**2).sum(2), ln, out=np.zeros_like(ln), where=ok) + np.divide((right**2).sum(2), rn, out=np.zeros_like(rn), where=ok) - plain[:, None]
                gain[~ok] = 0.0
                most = gain.argmax(1)
                value = gain[np.arange(m), most]
                better = value > best
                best[better], feature[better], cut[better] = value[better], f, most[better]
        split = np.flatnonzero(feature >= 0)
        place = np.full(m, -1)
        place[split] = 2 * np.arange(len(split))
        told.append((weight, feature, best, np.where(place >= 0, first + m + place, -1)))
        if not len(split):
            break
        inner = place[here] >= 0
        rows, here = rows[inner], here[inner]
        here = place[here] + (x[rows, feature[here]] > cut[here])
        at[rows] = first + m + here
        first += m
        counts = np.stack([np.bincount(here, n[rows, c], 2 * len(split)) for c in (0, 1)], 1)
    weight, feature, best, left = (np.concatenate(c) for c in zip(*told, strict=True))
    ends = np.cumsum([len(t[1]) for t in told])
    levels = [np.arange(e - len(t[1]), e) for e, t in zip(ends, told, strict=True)]
    leaf, label = feature < 0, weight[:, 1] > weight[:, 0]
    for ids in levels[::-1]:
        s = ids[~leaf[ids]]
        a = left[s]
        leaf[s[leaf[a] & leaf[a + 1] & (label[a] == label[a + 1])]] = True
    stands = np.arange(len(leaf))
    for ids in levels:
        s = ids[left[ids] >= 0]
        s = s[leaf[stands[s]]]
        stands[left[s]] = stands[left[s] + 1] = stands[s]
    total = weight.sum(1)
    share = np.divide(weight[:, 1], total, out=np.zeros(len(total)), where=total > 0)
    return share[stands[at]], np.bincount(feature[~leaf], best[~leaf], p)


def _each_tree(cells: DataFrame, trees: int, run: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` for each tree of each ``forest`` on the forest's cells, which are bounded by
    bins and categories, whatever the number of rows they count."""
    numbers = cells.sparkSession.range(trees).select(F.col("id").cast("int").alias("tree"))
    return cells.crossJoin(F.broadcast(numbers)).repartition(min(96, 8 * trees), "forest", "tree").groupBy("forest", "tree").applyInPandas(run, schema)


def _drawn(key: tuple, pdf: pd.DataFrame, seed: int) -> tuple[np.ndarray, np.random.Generator]:
    """How often a tree draws the rows of each cell: Poisson draws with mean 1 of n rows
    are one Poisson draw with mean n."""
    rng = np.random.default_rng([seed, int(key[0]), int(key[1])])
    return rng.poisson(pdf[["n0", "n1"]].to_numpy(float)).astype(float), rng


def importances(cells: DataFrame, width: int, trees: int = 100, depth: int = 5, seed: int = 42) -> DataFrame:
    """``forest, feature, importance``: Gini importances of balanced random forests, from
    ``forest, a0, ..., n0, n1``: how many rows have these bins with label 0 and 1."""
    names = [f"a{i}" for i in range(width)]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names)
        n, rng = _drawn(key, pdf, seed)
        all_ = pdf[["n0", "n1"]].to_numpy(float).sum(0)
        _, gains = _gini_tree(pdf[names].to_numpy(np.int64), n, all_.sum() / (2 * np.maximum(all_, 1)), rng, int(np.ceil(np.sqrt(width))), depth)
        return pd.DataFrame({"forest": key[0], "feature": np.arange(width), "part": gains / gains.sum() if gains.sum() > 0 else gains})

    parts = _each_tree(cells, trees, run, "forest int, feature int, part double")
    sums = parts.groupBy("forest", "feature").agg(F.sum("part").alias("part"))
    total = F.sum("part").over(Window.partitionBy("forest"))
    return sums.select("forest", "feature", F.coalesce(F.try_divide("part", total), F.lit(0.0)).alias("importance"))


def _labels(label: Column) -> list[Column]:
    return [F.count_if(~label).alias("n0"), F.count_if(label).alias("n1")]


def forest_importance(df: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 5, seed: int = 42) -> list[float]:
    """Gini importances of a balanced random forest over bins of features.

    More than ``CELLS`` different rows of bins go to MLlib's trees."""
    borders = _borders(df, features)
    cells = df.groupBy(F.lit(0).alias("forest"), *[_bin(c, borders[c]).alias(f"a{i}") for i, c in enumerate(features)]).agg(*_labels(F.col(label) > 0))
    cells = written(cells, "cells")
    if cells.limit(CELLS + 1).count() <= CELLS:
        found = {r.feature: r.importance for r in importances(cells, len(features), trees, depth, seed).collect()}
        dropped(cells)
        return [float(found[i]) for i in range(len(features))]
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(balanced(df, label))
    model = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="w", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)
    return [float(x) for x in model.featureImportances.toArray()]


def _contract_rows(df: DataFrame, defense: list[str], *more: Column | str) -> DataFrame:
    """What importances need of contracts, written once."""
    rows = df.dropna(subset=["duration", "amount"])
    return written(rows.select("vendor", "amount", "duration", sector(F.col("agency"), defense).alias("sector"), *more), "contracts")


def _usable(cells: DataFrame, least: int) -> list[int]:
    """Forests of which at least ``least`` rows, but not all, have label 1."""
    sums = cells.groupBy("forest").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where((F.col("n1") >= least) & (F.col("n0") > 0))
    return [r.forest for r in sums.collect()]


def importance_grid(df: DataFrame, defense: list[str], thresholds: list[int], tiers: tuple[int, ...] = (10, 25, 50), trees: int = 100, least: int = 10) -> DataFrame:
    """``threshold, tier, feature, importance``: how amount, vendor tier and sector tell
    contracts that last.  Trains on three quarters of the rows; grid cells with too few
    of one class are left out.

    The contracts are written once, with the beginnings of their hashes; what is trained on
    is not.  It is counted once by bin of the amount, tiers, sector and thresholds reached;
    all forests of the grid grow from these counts, side by side."""
    key = F.concat_ws("/", F.col("award_id").cast("string"), F.col("line").cast("string"))
    base = _contract_rows(df, defense, "award_id", "line", beginning(key).alias("start"))
    flags = [f"is_top_{t}" for t in tiers]
    train = split(base, key, 0.25, start="start").where(~F.col("is_test"))
    cut = _borders(train, ["amount"])["amount"]
    reached = [F.col("duration") >= days for days in thresholds]
    counts = with_tiers(train, tiers, base).groupBy(_bin("amount", cut).alias("amount"), (F.col("sector") == "DoD").cast("int").alias("dod"), *[F.col(c).cast("int").alias(c) for c in flags], F.array(*reached).alias("reached")).agg(F.count("*").alias("n"))
    counts = written(counts, "counts")
    grid = [(days, t) for days in thresholds for t in tiers]
    each = F.array(*[F.struct(F.lit(i).alias("forest"), F.col(f"is_top_{t}").alias("a1"), F.col("reached")[thresholds.index(days)].alias("lasts")) for i, (days, t) in enumerate(grid)])
    cells = counts.select("amount", "dod", "n", F.explode(each).alias("c")).groupBy("c.forest", F.col("amount").alias("a0"), "c.a1", F.col("dod").alias("a2"))
    cells = written(cells.agg(*[F.sum(F.when(F.col("c.lasts") == side, F.col("n")).otherwise(0)).alias(f"n{int(side)}") for side in (False, True)]), "cells")
    dropped(base)
    good = _usable(cells, least)
    found = importances(cells.where(F.col("forest").isin(good)), 3, trees)
    names = df.sparkSession.createDataFrame([(i, days, t, f, n) for i, (days, t) in enumerate(grid) for f, n in enumerate(("amount", "top", "dod"))], "forest int, threshold int, tier int, feature int, name string")
    return found.join(F.broadcast(names), ["forest", "feature"]).select("threshold", "tier", F.col("name").alias("feature"), "importance")


def importance_by_sector(df: DataFrame, defense: list[str], days: int = 1825, tier: int = 10, trees: int = 100) -> DataFrame:
    """``sector, feature, importance``, with the tier found within each sector.  Both sectors'
    vendors, bins and cells come from one look each at the contracts."""
    base, sectors = _contract_rows(df, defense), ("DoD", "Civilian")
    sums = written(vendor_sums(base, "sector"), "sums")
    dod, civilian = (best_vendors(sums.where(F.col("sector") == s), tier).select(F.lit(s).alias("_s"), F.col("vendor").alias("_v")) for s in sectors)
    tiered = base.join(F.broadcast(dod.union(civilian)), (F.col("sector") == F.col("_s")) & (F.col("vendor") == F.col("_v")), "left")
    place = F.lit(None).cast("int")
    for name, cut in _borders(base, ["amount"], "sector").items():
        place = F.when(F.col("sector") == name, _bin("amount", cut["amount"])).otherwise(place)
    forest = lookup(F.col("sector"), {s: i for i, s in enumerate(sectors)})
    cells = tiered.groupBy(forest.alias("forest"), place.alias("a0"), F.col("_v").isNotNull().cast("int").alias("a1")).agg(*_labels(F.col("duration") >= days))
    cells = written(cells, "cells")
    dropped(base, sums)
    found = importances(cells.where(F.col("forest").isin(_usable(cells, 5))), 2, trees)
    names = df.sparkSession.createDataFrame([(i, s, f, n) for i, s in enumerate(sectors) for f, n in enumerate(("amount", "top"))], "forest int, sector string, feature int, name string")
    return found.join(F.broadcast(names), ["forest", "feature"]).select("sector", F.col("name").alias("feature"), "importance")


def _cell_scores(rows: DataFrame, numeric: list[str], categorical: list[str], label: str, trees: int, depth: int, seed: int = 42) -> DataFrame | None:
    """``label, score`` of the rows that are ``is_test``, from a forest grown over cells of
    the others; None where there are more than ``CELLS`` cells."""
    train = rows.where(~F.col("is_test"))
    borders = _borders(train, numeric)
    kinds = {c: sorted(r[0] for r in train.where(F.col(c).isNotNull()).select(c).distinct().limit(1_001).collect()) for c in categorical}
    if any(len(k) > 1_000 for k in kinds.values()):
        return None
    place = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(k) for k in kinds[c]]), F.col(c)), F.lit(0)).cast("int")
    columns = [_bin(c, borders[c]) for c in numeric] + [place(c) for c in categorical]
    names = [f"a{i}" for i in range(len(columns))]
    placed = rows.withColumns(dict(zip(names, columns, strict=True)))
    held = F.col("is_test")
    cells = placed.groupBy(F.lit(0).alias("forest"), *names).agg(*[F.count_if(~held & (F.col(label) == v)).alias(f"n{v}") for v in (0, 1)], F.count_if(held).alias("tests"))
    cells = written(cells, "cells")
    if cells.limit(CELLS + 1).count() > CELLS:
        dropped(cells)
        return None
    hot = [(i, k) for i, c in enumerate(categorical, len(numeric)) for k in range(1, len(kinds[c]) + 1)]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names)
        n, rng = _drawn(key, pdf, seed)
        a = pdf[names].to_numpy(np.int64)
        x = np.column_stack([a[:, : len(numeric)], *[(a[:, i] == k).astype(np.int64) for i, k in hot]])
        pdf["score"] = _gini_tree(x, n, np.ones(2), rng, int(np.ceil(np.sqrt(x.shape[1]))), depth)[0]
        return pdf.loc[pdf["tests"] > 0, [*names, "score"]]

    grown = _each_tree(cells, trees, run, ", ".join(f"{c} int" for c in names) + ", score double")
    # rounded, as sums of equal shares depend on their order in the last digits
    scores = grown.groupBy(*names).agg(F.round(F.avg("score"), 12).alias("score"))
    return placed.where(held).join(F.broadcast(scores), names).select("label", "score")  # at most CELLS rows


def churn_baseline(df: DataFrame, numeric: list[str], categorical: list[str], kind: str, label: str = "event_observed", key: str = "account_id", trees: int = 100) -> DataFrame:
    """``model, n_test, auc`` on a stratified fifth, for ``logistic`` or ``forest``.

    Features are learned from the training rows only; categories not met there are all
    zeros.  The forest grows over cells of equal bins and categories.
    """
    rows = written(split(df.withColumn("label", F.col(label).cast("double")), key, 0.2, "label"), "churn")
    scored = _cell_scores(rows, numeric, categorical, "label", trees, 30) if kind == "forest" else None
    if scored is None:
        scored = _fitted_scores(rows, numeric, categorical, kind, trees)
    scored = written(scored, "scores")
    out = roc_auc(scored, "score", "label").crossJoin(scored.agg(F.count("*").alias("n_test")))
    return out.select(F.lit(kind).alias("model"), "n_test", "auc")


def _fitted_scores(rows: DataFrame, numeric: list[str], categorical: list[str], kind: str, trees: int) -> DataFrame:
    """``label, score`` by MLlib's models."""
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    n = train.count()
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in categorical]
    encoder = OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical], dropLast=True)
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in numeric], *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric]).first()
    scaled = lambda d: d.withColumns({f"{c}_z": (F.col(c) - (stats[f"m_{c}"] or 0.0)) / (stats[f"s_{c}"] or 1.0) for c in numeric})
    vector = VectorAssembler(inputCols=[f"{c}_z" for c in numeric] + [f"{c}_v" for c in categorical], outputCol="features")
    if kind == "logistic":
        model = LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=1000)
    else:
        # 30 levels are the most that these trees can have
        model = RandomForestClassifier(numTrees=trees, maxDepth=30, seed=42, maxMemoryInMB=512)
    fitted = Pipeline(stages=[*indexers, encoder, vector, model]).fit(scaled(train))
    return fitted.transform(scaled(test)).select("label", vector_to_array("probability")[1].alias("score"))


# --- random survival forest -------------------------------------------------------


def _at_risk(time: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different event times, with the events at and the rows at risk at each."""
    times, deaths = np.unique(time[event == 1], return_counts=True)
    return times, deaths, len(time) - np.searchsorted(np.sort(time), times, "left")


def _hazard(time: np.ndarray, event: np.ndarray, later: np.ndarray) -> float:
    """The Nelson-Aalen cumulative hazard summed over all event times of the table;
    ``later`` has, for each row, how many of these are not before its time."""
    times, deaths, risk = _at_risk(time, event)
    first = np.searchsorted(np.sort(time), times, "left")
    return float((deaths / risk * later[np.argsort(time, kind="stable")][first]).sum()) if len(times) else 0.0


def _log_rank(time: np.ndarray, event: np.ndarray, left: np.ndarray) -> float:
    """The log-rank statistic of two groups, over all event times of both."""
    times, d, y = _at_risk(time, event)
    own = np.sort(time[left])
    y1 = len(own) - np.searchsorted(own, times, "left")
    died = np.sort(time[left & (event == 1)])
    d1 = np.searchsorted(died, times, "right") - np.searchsorted(died, times, "left")
    ok = y > 1
    y, d, y1, d1 = y[ok], d[ok], y1[ok], d1[ok]
    var = (y1 / y * (1 - y1 / y) * (y - d) / (y - 1) * d).sum()
    return abs((d1 - y1 * d / y).sum()) / np.sqrt(var) if var > 0 else 0.0


#: Cuts of a feature that a node tries, at most: quantiles where it has more values.
CUTS = 32


def _grow(x: np.ndarray, t: np.ndarray, e: np.ndarray, later: np.ndarray, rng, least_split: int, least_leaf: int, depth: int | None) -> list[tuple[int, float, int, int]]:
    """A tree as rows of (feature, cut, left, right); a leaf has feature -1 and its value
    in place of the cut.  Without ``depth`` it grows until leaves can't be split."""
    nodes: list[tuple[int, float, int, int]] = [(-1, 0.0, -1, -1)]
    todo = [(0, np.arange(len(t)), 0)]
    while todo:
        at, rows, level = todo.pop()
        best, pick = 0.0, None
        if len(rows) >= least_split and (depth is None or level < depth) and e[rows].any():
            for f in rng.permutation(x.shape[1])[: max(1, int(np.sqrt(x.shape[1])))]:
                values = np.unique(x[rows, f])
                cuts = values[:-1] if len(values) <= CUTS else np.unique(np.quantile(x[rows, f], np.linspace(0, 1, CUTS + 1)[1:-1]))
                for cut in cuts:
                    left = x[rows, f] <= cut
                    if min(left.sum(), (~left).sum()) >= least_leaf and (value := _log_rank(t[rows], e[rows], left)) > best:
                        best, pick = value, (int(f), float(cut), left)
        if pick is None:
            nodes[at] = (-1, _hazard(t[rows], e[rows], later[rows]), -1, -1)
            continue
        f, cut, left = pick
        nodes[at] = (f, cut, len(nodes), len(nodes) + 1)
        todo += [(len(nodes), rows[left], level + 1), (len(nodes) + 1, rows[~left], level + 1)]
        nodes += [(-1, 0.0, -1, -1)] * 2
    return nodes


def _fall(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The values of the leaves that rows fall into."""
    feature, cut, left, right = tree
    at = np.zeros(len(x), np.int64)
    while len(on := np.flatnonzero(feature[at] >= 0)):
        node = at[on]
        at[on] = np.where(x[on, feature[node]] <= cut[node], left[node], right[node])
    return cut[at]


#: Rows that one tree is grown from, at most; larger tables give each tree its own random part.
TREE_ROWS = 20_000


def _poisson(u: Column, mean: float) -> Column:
    """A Poisson draw with a mean of 1 at most, from a number in (0, 1)."""
    draws, total, p = F.lit(0), np.exp(-mean), np.exp(-mean)
    for k in range(1, 20):  # more than 19 draws have a chance under 1e-18
        draws = F.when(u > float(total), k).otherwise(draws)
        p *= mean / k
        total += p
    return draws


def survival_forest(df: DataFrame, features: list[str], trees: int = 100, least_split: int = 10, least_leaf: int = 15, depth: int | None = None, seed: int = 42, key: str = "account_id", time: str = "time_to_event", event: str = "event_observed") -> DataFrame:
    """``key, risk``: the cumulative hazard summed over all event times, averaged over
    trees.

    Trees grow side by side, each from a random part of bounded size drawn from the
    table with replacement (row weights by Poisson draws), and then score all rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key), F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    rows = written(rows, "forest-rows")
    n = rows.count()
    # how many event times are not before each time
    times = _ranges(rows.groupBy("t").agg(F.max("e").alias("any")), "t")
    times = running(times, "t", {"later": F.col("any").cast("long")}, later=True).select("t", "later")
    share = min(1.0, TREE_ROWS / max(n, 1))
    # a draw of each row for each group of trees, by hash, with the mean ``share`` a tree; what
    # is drawn falls to a tree of the group by another hash.  The groups are so large that a
    # row meets few of them, and draws for single trees are again Poisson draws
    width = max(1, min(trees, int(1 / share)))
    u = (F.pmod(F.xxhash64(F.col(key), F.col("group"), F.lit(seed)), F.lit(2**52)) + 0.5) / 2.0**52
    draws, mean = F.lit(0), F.least(F.lit(width), trees - F.col("group") * width)
    size = {m: share * m for m in {width, trees - (trees - 1) // width * width}}
    for m, lam in size.items():
        draws = F.when(mean == m, _poisson(u, lam)).otherwise(draws)
    drawn = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // width)))).withColumn("n", draws).withColumn("of", mean).where("n > 0")
    drawn = drawn.withColumn("hit", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("tree", (F.col("group") * width + F.pmod(F.xxhash64(F.col(key), F.col("group"), F.col("hit"), F.lit(seed + 1)), F.col("of"))).cast("int"))
    bag = drawn.groupBy("tree", key, "t", "e", *features).agg(F.count("*").alias("n")).join(times, "t")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        rng = np.random.default_rng(seed + int(pdf["tree"].iloc[0]))
        full = pdf.loc[pdf.index.repeat(pdf["n"])]
        grown = _grow(full[features].to_numpy(float), full["t"].to_numpy(float), full["e"].to_numpy(int), full["later"].to_numpy(float), rng, least_split, least_leaf, depth)
        return pd.DataFrame({"tree": [int(pdf["tree"].iloc[0])], "grown": [[list(map(float, x)) for x in zip(*grown, strict=True)]]})

    grown = bag.groupBy("tree").applyInPandas(fit, "tree int, grown array<array<double>>").orderBy("tree").collect()
    packed = [(np.array(f, np.int64), np.array(c), np.array(a, np.int64), np.array(b, np.int64)) for f, c, a, b in (r.grown for r in grown)]
    model = spark.sparkContext.broadcast(packed)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]])
            risk = np.mean([_fall(t, x) for t in model.value], axis=0) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(risk, pa.float64())], [key, "risk"])

    kind = df.schema[key].dataType.simpleString()
    return rows.select(key, *features).mapInArrow(score, f"{key} {kind}, risk double")
