"""Churn: Kaplan-Meier curves, concordance, ROC, splits and Cox regression."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import dropped, written


def _ranges(df: DataFrame, column: str, parts: int = 200) -> DataFrame:
    """Rows with ``_range``, the number of quantile borders under their value: ranges
    that can be ordered side by side."""
    borders = df.agg(F.percentile_approx(F.col(column).cast("double"), [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(float(x)) for x in sorted(set(borders))]).cast("array<double>")
    return df.withColumn("_range", F.size(F.filter(cuts, lambda c: c < F.col(column))))


def running(df: DataFrame, order: str, values: dict[str, Column], by: list[str] | None = None, later: bool = False, total=F.sum) -> DataFrame:
    """``df``, which has ``_range`` and one row for each ``by`` and ``order``, with
    running totals of ``values`` up to each row or, with ``later``, from it on.

    Rows are only ordered within their range; what the other ranges add comes from a
    table of one row a range, so no task has all rows of a group.
    """
    by = by or []
    df = df.withColumns({f"_v_{k}": v for k, v in values.items()})
    ends = (0, Window.unboundedFollowing) if later else (Window.unboundedPreceding, 0)
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(*ends)
    beyond = Window.partitionBy(*by).orderBy("_range").rowsBetween(*((1, Window.unboundedFollowing) if later else (Window.unboundedPreceding, -1)))
    sums = df.groupBy(*by, "_range").agg(*[total(f"_v_{k}").alias(f"_s_{k}") for k in values])
    far = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_r"), *[total(f"_s_{k}").over(beyond).alias(f"_far_{k}") for k in values])
    own = df.withColumns({f"_near_{k}": total(f"_v_{k}").over(inside) for k in values})
    on = F.col("_range") == F.col("_r")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    both = (lambda k: F.col(f"_near_{k}") * F.coalesce(f"_far_{k}", F.lit(1.0))) if total is F.product else (lambda k: F.col(f"_near_{k}") + F.coalesce(f"_far_{k}", F.lit(0)))
    kept = [c for c in df.columns if not c.startswith("_v_")]
    return own.join(far, on).select(*kept, *[both(k).alias(k) for k in values])


def kaplan_meier(df: DataFrame, by: list[str] | None = None, time: str = "time_to_event", event: str = "event_observed") -> DataFrame:
    """``by, time, at_risk, events, survival`` at each time, from running totals over
    ranges of times."""
    by = by or []
    counts = df.where(F.col(time).isNotNull() & F.col(event).isNotNull()).groupBy(*by, F.col(time).alias("time")).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("events"))
    rows = running(_ranges(counts, "time"), "time", {"at_risk": F.col("n")}, by, later=True)
    rows = running(rows, "time", {"survival": 1 - F.col("events") / F.col("at_risk")}, by, total=F.product)
    return rows.select(*by, "time", "at_risk", "events", "survival")


def churn_rate(df: DataFrame, event: str = "event_observed") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.round(F.avg(F.col(event).cast("double")) * 100, 4).alias("churn_pct"))


#: Risks that are told apart in a round of ``concordance``, as a power of two.
_DIGIT = 4


def concordance(df: DataFrame, risk: str, time: str = "time_to_event", event: str = "event_observed") -> DataFrame:
    """Harrell's index as ``c_index, concordant, discordant, tied``.

    A pair counts if the earlier time is an event, or of equal times if one is an event
    and the other censored.  Rows are first counted by (time, event, risk), and risks are
    ranked.  Two ranks differ first in one of their digits, so for each place the counts of
    later rows are summed over times by digit, among rows that agree in the places above
    it; equal risks are counted apart.  These sums run in ranges of times, so neither a
    frequent risk nor a frequent time is a task of its own, and no pairs are made.
    """
    cells = df.groupBy(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(risk).cast("double").alias("r")).agg(F.count("*").alias("n")).dropna()
    cells = written(cells, "cells")
    risks = running(_ranges(cells.select("r").distinct(), "r"), "r", {"rank": F.lit(1)}).select("r", (F.col("rank") - 1).alias("rank"))
    risks = written(risks, "risks")
    rows = written(_ranges(cells.join(risks, "r").select("t", "rank", "n", F.when(F.col("e") == 1, F.col("n")).otherwise(0).alias("died")), "t"), "ranked")
    kinds, parts = 1 << _DIGIT, []
    same = running(rows.groupBy("rank", "t", "_range").agg(F.sum("n").alias("n"), F.sum("died").alias("died")), "t", {"later": F.col("n")}, ["rank"], later=True)
    parts.append(same.agg(F.lit(0).alias("concordant"), F.lit(0).alias("discordant"), F.sum(F.col("died") * (F.col("later") - F.col("died"))).alias("tied")))
    most, place = risks.count(), 0
    while most > 1 << place:
        digit = F.expr(f"shiftright(rank, {place}) & {kinds - 1}")
        of = lambda c, k: F.sum(F.when(digit == k, F.col(c)).otherwise(0))
        at = rows.groupBy(F.expr(f"shiftright(rank, {place + _DIGIT})").alias("above"), "t", "_range").agg(*[of("n", k).alias(f"n{k}") for k in range(kinds)], *[of("died", k).alias(f"died{k}") for k in range(kinds)])
        at = running(at, "t", {f"later{k}": F.col(f"n{k}") for k in range(kinds)}, ["above"], later=True)
        # at an event's own time only what is no event is later
        later = [F.col(f"later{k}") - F.col(f"died{k}") for k in range(kinds)]
        lower, upper = [F.lit(0)], [F.lit(0)]
        for k in range(1, kinds):
            lower.append(lower[-1] + later[k - 1])
            upper.append(upper[-1] + later[kinds - k])
        pairs = lambda sums: functools.reduce(operator.add, [F.col(f"died{k}") * sums[k] for k in range(kinds)])
        parts.append(at.agg(F.sum(pairs(lower)).alias("concordant"), F.sum(pairs(upper[::-1])).alias("discordant"), F.lit(0).alias("tied")))
        place += _DIGIT
    sums = functools.reduce(DataFrame.union, parts).agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("concordant", "discordant", "tied")])
    total = F.col("concordant") + F.col("discordant") + F.col("tied")
    return sums.withColumn("c_index", F.round(F.try_divide(F.col("concordant") + 0.5 * F.col("tied"), total), 4))


def roc_auc(df: DataFrame, score: str, label: str = "event_observed") -> DataFrame:
    """Exact area under the ROC curve from mid-ranks of the different scores.

    Running counts are made within ranges of scores, and over the ranges' sums.
    """
    cells = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    cells = _ranges(cells, "s")
    inside = Window.partitionBy("_range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("near", F.coalesce(F.sum(F.col("n") - F.col("pos")).over(inside), F.lit(0)))
    # one row a range
    sums = cells.groupBy("_range").agg(F.sum(F.col("n") - F.col("pos")).alias("neg"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("neg").over(before), F.lit(0)).alias("far"))
    rows = cells.join(F.broadcast(sums), "_range").withColumn("neg_below", F.col("near") + F.col("far"))
    good = F.sum(F.col("pos") * (F.col("neg_below") + (F.col("n") - F.col("pos")) / 2))
    return rows.agg(F.round(F.try_divide(good, (F.sum("pos") * F.sum(F.col("n") - F.col("pos"))).cast("double")), 6).alias("auc"))


def beginning(key: Column, salt: int = 42) -> Column:
    """The first digits of the hash by which ``split`` deals rows."""
    return F.substring(_hash(key, salt), 1, 4)


def _hash(key: Column, salt: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"/{salt}")))


def split(df: DataFrame, key: str | Column, share: float = 0.2, by: str | None = None, salt: int = 42, start: str | None = None) -> DataFrame:
    """Marks exactly ``ceil(share n)`` rows of all, or of each class, as ``is_test``, by
    the order of a hash of their key.

    Counts of the 65,536 beginnings of hashes tell in which of them a class's last test row
    is; only the rows of that one are ranked, and no others are moved.  Tables that are
    written can have the ``beginning`` of their keys as a column ``start``, which is then
    left out: only rows that are ranked are hashed again, and the counts are made once.
    """
    key = F.col(key) if isinstance(key, str) else key
    kept = [c for c in df.columns if c != start]
    rows = df.withColumn("_class", F.col(by) if by else F.lit(0)).withColumn("_start", F.col(start) if start else beginning(key, salt))
    counts = rows.groupBy("_class", "_start").agg(F.count("*").alias("_n"))
    group = Window.partitionBy("_class")
    before = group.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_last": F.ceil(F.sum("_n").over(group) * share)})
    edge = counts.where((F.col("_before") < F.col("_last")) & (F.col("_last") <= F.col("_before") + F.col("_n")))
    # one row a class
    edge = edge.select(F.col("_class").alias("_c"), F.col("_start").alias("_s"), (F.col("_last") - F.col("_before")).alias("_of_these"))
    edge = F.broadcast(written(edge, "edge") if start else edge)
    joined = rows.where("_start IS NOT NULL").join(edge, F.col("_class").eqNullSafe(F.col("_c")), "left")
    at = F.coalesce(F.col("_start") == F.col("_s"), F.lit(False))
    place = F.row_number().over(Window.partitionBy("_class").orderBy(_hash(key, salt), key))
    ranked = joined.where(at).select(*kept, (place <= F.col("_of_these")).alias("is_test"))
    return joined.where(~at).select(*kept, F.coalesce(F.col("_start") < F.col("_s"), F.lit(False)).alias("is_test")).union(ranked)


def standardised(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Columns less their mean over their population deviation, learned from ``fit_on``."""
    stats = (df if fit_on is None else fit_on).agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    scale = lambda c: F.lit(stats[f"s_{c}"] or 1.0)
    return df.withColumns({f"{c}_z": (F.col(c) - F.lit(stats[f"m_{c}"])) / scale(c) for c in columns})


def one_hot(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None, most: int = 1_000) -> tuple[DataFrame, list[str]]:
    """``df`` with a column of 0 and 1 for each category of each column met in
    ``fit_on``, and the names of these.  Categories not met there, and nulls, are all
    zeros.  More than ``most`` categories of one column raise ``ValueError``."""
    names, out = [], {}
    for c in columns:
        found = (df if fit_on is None else fit_on).where(F.col(c).isNotNull()).select(c).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{c} has more than {most} categories")
        for k, value in enumerate(sorted(r[0] for r in found)):
            names.append(f"{c}_{k}")
            out[names[-1]] = F.coalesce((F.col(c) == F.lit(value)).cast("double"), F.lit(0.0))
    return df.withColumns(out), names


def summed(df: DataFrame, moments: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sums of ``moments`` of the rows (a matrix of ``df``'s columns to ``size`` numbers),
    made in the tasks; a row for each task and number is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += moments(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["slot", "value"])

    out = np.zeros(size)
    for r in df.mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect():
        out[r.slot] = r.value
    return out


def cox(df: DataFrame, features: list[str], time: str = "time_to_event", event: str = "event_observed", ridge: float = 0.01, steps: int = 20, tolerance: float = 1e-7) -> np.ndarray:
    """Coefficients of a proportional-hazards model (Breslow ties, ridge penalty).

    With S0 and S1 the sums of weights, and of weighted features, of all rows from a time
    on, and A the sum of d / S0 over the event times up to one, the second derivatives
    are the features' products weighted by w A, less those of S1 / S0 weighted by d.  So
    only p + 1 sums run over times, in ranges of these, and the products are summed where
    the rows are; p x p numbers reach the driver.  A step that lowers the likelihood is
    halved, and ``ValueError`` tells that ``steps`` did not suffice.
    """
    p = len(features)
    x = [f"x{i}" for i in range(p)]
    rows = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, x, strict=True)]).dropna()
    rows = written(_ranges(rows, "t"), "cox-rows")
    seen = summed(rows.where("e = 1").select(*x), lambda m: m.sum(0), p)
    products = lambda m, w: np.einsum("ri,rj,r->ij", m, m, w).ravel() if len(m) < 512 else ((m * w[:, None]).T @ m).ravel()
    beta, before = np.zeros(p), None
    for _ in range(steps):
        w = F.exp(linear_score(x, beta))
        at = rows.groupBy("t", "_range").agg(F.sum("e").cast("double").alias("d"), F.sum(w).alias("w0"), *[F.sum(w * F.col(n)).alias(f"w_{n}") for n in x])
        at = running(at, "t", {"s0": F.col("w0"), **{f"s_{n}": F.col(f"w_{n}") for n in x}}, later=True).select("t", "_range", "d", "s0", *[f"s_{n}" for n in x])
        at = written(running(at, "t", {"a": F.col("d") / F.col("s0")}), "cox-times")

        def of_times(m: np.ndarray) -> np.ndarray:
            d, s0, mean = m[:, 0], m[:, 1], m[:, 2:] / m[:, 1:2]
            return np.r_[(d * np.log(s0)).sum(), d @ mean, products(mean, d)]

        sums = summed(at.where("d > 0").select("d", "s0", *[f"s_{n}" for n in x]), of_times, 1 + p + p * p)
        likely = seen @ beta - sums[0] - ridge / 2 * beta @ beta
        if before is not None and likely < before[1] - 1e-9 * abs(before[1]):
            dropped(at)
            beta = (before[0] + beta) / 2
            continue
        weighted = rows.join(at.select("t", "a"), "t").select((w * F.col("a")).alias("w"), *x)
        first = summed(weighted, lambda m: products(m[:, 1:], m[:, 0]), p * p).reshape(p, p)
        dropped(at)
        hessian = sums[1 + p :].reshape(p, p) - first - ridge * np.eye(p)
        step = np.linalg.solve(hessian, seen - sums[1 : 1 + p] - ridge * beta)
        before, beta = (beta, likely), beta - step
        if np.abs(step).max() < tolerance:
            dropped(rows)
            return beta
    dropped(rows)
    raise ValueError(f"the coefficients did not settle in {steps} steps")


def linear_score(features: list[str], beta: np.ndarray):
    out = F.lit(0.0)
    for f, b in zip(features, beta, strict=True):
        out = out + F.lit(float(b)) * F.col(f)
    return out
