"""Contract longevity by vendor tier and agency sector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import exact_sum, holds_any
from ..functions.tables import few, written
from .survival import _ranges

#: Days of the survival labels.
THRESHOLDS = [365, 1095, 1825, 3650]


def typed(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Text dates and amounts to types; what can't be read is null, or raises if strict."""
    day = F.to_date if strict else (lambda c: F.try_to_date(c, "yyyy-MM-dd"))
    return raw.withColumn("start", day(F.col("start"))).withColumn("end", day(F.col("end"))).withColumn("amount", F.expr("try_cast(amount AS double)"))


def with_duration(df: DataFrame) -> DataFrame:
    return df.withColumn("duration", F.datediff("end", "start"))


def clean(df: DataFrame) -> DataFrame:
    """Contracts that don't end before they start; unknown durations go as well."""
    return with_duration(df).where("duration >= 0")


def fiscal_year(day: Column) -> Column:
    """October to September, named after the year it ends in."""
    return F.year(day) + F.when(F.month(day) >= 10, 1).otherwise(0)


def dedupe(df: DataFrame, key: str = "award_id", tie: list[str] | None = None) -> DataFrame:
    """The first row of each key by fiscal year, then the larger amount."""
    order = [fiscal_year(F.col("start")).asc_nulls_last(), F.col("amount").desc_nulls_last(), *(tie or [])]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


#: Fixed: names of resellers, and of defence agencies, in upper case.
RESELLERS = ["CARAHSOFT", "CDW", "DLT", "MYTHICS", "FOUR INC", "THUNDERCAT", "SHI INTERNATIONAL", "GOVCONNECTION", "IMMIX"]
DEFENSE = ["DEFENSE", "ARMY", "NAVY", "AIR FORCE"]


def vendor_type(name: Column, resellers: list[str] = RESELLERS) -> Column:
    return F.when(holds_any(name, resellers), "VAR").otherwise("Direct")


def sector(agency: Column, defense: list[str] = DEFENSE) -> Column:
    return F.when(holds_any(agency, defense), "DoD").otherwise("Civilian")


def quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and a column for each of ``shares``: exact quantiles, linear between values.

    Counts of ranges of values tell which ranges hold the ranks in question, and only the
    different values of these are put in order.  No group's values are held together."""
    return _quantiles(_counted(df, by, value), by, shares)


def _counted(df: DataFrame, by: str, value: str) -> DataFrame:
    """``by, v, n``: how often each group has each value, written."""
    return written(df.groupBy(F.col(by).alias("by"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")), "values")


def _quantiles(counted: DataFrame, by: str, shares: dict[str, float]) -> DataFrame:
    cells = _ranges(counted.where("v IS NOT NULL"), "v")
    # a row for each group and range
    per = cells.groupBy("by", "_range").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("by")
    per = per.withColumn("before", F.coalesce(F.sum("n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(group))
    place = lambda p: F.lit(p) * (F.col("total") - 1)
    ranks = F.array(*[F.struct(F.lit(name).alias("share"), (place(p) - F.floor(place(p))).alias("part"), F.floor(place(p)).alias("low"), F.ceil(place(p)).alias("high")) for name, p in shares.items()])
    asked = per.select("by", "_range", "before", "n", F.explode(ranks).alias("q")).select("by", "_range", "before", "n", "q.share", "q.part", F.explode(F.array("q.low", "q.high")).alias("rank"))
    asked = written(asked.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).distinct(), "ranks")
    needed = asked.select(F.col("by").alias("_b"), F.col("_range").alias("_r"), "before").distinct()
    here = cells.join(needed, F.col("by").eqNullSafe(F.col("_b")) & (F.col("_range") == F.col("_r"))).select("by", "_range", "v", "n", "before")
    inside = Window.partitionBy("by", "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = here.withColumn("upto", F.col("before") + F.sum("n").over(inside)).select(F.col("by").alias("_b"), F.col("_range").alias("_r"), "v", "upto", (F.col("upto") - F.col("n")).alias("since"))
    on = F.col("by").eqNullSafe(F.col("_b")) & (F.col("_range") == F.col("_r")) & (F.col("rank") >= F.col("since")) & (F.col("rank") < F.col("upto"))
    found = asked.join(here, on).groupBy("by", "share", "part").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    # two different ranks give two values, one rank or equal values one
    at = F.when(F.col("part") == 0, F.col("low")).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high"))
    return found.groupBy(F.col("by").alias(by)).agg(*[F.max(F.when(F.col("share") == name, at)).alias(name) for name in shares])


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe(df: DataFrame, by: str, value: str = "duration") -> DataFrame:
    """Count, mean, deviation, least, exact linear quartiles and most, to 2 digits, all from
    one table of how often a group has each value, so ``df`` is made once."""
    counted = _counted(df, by, value)
    known = F.when(F.col("v").isNotNull(), F.col("n"))
    sums = counted.groupBy("by").agg(F.coalesce(F.sum(known), F.lit(0)).alias("n"), F.try_divide(F.sum(F.col("v") * F.col("n")), F.sum(known)).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    far = counted.join(few(sums.select(F.col("by").alias("_b"), "mean")), F.col("by").eqNullSafe(F.col("_b")))
    far = far.groupBy(F.col("by").alias("_d")).agg(F.sum(F.col("n") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))).alias("squares"))
    q = _quantiles(counted, "_by", QUARTILES)
    out = sums.join(far, F.col("by").eqNullSafe(F.col("_d"))).join(q, F.col("by").eqNullSafe(F.col("_by")), "left")
    std = F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1)))
    return out.select(F.col("by").alias(by), "n", F.round("mean", 2).alias("mean"), F.round(std, 2).alias("std"), "min", *[F.round(c, 2).alias(c) for c in QUARTILES], "max")


def vendor_sums(df: DataFrame, *by: str) -> DataFrame:
    return df.where("vendor IS NOT NULL").groupBy(*by, "vendor").agg(exact_sum("amount").alias("total"), F.count("*").alias("contracts"))


def best_vendors(sums: DataFrame, n: int) -> DataFrame:
    """Only the n best are sorted, so no window over all vendors is needed."""
    return sums.orderBy(F.desc("total"), "vendor").limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "vendor")))


def top_vendors(df: DataFrame, n: int = 10) -> DataFrame:
    return best_vendors(vendor_sums(df), n)


def with_tiers(df: DataFrame, tiers: tuple[int, ...] = (10, 25, 50), of: DataFrame | None = None) -> DataFrame:
    """Flags for the vendors of each tier, which are found in ``of``, or else in ``df``.
    At most ``max(tiers)`` vendors are joined."""
    best = top_vendors(df if of is None else of, max(tiers)).select(F.col("vendor").alias("_v"), "rank")
    out = df.join(F.broadcast(best), F.col("vendor") == F.col("_v"), "left")
    flags = {f"is_top_{n}": F.coalesce(F.col("rank") <= n, F.lit(False)) for n in tiers}
    return out.withColumns(flags).drop("_v", "rank")


def vendor_table(df: DataFrame, n: int = 10) -> DataFrame:
    sums = df.where("vendor IS NOT NULL").groupBy("vendor").agg(exact_sum("amount").alias("total"), F.count("*").alias("contracts"), F.min("start").alias("first"), F.max("start").alias("last"))
    best = sums.orderBy(F.desc("total"), "vendor").limit(n)
    return best.select("vendor", F.format_string("%.3f", F.round(F.col("total") / 1e9, 3)).alias("billions"), "contracts", F.date_format("first", "MMM yyyy").alias("first"), F.date_format("last", "MMM yyyy").alias("last"))


def survival_labels(df: DataFrame, tiers: tuple[int, ...] = (10, 25, 50)) -> DataFrame:
    """Per threshold and tier: contracts, those that last, and whether a model can be
    fitted (at least 10 that last, and not all)."""
    flagged = with_tiers(df, tiers)
    long = flagged.select("duration", *[f"is_top_{n}" for n in tiers], F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("threshold"))
    lasts = F.col("duration") >= F.col("threshold")
    sums = long.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(lasts).alias("lasting"), *[F.count_if(lasts & F.col(f"is_top_{t}")).alias(f"lasting_top_{t}") for t in tiers])
    return sums.withColumn("usable", (F.col("lasting") >= 10) & (F.col("lasting") < F.col("n")))


def subaward_flag(df: DataFrame, count: str) -> DataFrame:
    return df.withColumn(count, F.coalesce(count, F.lit(0))).withColumn("has_subawards", F.col(count) > 0)


def histogram(df: DataFrame, low: float, high: float, bins: int, value: str = "duration") -> DataFrame:
    """``bin, n``; bin 0 and bins + 1 hold what lies outside."""
    return df.groupBy(F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def box(df: DataFrame, by: str, value: str = "duration") -> DataFrame:
    """What a box plot shows, per group: quartiles, the whiskers (the last values within
    1.5 times the distance of the quartiles), and how many values lie outside of them."""
    rows = df.select(by, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    q = quantiles(df, by, value, QUARTILES)
    # one narrow row for each group, which is as many as a plot has boxes; the size of the
    # join is left to adaptive execution
    far = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col("v").between(F.col("q25") - far, F.col("q75") + far)
    joined = rows.withColumnRenamed(by, "_by").join(q, F.col("_by").eqNullSafe(F.col(by)))
    return joined.groupBy(by, "q25", "q50", "q75").agg(F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"), F.count_if(~inside).alias("outside"))


def share_lasting(df: DataFrame, by: str, thresholds: list[int] = THRESHOLDS, value: str = "duration") -> DataFrame:
    """``by, threshold, n, share``: the points of a line or the bars of a plot, how many of
    a group's contracts last each number of days."""
    sums = df.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(F.col(value) >= t).alias(f"_{t}") for t in thresholds])
    points = F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col(f"_{t}") / F.col("n")).alias("share")) for t in thresholds])
    return sums.select(by, "n", F.inline(points))
