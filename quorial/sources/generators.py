"""Synthetic churn data, and an adapter for a public account table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: per segment the mean and deviation of value and onboarding, and the monthly risk.
SEGMENTS = {"SMB": (15_000, 3_000, 15, 5, 0.04), "Mid-Market": (75_000, 15_000, 40, 10, 0.02), "Enterprise": (250_000, 50_000, 90, 20, 0.01)}
#: Fixed: contract lengths in months with their cumulative shares, per segment.
LENGTHS = {"SMB": [(12, 1.0)], "Mid-Market": [(12, 0.7), (24, 1.0)], "Enterprise": [(12, 0.2), (24, 0.7), (36, 1.0)]}


def _uniform(salt: str, *key: Column) -> Column:
    """A number in (0, 1) made from a hash, the same however rows are partitioned."""
    return (F.pmod(F.xxhash64(F.lit(salt), *key), F.lit(2**40)) + 0.5) / 2.0**40


def _normal(salt: str, *key: Column) -> Column:
    return F.sqrt(-2 * F.log(_uniform(salt + "/r", *key))) * F.cos(2 * math.pi * _uniform(salt + "/a", *key))


def _between(low: float, value: Column, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def _by_segment(values: dict) -> Column:
    out = F.lit(None)
    for name, v in values.items():
        out = F.when(F.col("account_segment") == name, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def _chosen(u: Column, options: list[tuple]) -> Column:
    out = F.lit(options[-1][0])
    for value, top in reversed(options[:-1]):
        out = F.when(u < top, value).otherwise(out)
    return out


def churn_data(spark: SparkSession, accounts: int, months: int = 36, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Accounts with the month they left or were last seen in, and their monthly
    telemetry until then.

    Use drifts as a clamped random walk; the risk of a month rises with changed
    sponsors, overdue invoices and low use, falls with a partner, and triples where a
    contract is renewed.
    """
    s, i = str(seed), F.col("id")
    base = spark.range(accounts).withColumn("account_id", F.concat(F.lit("acc-"), F.lpad(i.cast("string"), 10, "0")))
    base = base.withColumn("account_segment", _chosen(_uniform(s + "seg", i), [("SMB", 0.5), ("Mid-Market", 0.8), ("Enterprise", 1.0)]))
    base = base.withColumn("account_region", _chosen(_uniform(s + "reg", i), [("AMER", 0.6), ("APAC", 0.75), ("EMEA", 1.0)]))
    base = base.withColumn("industry", _chosen(_uniform(s + "ind", i), [("Technology", 0.2), ("Finance", 0.4), ("Healthcare", 0.6), ("Retail", 0.8), ("Manufacturing", 1.0)]))
    base = base.withColumn("has_channel_partner", (_uniform(s + "par", i) < 0.25).cast("int"))
    part = lambda k: _by_segment({n: float(v[k]) for n, v in SEGMENTS.items()})
    base = base.withColumn("initial_arr", F.round(F.greatest(F.lit(5000.0), part(0) + part(1) * _normal(s + "arr", i)), 2))
    base = base.withColumn("onboarding_duration_days", F.round(F.greatest(F.lit(1.0), part(2) + part(3) * _normal(s + "onb", i))).cast("int"))
    base = base.withColumn("contract_length_months", _by_segment({n: _chosen(_uniform(s + "len", i), o) for n, o in LENGTHS.items()}))
    base = base.withColumn("risk", part(4) * F.when(F.col("has_channel_partner") == 1, 0.8).otherwise(1.0))
    start = F.array(0.85 + 0.1 * _normal(s + "mau0", i))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(months)), start, lambda a, m: F.array_append(a, _between(0.1, F.element_at(a, -1) + 0.05 * _normal(s + "mau", i, m), 1.0)))
    rows = base.withColumn("walk", walk).select("*", F.posexplode(F.slice("walk", 2, months)).alias("at", "mau")).withColumn("time_period", F.col("at") + 1)
    m = F.col("time_period")
    rows = rows.withColumn("executive_sponsor_turnover", (_uniform(s + "exe", i, m) < 0.02).cast("int"))
    rows = rows.withColumn("overdue_invoices", (_uniform(s + "due", i, m) < 0.01 + (1 - F.col("mau")) * 0.05).cast("int"))
    hazard = F.col("risk") + 0.05 * F.col("executive_sponsor_turnover") + 0.03 * F.col("overdue_invoices") + F.when(F.col("mau") < 0.4, 0.04).otherwise(0.0)
    hazard = hazard * F.when(m % F.col("contract_length_months") == 0, 3.0).otherwise(1.0)
    rows = rows.withColumn("left", _uniform(s + "out", i, m) < hazard)
    ends = rows.groupBy("account_id").agg(F.min(F.when(F.col("left"), m)).alias("gone"))
    static = base.join(ends, "account_id").select(
        "account_id", "industry", "account_segment", "account_region", "has_channel_partner", "initial_arr", "contract_length_months", "onboarding_duration_days",
        F.coalesce("gone", F.lit(months)).cast("int").alias("time_to_event"), F.col("gone").isNotNull().cast("int").alias("event_observed"),
    )
    telemetry = rows.join(ends, "account_id").where(m <= F.coalesce("gone", F.lit(months))).select(
        "account_id", "time_period", F.round("mau", 3).alias("monthly_active_users_pct"),
        F.round(_between(0, F.col("mau") * 100 + 10 * _normal(s + "fea", i, m), 100), 1).alias("feature_adoption_score"),
        F.greatest(F.lit(0), ((1 - F.col("mau")) * 5 + 2 * _normal(s + "tic", i, m)).cast("int")).alias("support_tickets_created"),
        F.round(_between(1, F.col("mau") * 5 + 0.5 * _normal(s + "csa", i, m), 5), 1).alias("csat_score"),
        "executive_sponsor_turnover", "overdue_invoices",
    )
    return static, telemetry


def public_accounts(df: DataFrame) -> DataFrame:
    """A public customer table as accounts: total charges, blank or unreadable ones as
    0, stand for the market value, monthly charges for the revenue."""
    total = F.coalesce(F.expr("try_cast(TotalCharges AS double)"), F.lit(0.0))
    return df.withColumn("TotalCharges", total).withColumnsRenamed({"customerID": "Account_ID", "TotalCharges": "Estimated_TAM", "MonthlyCharges": "Annual_Revenue"})
