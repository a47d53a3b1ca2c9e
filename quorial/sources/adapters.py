"""Domain frames over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import exact_sum

PATH = ["Global", "Region", "Nation", "Team", "IC"]
QUARTERS = ["1999Q4", "2000Q1", "2000Q2", "2000Q3", "2000Q4", "2001Q1", "2001Q2", "2001Q3"]
SUPPLY_PATH = ["Global", "Region", "Nation", "IC"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def places(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their place."""
    return table(spark, d, "customer").join(places(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))


def quarter(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def _by_quarter(df: DataFrame, key: str, day: str, money: str, more: list[Column] | None = None) -> DataFrame:
    columns = [F.coalesce(exact_sum(F.when(quarter(F.col(day)) == q, F.col(money))), F.lit(0.0)).alias(f"{q}_Attainment") for q in QUARTERS]
    return df.groupBy(key).agg(*columns, *(more or []))


def organisation(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer as an IC: path, eight quarters, open pipeline."""
    pipeline = F.coalesce(exact_sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))), F.lit(0.0)).alias("Current_Pipeline")
    facts = _by_quarter(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", [pipeline])
    measures = [c for c in facts.columns if c != "o_custkey"]
    joined = customers(spark, d).join(facts, F.col("c_custkey") == F.col("o_custkey"), "left")
    path = [F.lit("Global_Corp").alias("Global"), F.col("r_name").alias("Region"), F.col("n_name").alias("Nation"), F.concat_ws("/", "n_name", "c_mktsegment").alias("Team"), F.col("c_name").alias("IC")]
    return joined.select(*path, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in measures])


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    """One row per supplier as an IC, with full history."""
    facts = _by_quarter(table(spark, d, "lineitem"), "l_suppkey", "l_shipdate", "l_extendedprice")
    joined = table(spark, d, "supplier").join(places(spark, d), F.col("s_nationkey") == F.col("n_nationkey")).join(facts, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    path = [F.lit("Global_Corp").alias("Global"), F.col("r_name").alias("Region"), F.col("n_name").alias("Nation"), F.col("s_name").alias("IC")]
    return joined.select(*path, *[F.coalesce(f"{q}_Attainment", F.lit(0.0)).alias(f"{q}_Attainment") for q in QUARTERS])


def commits(spark: SparkSession, d: str, grain: str = "team") -> DataFrame:
    """Per manager (team or customer): 1999 commit, 2000 actual, 2001 current commit and
    the mean of 1999 and 2000 as machine forecast."""
    place = customers(spark, d).select("c_custkey", (F.concat_ws("/", "n_name", "c_mktsegment") if grain == "team" else F.col("c_name")).alias("Manager_ID"))
    year = lambda y: exact_sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice")))
    joined = place.join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    out = joined.groupBy("Manager_ID").agg(year(1999).alias("Historical_Commit"), year(2000).alias("Historical_Actual_Closed"), year(2001).alias("Current_Commit"))
    seen = F.coalesce("Historical_Commit", "Historical_Actual_Closed").isNotNull()
    mean = (F.coalesce("Historical_Commit", F.lit(0.0)) + F.coalesce("Historical_Actual_Closed", F.lit(0.0))) / 2
    return out.withColumn("Machine_Forecast", F.when(seen, mean)).fillna(0.0, ["Current_Commit"])


def accounts(spark: SparkSession, d: str) -> DataFrame:
    """Accounts with their market value in cents."""
    spent = table(spark, d, "orders").groupBy("o_custkey").agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")) * 100).cast("long").alias("cents"))
    joined = customers(spark, d).join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(F.col("c_name").alias("Account_ID"), F.concat(F.lit("Account "), F.col("c_custkey").cast("string")).alias("Account_Name"), F.col("r_name").alias("Region"), F.col("c_mktsegment").alias("Account_Segment"), F.coalesce("cents", F.lit(0)).cast("long").alias("Estimated_TAM"))


def contracts(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as contracts."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    vendors = table(spark, d, "supplier").join(places(spark, d), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(vendors, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        F.col("l_orderkey").alias("award_id"), F.col("l_linenumber").alias("line"), F.col("s_name").alias("vendor"), F.col("n_name").alias("agency"),
        F.to_date("o_orderdate").alias("start"), F.to_date("l_shipdate").alias("end"), F.col("l_extendedprice").alias("amount"),
    )


def lifetimes(spark: SparkSession, d: str) -> DataFrame:
    """Per customer: whole months from first to last order, and whether none came in
    the last six months."""
    span = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.count("*").alias("orders"), exact_sum("o_totalprice").alias("spent"))
    months = (F.year("b") - F.year("a")) * 12 + F.month("b") - F.month("a")
    joined = customers(spark, d).join(span, F.col("c_custkey") == F.col("o_custkey"))
    return joined.select(F.col("c_custkey").alias("account_id"), F.col("c_mktsegment").alias("account_segment"), F.col("r_name").alias("account_region"), F.col("c_acctbal").alias("balance"), "orders", "spent", months.alias("time_to_event"), (F.col("b") < F.lit("2001-02-01").cast("timestamp")).cast("int").alias("event_observed"))
