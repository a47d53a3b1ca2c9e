"""Managers' commits, corrected by their historical bias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exact_sum


def bias(history: DataFrame, manager: str = "Manager_ID", commit: str = "Historical_Commit", closed: str = "Historical_Actual_Closed") -> DataFrame:
    """``manager, bias``: closed over committed, 1.0 where nothing was committed.  Null
    managers drop out; sums skip nulls."""
    sums = history.where(F.col(manager).isNotNull()).groupBy(F.col(manager).alias("manager")).agg(F.coalesce(exact_sum(commit), F.lit(0.0)).alias("c"), F.coalesce(exact_sum(closed), F.lit(0.0)).alias("a"))
    return sums.select("manager", F.when(F.col("c") > 0, F.try_divide(F.col("a"), F.col("c"))).otherwise(1.0).alias("bias"))


def label(value: Column) -> Column:
    return F.when(value > 1.05, "Sandbagger").when(value < 0.95, "Happy Ears").otherwise("Neutral")


def reconcile(commits: DataFrame, biases: DataFrame, manager: str = "Manager_ID", commit: str = "Current_Commit", machine: str | None = None) -> DataFrame:
    """``manager, commit, bias, forecast``: the commit times the bias (1.0 for unknown
    managers), averaged with the machine forecast where there is one; 0 is one."""
    joined = commits.join(biases, commits[manager] == biases["manager"], "left")
    factor = F.coalesce("bias", F.lit(1.0))
    human = F.col(commit) * factor
    forecast = human if machine is None else F.when(F.col(machine).isNotNull(), (human + F.col(machine)) / 2).otherwise(human)
    return joined.select(F.col(manager).alias("manager"), F.col(commit).alias("commit"), factor.alias("bias"), forecast.alias("forecast"))
