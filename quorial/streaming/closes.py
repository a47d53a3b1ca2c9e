"""Manager bias over a stream of closed deals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_bias(closes: DataFrame, time: str, late: str = "1 day", width: str = "30 days", manager: str = "Manager_ID", commit: str = "commit", closed: str = "closed") -> DataFrame:
    """Per manager and window of event time: the bias of ``operators.commit``.  Works on
    a stream (rows later than ``late`` are left out) and on a table alike."""
    rows = closes.withWatermark(time, late) if closes.isStreaming else closes
    sums = rows.where(F.col(manager).isNotNull()).groupBy(F.window(time, width).alias("window"), F.col(manager).alias("manager")).agg(F.sum(F.col(commit).cast("decimal(18,2)")).cast("double").alias("c"), F.sum(F.col(closed).cast("decimal(18,2)")).cast("double").alias("a"))
    return sums.select("window", "manager", F.when(F.col("c") > 0, F.try_divide("a", "c")).otherwise(1.0).alias("bias"))
