"""Sources and sinks: CSV, JSON and Parquet with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, blank_is_null: bool = True) -> DataFrame:
    """CSV with a header and quoted fields.  ``NA`` stays text; blank and NaN become null."""
    return clean(spark.read.csv(path, schema=schema, header=True, quote='"', escape='"'), blank_is_null)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return clean(spark.read.schema(schema).json(path))


def clean(df: DataFrame, blank_is_null: bool = True) -> DataFrame:
    """NaN and, if wanted, blank text to null."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        elif kind == "string" and blank_is_null:
            c = F.when(F.trim(c) != "", c)
        out.append(c.alias(name))
    return df.select(*out)


def from_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return clean(spark.createDataFrame(rows, schema))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="overwrite", quote='"', escape='"')
