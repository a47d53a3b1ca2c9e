"""Tables written between the rounds of an iteration, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a session of one process gets a
    temporary folder, and a cluster is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quorial-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage ends here, and an executor
    that is lost later costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/quorial/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Deletes ``written`` tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a table that are broadcast, at most: a few MB where rows are narrow.
FEW = 20_000


def few(df: DataFrame) -> DataFrame:
    """One side of a join: counted, and broadcast up to ``FEW`` rows; else for a sort-merge
    join.  Spark by itself goes by the size of files, which are far smaller than their
    rows in memory."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df.hint("merge")
