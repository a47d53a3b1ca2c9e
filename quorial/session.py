"""Session settings the library is written for."""

from pyspark.sql import SparkSession


def session(app: str = "quorial", **conf: str) -> SparkSession:
    """A session with ANSI arithmetic, UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
