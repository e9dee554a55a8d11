"""Session defaults."""

from pyspark.sql import SparkSession


def session(name: str = "sparkrank", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ANSI stays on, as functions here guard what may overflow."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
