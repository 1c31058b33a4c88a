"""Session settings every plan of this package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC for dates, AQE for run-time join and partition choices.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "lexiquarry", **conf: str) -> SparkSession:
    """The active session, or a new one; ``conf`` adds to the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
