"""Session settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Times are wall-clock times; UTC has no gaps.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # 32-byte keys, as base64 or hexadecimal, do not show in plans and logs.
    "spark.sql.redaction.string.regex": "[A-Za-z0-9+/]{43}=|[0-9A-Fa-f]{64}",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(name: str = "trailmark", **settings: str) -> SparkSession:
    """A session with these settings; ``a__b`` in a keyword stands for ``a.b``.

    Master, memory and shuffle partitions come from the submit command or from
    the keywords.
    """
    builder = SparkSession.builder.appName(name)
    # Call sites of column functions cost a round trip to the JVM each.
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())
