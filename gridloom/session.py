"""Session settings that the library's SQL surface relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """ANSI mode, quoted identifiers, UTC and adaptive execution on ``spark``."""
    for key, value in (("spark.sql.ansi.enabled", "true"), ("spark.sql.ansi.doubleQuotedIdentifiers", "true"), ("spark.sql.session.timeZone", "UTC"), ("spark.sql.adaptive.enabled", "true")):
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "gridloom") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
    return configure(builder.getOrCreate())
