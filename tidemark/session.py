"""A session with the settings that the operators' results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    # With pruning on, a CSV file of a wrong layout passes unnoticed if the wrong columns aren't read.
    "spark.sql.csv.parser.columnPruning.enabled": "false",
}


def get_session(name: str = "tidemark", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()
