"""All core queries by name, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duoscope.plans import audits, drift, pairs, parts, streams


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Paired confusion, McNemar and Benjamini-Hochberg per model, benchmark and dialect."""
    return audits.significance(spark, root)


def queries():
    return {**drift.queries(), **pairs.PLAN.queries, **audits.PLAN.queries, **parts.PLAN.queries, **streams.PLAN.queries}


def oracle_sql():
    return {**drift.oracle_sql(), **pairs.PLAN.sql, **audits.PLAN.sql, **parts.PLAN.sql, **streams.PLAN.sql}
