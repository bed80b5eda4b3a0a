"""Queries on drifting result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duoscope.operators import schema_drift
from duoscope.runtime import table


def _inputs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, root, "raw_results"), table(spark, root, "field_catalog")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return schema_drift.found(*_inputs(spark, root))


def p2_changes(spark: SparkSession, root: str) -> DataFrame:
    """Every change with its spelling, type, file and when it was first seen."""
    return schema_drift.change_log(*_inputs(spark, root))


def p2_union_schema(spark: SparkSession, root: str) -> DataFrame:
    """Types seen and promoted, per kind and field as written."""
    return schema_drift.union_schema(*_inputs(spark, root))


def p2_audits(spark: SparkSession, root: str) -> DataFrame:
    """All audit files in one schema."""
    return schema_drift.unify(*_inputs(spark, root), "audit")


def p2_generations(spark: SparkSession, root: str) -> DataFrame:
    """All generation files in one schema."""
    return schema_drift.unify(*_inputs(spark, root), "generation")


def queries():
    return {"p2_found": p2_found, "p2_changes": p2_changes, "p2_union_schema": p2_union_schema, "p2_audits": p2_audits, "p2_generations": p2_generations}


def oracle_sql():
    return {}
