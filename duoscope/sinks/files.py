"""Results written as tables and as single JSON documents."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.functions import labels


def stamp(now: datetime | None = None) -> str:
    """yyyyMMdd_HHmmss, as file names have it."""
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")


def write_pairs(pairs: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Generated pairs, a folder per benchmark and dialect; what is there for them is replaced."""
    pairs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("benchmark", "dialect").format(fmt).save(path)


def write_audits(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Audited pairs, a folder per model, benchmark and dialect."""
    safe = rows.withColumn("model_dir", labels.model_safe(F.col("model")))
    safe.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_dir", "benchmark", "dialect").format(fmt).save(path)


def audit_documents(summaries: DataFrame, rows: DataFrame, keys: list[str], created: str, part: str = "") -> DataFrame:
    """One JSON document per audit with its pairs inside, and the name of its file.

    A document holds all pairs of an audit, as readers of that format expect;
    for audits that don't fit one task use :func:`write_audits`.
    """
    pairs = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("id", *[c for c in rows.columns if c not in {*keys, "id"}]))).alias("pairs"))
    whole = summaries.join(pairs, keys, "left")
    name = labels.audit_file_name(F.col("benchmark"), F.col("dialect"), F.col("model"), F.lit(created + part))
    return whole.select(name.alias("file_name"), labels.model_safe(F.col("model")).alias("model_dir"), F.to_json(F.struct(*whole.columns), {"ignoreNullFields": "false"}).alias("document"))


def generation_documents(summaries: DataFrame, pairs: DataFrame, failed: DataFrame, created: str) -> DataFrame:
    """One JSON document per benchmark and dialect with valid and failed pairs inside."""
    keys = ["benchmark", "dialect"]
    inside = lambda df, name: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("id", *[c for c in df.columns if c not in {*keys, "id"}]))).alias(name))
    whole = summaries.join(inside(pairs, "pairs"), keys, "left").join(inside(failed, "failed_pairs"), keys, "left")
    name = F.concat_ws("_", "benchmark", "dialect", F.lit(created + ".json"))
    return whole.select(name.alias("file_name"), F.to_json(F.struct(*whole.columns), {"ignoreNullFields": "false"}).alias("document"))


def save_documents(documents: DataFrame, path: str) -> None:
    """Writes (file_name, document) rows as text, a folder per file name, from the executors."""
    documents.select("file_name", "document").write.mode("overwrite").partitionBy("file_name").text(path)


def indent(document: str) -> str:
    """A document the way people read it."""
    return json.dumps(json.loads(document), indent=2, ensure_ascii=False)
