"""Result documents as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.functions import labels
from duoscope.operators import shards

PAIR = "id: string, original: string, transformed: string, dialect: string, benchmark: string, subject: string, semantic_score: double, feature_count: bigint, authenticity_score: double, metadata: struct<answer: string, choices: array<string>, correct_choice: int>"
PAIRS_DOC = f"benchmark string, dialect string, total_samples bigint, successful_transforms bigint, valid_pairs bigint, failed_validation bigint, transform_errors bigint, pass_rate double, pairs array<struct<{PAIR}>>, generation_time string"
RESULT = "id: string, original_prompt: string, transformed_prompt: string, original_response: string, transformed_response: string, original_answer: string, transformed_answer: string, expected_answer: string, original_correct: boolean, transformed_correct: boolean, error: string"
AUDIT_DOC = f"benchmark string, dialect string, model string, total_pairs bigint, original_correct bigint, transformed_correct bigint, both_correct bigint, both_wrong bigint, original_only_correct bigint, transformed_only_correct bigint, original_accuracy double, transformed_accuracy double, accuracy_gap double, benchmark_type string, pairs array<struct<{RESULT}>>, audit_time string, errors bigint, combined_from array<string>"


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON document, with its file's name; documents that can't be read give null fields."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("file_name", F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)).withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """All generated pairs below a path, with their document's benchmark and dialect."""
    docs = _documents(spark, path, PAIRS_DOC).select(F.col("benchmark").alias("doc_benchmark"), F.col("dialect").alias("doc_dialect"), "file_name", "pairs")
    return docs.select("doc_benchmark", "doc_dialect", "file_name", F.inline("pairs"))


def inline_pairs(docs: DataFrame) -> DataFrame:
    """The pairs of generation documents that are already columns."""
    return docs.select(F.inline("pairs"))


def without_samples(files: DataFrame, word: str = "sample") -> DataFrame:
    """Files whose name doesn't say that they are samples."""
    return files.where(~F.contains("file_name", F.lit(word)))


def audits(spark: SparkSession, path: str, exclude_samples: bool = True) -> DataFrame:
    """Audit summaries below a path; documents without the required fields are skipped, a missing type is numerical."""
    df = _documents(spark, path, AUDIT_DOC).where("benchmark is not null and dialect is not null and model is not null and total_pairs is not null").drop("pairs")
    df = without_samples(df) if exclude_samples else df
    return df.withColumn("benchmark_type", F.coalesce("benchmark_type", F.lit("numerical"))).withColumn("errors", F.coalesce("errors", F.lit(0)))


def audit_rows(spark: SparkSession, path: str) -> DataFrame:
    """All audited pairs below a path."""
    return _documents(spark, path, AUDIT_DOC).select("benchmark", "dialect", "model", "file_name", F.inline("pairs"))


def latest_audits(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    """The newest audit per model folder, benchmark and dialect; combined ones beat any."""
    df = audits(spark, path)
    df = df if models is None else df.where(F.col("folder").isin(models))
    named = shards.with_name_parts(df.select("folder", "file_name").distinct().withColumn("file_id", F.col("file_name")))
    keep = shards.latest_wins(named, ["folder", "benchmark", "dialect", "model"]).select("folder", "file_name")
    return df.join(keep, ["folder", "file_name"], "left_semi")


def archived_audits(spark: SparkSession, path: str, benchmark: str = "gsm8k") -> DataFrame:
    """Every audit of one benchmark in an archive folder, re-runs included."""
    return audits(spark, path, exclude_samples=False).where(F.col("file_name").startswith(f"audit_{benchmark}_"))


def all_models(spark: SparkSession, path: str, folders: list[str] = labels.MODEL_FOLDERS) -> DataFrame:
    """The newest audits of the model folders that are listed; other folders are left alone."""
    return latest_audits(spark, path, folders)


def audit_table(spark: SparkSession, path: str, folders: list[str] = labels.MODEL_FOLDERS) -> DataFrame:
    """Audits for tables, with the place of their folder: the first file by name counts per folder, benchmark and dialect, unless there are combined ones, of which the last counts."""
    df = audits(spark, path, exclude_samples=False).where(F.col("file_name").startswith("audit_") & F.col("folder").isin(folders))
    named = df.withColumn("combined", F.contains("file_name", F.lit("_combined.json"))).withColumn("file_id", F.col("file_name"))
    first = shards.earliest_wins(named, ["folder", "benchmark", "dialect"])
    return first.withColumn("place", F.array_position(F.array(*[F.lit(f) for f in folders]), F.col("folder")) - 1).drop("combined", "file_id")


def generation_file(spark: SparkSession, path: str, benchmark: str, dialect: str) -> str | None:
    """The first document of a benchmark and dialect by name; arc_challenge is filed as arc."""
    prefix = {"arc_challenge": "arc"}.get(benchmark, benchmark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{prefix}_{dialect}_*.json").load(path)  # lists names, reads no content
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name")).agg(F.min("file_name")).first()[0]
