"""Rewrites made, checked and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_metadata(metadata: Column) -> Column:
    """JSON that always has the answer, and choices and correct_choice only where there are any."""
    answer = F.to_json(F.struct(metadata["answer"].alias("answer")), {"ignoreNullFields": "false"})
    more = F.to_json(F.struct(metadata["choices"].alias("choices"), metadata["correct_choice"].alias("correct_choice")))
    return F.when(more == "{}", answer).otherwise(F.concat(F.substring(answer, F.lit(1), F.length(answer) - 1), F.lit(","), F.substring(more, F.lit(2), F.length(more))))


def failure_breakdown(validated: DataFrame) -> DataFrame:
    """Failures per validator; a rewrite counts for each it failed."""
    return validated.select(F.explode("failed_validators").alias("validator")).groupBy("validator").agg(F.count("*").alias("failures"))


def counts(validated: DataFrame, keys: list[str]) -> DataFrame:
    """Samples, rewrites made, valid and failed ones, errors and pass rate; a null status is a rewrite that failed."""
    made = F.col("status").isNotNull()
    out = validated.groupBy(*keys).agg(
        F.count("*").alias("total_samples"), F.count_if(made).alias("successful_transforms"), F.count_if(F.col("status") == "passed").alias("valid_pairs"),
        F.count_if(made & (F.col("status") != "passed")).alias("failed_validation"), F.count_if(~made).alias("transform_errors"),
    )
    return out.withColumn("pass_rate", F.when(F.col("successful_transforms") > 0, F.col("valid_pairs") / F.col("successful_transforms")).otherwise(0.0))


def combine(shards: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of shards added up, with the pass rate of the sums."""
    names = ["total_samples", "successful_transforms", "valid_pairs", "failed_validation", "transform_errors"]
    out = shards.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    return out.withColumn("pass_rate", F.when(F.col("successful_transforms") > 0, F.col("valid_pairs") / F.col("successful_transforms")).otherwise(0.0))
