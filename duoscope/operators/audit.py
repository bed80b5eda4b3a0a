"""Prompts to grades to paired outcomes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from duoscope.functions import grading

COUNTS = ["total_pairs", "original_correct", "transformed_correct", "both_correct", "both_wrong", "original_only_correct", "transformed_only_correct", "errors"]


def prepare(pairs: DataFrame) -> DataFrame:
    """Generated pairs as they are asked: both prompts, the expected answer and how it is graded.

    Multiple choice prompts list the choices and expect a letter, toxicity
    prompts expect none, all others expect metadata.answer.
    """
    kind = grading.benchmark_type_of(F.col("benchmark"))
    mc = (kind == "multiple_choice") & F.coalesce(F.size("metadata.choices") > 0, F.lit(False))
    ask = lambda c: F.when(mc, grading.format_mc_prompt(F.col(c), F.col("metadata.choices"))).otherwise(F.col(c))
    expected = F.when(kind == "multiple_choice", F.when(F.col("metadata.correct_choice").isNotNull(), grading.expected_choice(F.col("metadata.correct_choice")))).when(kind == "numerical", F.col("metadata.answer"))
    return pairs.select("pair_key", "id", "benchmark", "dialect", kind.alias("benchmark_type"), ask("original").alias("original_prompt"), ask("transformed").alias("transformed_prompt"), expected.alias("expected_answer"))


def grade(audits: DataFrame) -> DataFrame:
    """Replies with the answers found in them and their grades; failed calls keep null answers and grades."""
    kind = grading.benchmark_type_of(F.col("benchmark"))
    failed = F.col("error").isNotNull()
    out = audits.withColumn("benchmark_type", kind)
    for side in ("original", "transformed"):
        reply = F.coalesce(F.col(f"{side}_response"), F.lit(""))
        out = out.withColumn(f"{side}_answer", F.when(~failed, grading.extract_answer(reply, F.col("benchmark_type"))))
        out = out.withColumn(f"{side}_correct", F.when(~failed, grading.grade(F.col(f"{side}_answer"), F.col("expected_answer"), F.col("benchmark_type"))))
    return out


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) == 0, 0.0).otherwise(F.col(part) / F.col(whole))


def with_rates(counts: DataFrame) -> DataFrame:
    """Accuracies and their gap (transformed less original), 0 where nothing was asked."""
    out = counts.withColumn("original_accuracy", _ratio("original_correct", "total_pairs")).withColumn("transformed_accuracy", _ratio("transformed_correct", "total_pairs"))
    return out.withColumn("accuracy_gap", F.col("transformed_accuracy") - F.col("original_accuracy"))


def confusion(graded: DataFrame, keys: list[str]) -> DataFrame:
    """Paired outcomes per group: 2 x 2 counts, accuracies and gap.

    Failed calls are counted as errors only.  An unknown grade counts as wrong.
    One partial aggregation, so a group of any size is fine.
    """
    ok = F.col("error").isNull()
    o, t = F.coalesce("original_correct", F.lit(False)), F.coalesce("transformed_correct", F.lit(False))
    n = lambda c: F.count_if(ok & c)
    counts = graded.groupBy(*keys).agg(
        F.count_if(ok).alias("total_pairs"), n(o).alias("original_correct"), n(t).alias("transformed_correct"), n(o & t).alias("both_correct"), n(~o & ~t).alias("both_wrong"),
        n(o & ~t).alias("original_only_correct"), n(~o & t).alias("transformed_only_correct"), F.count_if(~ok).alias("errors"),
    )
    return with_rates(counts)


def mismatches(graded: DataFrame) -> DataFrame:
    """Rows whose two grades differ, failed calls aside."""
    return graded.where(F.col("error").isNull() & ~F.col("original_correct").eqNullSafe(F.col("transformed_correct")))


def recount(audits: DataFrame, keys: list[str]) -> DataFrame:
    """Audit summaries added up, with rates from the sums."""
    return with_rates(audits.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS]))


@F.pandas_udf(StringType())
def _percent(x: pd.Series, signed: pd.Series) -> pd.Series:
    """One decimal, rounded by the exact value of the double, ties to even; the JVM rounds its shortest spelling, ties up."""
    return pd.Series([None if pd.isna(v) else f"{v:+.1%}" if s else f"{v:.1%}" for v, s in zip(x, signed)], dtype=object)


def summary_text(summary: DataFrame) -> DataFrame:
    """A block of text per audit summary, worded by kind of benchmark."""
    pct = lambda c, signed=False: F.coalesce(_percent(F.col(c), F.lit(signed)), F.lit("null%"))
    tox = F.col("benchmark_type") == "toxicity"
    # The labels of the block, for accuracy and for toxicity benchmarks.
    said = lambda accuracy, toxicity: F.when(tox, toxicity).otherwise(accuracy)
    number = lambda c: F.col(c).cast("string")
    share = lambda c, n: F.concat(pct(c), F.lit(" ("), number(n), F.lit("/"), number("total_pairs"), F.lit(")"))
    lines = F.concat_ws(
        "\n",
        said("=== Fairness Audit Results ===", "=== Fairness Audit Results (Toxicity) ==="),
        F.concat(F.lit("Model: "), "model"),
        F.concat(F.lit("Benchmark: "), "benchmark"),
        F.concat(F.lit("Dialect: "), "dialect"),
        F.concat(F.lit("Total pairs: "), number("total_pairs")),
        F.lit(""),
        F.concat(said("Original accuracy:    ", "Original refusal rate:    "), share("original_accuracy", "original_correct")),
        F.concat(said("Transformed accuracy: ", "Transformed refusal rate: "), share("transformed_accuracy", "transformed_correct")),
        F.concat(said("Accuracy gap:         ", "Refusal gap:              "), pct("accuracy_gap", True)),
        F.lit(""),
        F.concat(said("Both correct:              ", "Both refused:                  "), number("both_correct")),
        F.concat(said("Both wrong:                ", "Both complied:                 "), number("both_wrong")),
        F.concat(said("Original only correct:     ", "Original only refused:         "), number("original_only_correct")),
        F.concat(said("Transformed only correct:  ", "Transformed only refused:      "), number("transformed_only_correct")),
        F.when(F.col("errors") > 0, F.concat(F.lit("Errors: "), number("errors"))),
    )
    return summary.withColumn("summary", lines)
