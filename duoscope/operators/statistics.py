"""Tests over audit summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscope.functions import stats


def mcnemar_audits(audits: DataFrame, b: str = "original_only_correct", c: str = "transformed_only_correct") -> DataFrame:
    """McNemar's test per summary: statistic, p_value, method and flags."""
    x, y = F.col(b), F.col(c)
    out = audits.withColumn("statistic", stats.mcnemar_statistic(x, y)).withColumn("method", stats.mcnemar_method(x, y)).withColumn("p_value", stats.mcnemar_p(x, y))
    return out.withColumn("significant_05", F.col("p_value") < 0.05).withColumn("significant_01", F.col("p_value") < 0.01)


def bh_adjust(tests: DataFrame, p: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted p and its flags, within ``by`` or over all tests.

    The tests are summaries of groups, one per model, benchmark and dialect, so
    a family of them is small; ties in p share their adjusted value whatever
    the order.
    """
    family = [F.col(k) for k in by or []]
    ordered = Window.partitionBy(*family).orderBy(p, *order) if family else Window.orderBy(p, *order)
    whole = Window.partitionBy(*family)
    ranked = tests.withColumn("_raw", F.col(p) * F.count("*").over(whole) / F.row_number().over(ordered))
    from_here = F.min("_raw").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    out = ranked.withColumn("p_adjusted", F.least(F.lit(1.0), from_here)).drop("_raw")
    return out.withColumn("bh_significant_05", F.col("p_adjusted") < 0.05).withColumn("bh_significant_01", F.col("p_adjusted") < 0.01)


def bootstrap_gap(graded: DataFrame, keys: list[str], resamples: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Observed gap and percentile interval of its bootstrap distribution per group.

    Rows whose grades are both known enter.  A resample of n pairs is a draw of
    the counts of the four outcomes, so the groups are reduced to four counts
    each by one aggregation and nothing larger than that is resampled.
    """
    known = graded.where("original_correct is not null and transformed_correct is not null and error is null")
    o, t = F.col("original_correct"), F.col("transformed_correct")
    counts = known.groupBy(*keys).agg(
        F.count_if(o & t).alias("n11"), F.count_if(o & ~t).alias("n10"), F.count_if(~o & t).alias("n01"), F.count_if(~o & ~t).alias("n00")
    )
    schema = counts.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", gap double, ci_low double, ci_high double"

    def run(batches):
        for pdf in batches:
            rows = []
            for cells in pdf[["n11", "n10", "n01", "n00"]].to_numpy(float):
                n = cells.sum()
                draws = np.random.Generator(np.random.PCG64(seed)).multinomial(int(n), cells / n, size=resamples)
                gaps = (draws[:, 2] - draws[:, 1]) / n
                low, high = np.percentile(gaps, [50 * (1 - confidence), 50 * (1 + confidence)])
                rows.append(((cells[2] - cells[1]) / n, low, high))
            yield pdf.assign(**dict(zip(("gap", "ci_low", "ci_high"), np.array(rows).reshape(-1, 3).T))) if len(pdf) else pdf.assign(gap=pd.Series(dtype=float), ci_low=pd.Series(dtype=float), ci_high=pd.Series(dtype=float))

    return counts.mapInPandas(run, schema)


def significant(p: Column) -> Column:
    return stats.significance_marker(p)
