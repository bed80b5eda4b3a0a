"""Statistics of paired outcomes, as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Discordant pairs from which the chi-squared form of the test is used.
EXACT_BELOW = 25


def mcnemar_statistic(b: Column, c: Column, exact_below: int = EXACT_BELOW, continuity: bool = True) -> Column:
    """Test statistic: null without discordant pairs, the smaller count in the exact form, else chi-squared."""
    n = b + c
    gap = F.abs(b - c).cast("double") - (1.0 if continuity else 0.0)
    return F.when(n == 0, F.lit(None)).when(n < exact_below, F.least(b, c).cast("double")).otherwise(gap * gap / n)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact p: twice the lower binomial tail at one half, at most 1."""
    n, k = b + c, F.least(b, c)
    step = lambda a, i: F.struct((a["term"] * (n - i + 1) / i).alias("term"), (a["total"] + a["term"] * (n - i + 1) / i).alias("total"))
    begin = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.pow(F.lit(0.5), n).alias("total"))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), 2.0 * F.aggregate(steps, begin, step)["total"])


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    """Upper tail of chi-squared with one degree of freedom; there is no erf among the SQL functions."""
    return x.map(lambda v: 1.0 - math.erf(math.sqrt(v / 2.0)) if v is not None and v == v else None)


def mcnemar_method(b: Column, c: Column, exact_below: int = EXACT_BELOW) -> Column:
    """exact or chi2."""
    return F.when(b + c < exact_below, "exact").otherwise("chi2")


def mcnemar_p(b: Column, c: Column, exact_below: int = EXACT_BELOW, continuity: bool = True) -> Column:
    """p-value of McNemar's test: 1 without discordant pairs."""
    n = b + c
    stat = mcnemar_statistic(b, c, exact_below, continuity)
    tail = chi2_tail(F.when(n >= exact_below, stat))
    return F.when(n == 0, 1.0).when(n < exact_below, mcnemar_exact(b, c)).otherwise(tail)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Dot product over norms, 0 where a norm is 0, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def significance_marker(p: Column) -> Column:
    """Two stars under 0.01, one under 0.05, else nothing."""
    return F.when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
