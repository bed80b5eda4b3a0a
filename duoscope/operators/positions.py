"""Positions of rows in a total order, without a task that holds them all."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscope.runtime import materialize


def with_index(df: DataFrame, order: list[Column | str], by: list[str] | None = None) -> DataFrame:
    """Positions from 0 in a total order.

    Rows are range partitioned by ``by`` and ``order``, numbered in their
    partition and counted, so that no task has to hold all of them or all of a
    group.  The ranged rows are written once, since range bounds are drawn from
    a sample and would differ between two computations.  Within ``by`` each
    group counts from 0.  Ties in ``order`` are numbered in any order.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in [*(by or []), *order]]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    part, offset = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    ranged = materialize(ranged.withColumn("_part", part).withColumn("_offset", offset).drop("_at"))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    out = ranged.join(F.broadcast(before), "_part", "left").withColumn("idx", F.col("_before") + F.col("_offset"))
    if by:
        first = out.groupBy(*by).agg(F.min("idx").alias("_first"))  # a row per group
        same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
        out = out.join(first.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_first"), reduce(and_, same)).withColumn("idx", F.col("idx") - F.col("_first")).drop("_first", *[f"_by_{c}" for c in by])
    return out.drop("_part", "_offset", "_before")
