"""Shards and re-runs of the same work: which row or file counts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscope.functions import labels
from duoscope.operators import audit
from duoscope.operators.positions import with_index


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a total order; one partial pass drops most rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def dedup_first_id(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """Union of shards with the first row kept per id, in the order of shards and rows."""
    return first_per_key(df, key, order)


def with_name_parts(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Files with the parts of their names; names of another form are left out."""
    return files.withColumn("_p", labels.parse_audit_file(F.col(name))).where("_p is not null").select("*", "_p.*").drop("_p")


def latest_wins(files: DataFrame, keys: list[str]) -> DataFrame:
    """The file with the greatest stamp per key; combined files beat any stamp, the first name breaks ties."""
    return first_per_key(files, keys, [F.desc("stamp"), F.asc("file_name"), F.asc("file_id")])


def earliest_wins(files: DataFrame, keys: list[str]) -> DataFrame:
    """The file whose name sorts first per key, unless there are combined ones: then the last of those."""
    return first_per_key(files, keys, [F.desc("combined"), F.when(F.col("combined"), F.col("file_name")).desc_nulls_last(), F.asc("file_name"), F.asc("file_id")])


def most_successful(files: DataFrame, keys: list[str], successful: str = "successful") -> DataFrame:
    """All files with ``keep``: whether it has the most error-free pairs of its key, the greatest name breaking ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc(successful), F.desc("file_name"), F.desc("file_id"))
    return files.withColumn("keep", F.row_number().over(w) == 1)


def combine_audits(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Shards of audits as one: first row per id, then counted anew."""
    return audit.confusion(dedup_first_id(rows, [*keys, "id"], order), keys)


def require_same(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows, unless they differ in any of the columns that shards must share: then ValueError."""
    if df.agg(F.count_distinct(F.struct(*columns)).alias("n")).first()["n"] > 1:
        raise ValueError(f"shards differ in {', '.join(columns)}")
    return df


def work_list(planned: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Planned work that isn't finished."""
    return planned.join(finished.select(*keys).distinct(), keys, "left_anti")


def slice_rows(df: DataFrame, order: list[Column | str], by: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """Positions [start, end) of each group in a total order, counted from 0; negative bounds count from the end."""
    out = with_index(df, order, by)
    bound = lambda v: F.lit(v) if v >= 0 else F.greatest(F.col("_n") + v, F.lit(0))
    if min(start or 0, end or 0) < 0:
        sizes = out.groupBy(*by).agg(F.count("*").alias("_n")).select(*[F.col(c).alias(f"_by_{c}") for c in by], "_n")  # a row per group
        out = out.join(sizes, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])).drop(*[f"_by_{c}" for c in by])
    if start is not None:
        out = out.where(F.col("idx") >= bound(start))
    if end is not None:
        out = out.where(F.col("idx") < bound(end))
    return out.drop("_n")
