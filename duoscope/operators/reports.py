"""Tables and chart data from audit summaries and graded pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscope.functions import labels
from duoscope.functions.stats import significance_marker


def means(audits: DataFrame, keys: list[str]) -> DataFrame:
    """Unweighted means of accuracies and gap, and all pairs, per group."""
    return audits.groupBy(*keys).agg(
        F.avg("original_accuracy").alias("original_accuracy"), F.avg("transformed_accuracy").alias("transformed_accuracy"), F.avg("accuracy_gap").alias("accuracy_gap"), F.sum("total_pairs").alias("total_pairs")
    )


def grid(audits: DataFrame, benchmarks: list[str], dialects: list[str] = labels.DIALECT_ORDER) -> DataFrame:
    """Every benchmark and dialect of every model there is."""
    full = audits.select("model").distinct()
    full = full.withColumn("benchmark", F.explode(F.array(*[F.lit(b) for b in benchmarks])))
    return full.withColumn("dialect", F.explode(F.array(*[F.lit(d) for d in dialects])))


def benchmark_table(audits: DataFrame, benchmarks: list[str], missing: float | None = 0.0, digits: int | None = 1) -> DataFrame:
    """A row per benchmark and model: SAE, mean over dialects, each dialect, in percent.

    Missing cells count as ``missing`` or stay null and out of the means;
    values are rounded half to even.
    """
    cells = grid(audits, benchmarks).join(audits.select("model", "benchmark", "dialect", "original_accuracy", "transformed_accuracy"), ["model", "benchmark", "dialect"], "left")
    for c in ("original_accuracy", "transformed_accuracy"):
        v = F.col(c) * 100.0
        cells = cells.withColumn(c, v if missing is None else F.coalesce(v, F.lit(missing)))
    show = lambda c: c if digits is None else F.bround(c, digits)
    per = [show(F.max(F.when(F.col("dialect") == d, F.col("transformed_accuracy")))).alias(d) for d in labels.DIALECT_ORDER]
    return cells.groupBy("benchmark", "model").agg(show(F.avg("original_accuracy")).alias("sae"), show(F.avg("transformed_accuracy")).alias("mean"), *per)


def pivot(audits: DataFrame, row: str, column: str, values: list[str], value: str, scale: float = 1.0) -> DataFrame:
    """A matrix with one column per listed value; a second row for a cell raises."""
    cell = lambda v: F.when(F.col(column) == v, F.col(value) * scale)
    once = lambda v: F.when(F.count(cell(v)) > 1, F.raise_error(F.lit(f"duplicate {row}, {column} {v}")).cast("double")).otherwise(F.max(cell(v)))
    return audits.groupBy(row).agg(*[once(v).alias(v) for v in values])


def top_gaps(audits: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The n smallest gaps."""
    return audits.orderBy("accuracy_gap", *keys).limit(n)


def with_feature_counts(graded: DataFrame, pairs: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Graded rows with the feature count of the generated pair they ask; of repeated pairs the last one counts.

    Rows without a pair are dropped.  Pairs are reduced to one row per key
    before the join.
    """
    from duoscope.operators.shards import first_per_key

    last = first_per_key(pairs.select(*keys, "feature_count", *[c for c in order if isinstance(c, str)]), keys, [F.desc(c) if isinstance(c, str) else c for c in order])
    return graded.join(last.select(*keys, F.coalesce("feature_count", F.lit(1)).alias("features")), keys)


def _cell() -> list[Column]:
    o, t = F.coalesce("original_correct", F.lit(False)).cast("int"), F.coalesce("transformed_correct", F.lit(False)).cast("int")
    return [F.count("*").alias("n"), F.sum(o).alias("o"), F.sum(t).alias("t")]


def _accuracies(df: DataFrame) -> DataFrame:
    rate = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    return df.withColumn("original_accuracy", rate("o")).withColumn("transformed_accuracy", rate("t")).withColumn("gap_pp", (rate("t") - rate("o")) * 100).drop("o", "t")


def range_stats(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accuracies by number of features, in the ranges 1, 2, 3 and 4+; all four ranges appear, with zeros where empty."""
    keys = keys or []
    bucket = F.when(F.col("features") >= 4, "4+").when(F.col("features") >= 1, F.col("features").cast("string"))
    cells = rows.withColumn("range", bucket).where("range is not null").groupBy(*keys, "range").agg(*_cell())
    if keys:
        every = rows.select(*keys).distinct().withColumn("range", F.explode(F.array(*[F.lit(x) for x in ("1", "2", "3", "4+")])))
    else:
        every = rows.sparkSession.createDataFrame([("1",), ("2",), ("3",), ("4+",)], "range string")
    return _accuracies(every.join(cells, [*keys, "range"], "left").na.fill(0, ["n", "o", "t"]))


def threshold_stats(rows: DataFrame) -> DataFrame:
    """Accuracies over rows with at least t features, for each t from 1 to the most there are.

    One histogram over the counts, then sums from the top: rows aren't repeated.
    """
    hist = rows.groupBy("features").agg(*_cell())
    steps = hist.agg(F.max("features").alias("m")).select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest("m", F.lit(1).cast("bigint")))).alias("threshold"))
    joined = steps.join(hist, hist["features"] >= steps["threshold"])  # a row per number of features on either side
    return _accuracies(joined.groupBy("threshold").agg(F.sum("n").alias("n"), F.sum("o").alias("o"), F.sum("t").alias("t")))


def suppress_small(stats: DataFrame, least: int = 10) -> DataFrame:
    """Gaps of groups with fewer rows than ``least`` are null."""
    return stats.withColumn("gap_pp", F.when(F.col("n") >= least, F.col("gap_pp")))


def significance_grid(audits: DataFrame, tests: DataFrame) -> DataFrame:
    """A row per benchmark and model: gap in points and marker for each dialect."""
    keys = ["model", "benchmark", "dialect"]
    cells = audits.select(*keys, (F.col("accuracy_gap") * 100).alias("gap")).join(tests.select(*keys, "p_adjusted"), keys, "left")
    per = []
    for d in labels.DIALECT_ORDER:
        here = F.col("dialect") == d
        per += [F.max(F.when(here, F.col("gap"))).alias(f"{d}_gap"), F.max(F.when(here, significance_marker(F.col("p_adjusted")))).alias(f"{d}_marker")]
    return cells.groupBy("benchmark", "model").agg(*per)


def bias_by_class(audits: DataFrame) -> DataFrame:
    """Mean gap per dialect over accuracy and over toxicity benchmarks, 0 where there is none."""
    of = lambda names: F.coalesce(F.avg(F.when(F.col("benchmark").isin(names), F.col("accuracy_gap"))), F.lit(0.0))
    return audits.groupBy("dialect").agg(of(labels.ACCURACY_BENCHMARKS).alias("accuracy_bias"), of(labels.TOXICITY_BENCHMARKS).alias("toxicity_bias"))
