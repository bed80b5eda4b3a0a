"""Queries on audits: paired outcomes, tests, tables and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duoscope.functions import grading, labels, stats
from duoscope.operators import audit, generation, reports, shards, statistics
from duoscope.plans.base import Plan, r, rounded
from duoscope.runtime import table
from duoscope.sources import benchmarks

PLAN = Plan()
KEYS = ["model", "benchmark", "dialect"]
#: Model of the single-model tables.
ONE = "heron-instruct"

_OK = "error is null"
_O, _T = "coalesce(original_correct, false)", "coalesce(transformed_correct, false)"
_CONFUSION = f"""count(*) filter ({_OK}) as total_pairs, count(*) filter ({_OK} and {_O}) as original_correct, count(*) filter ({_OK} and {_T}) as transformed_correct,
  count(*) filter ({_OK} and {_O} and {_T}) as both_correct, count(*) filter ({_OK} and not {_O} and not {_T}) as both_wrong, count(*) filter ({_OK} and {_O} and not {_T}) as original_only_correct,
  count(*) filter ({_OK} and not {_O} and {_T}) as transformed_only_correct, count(*) filter (not {_OK}) as errors"""
_RATES = f"""{r('coalesce(original_correct / nullif(total_pairs, 0), 0)')} as original_accuracy, {r('coalesce(transformed_correct / nullif(total_pairs, 0), 0)')} as transformed_accuracy,
  {r('coalesce(transformed_correct / nullif(total_pairs, 0), 0) - coalesce(original_correct / nullif(total_pairs, 0), 0)')} as accuracy_gap"""
_LATEST = "latest as (select * from audits qualify row_number() over (partition by model, benchmark, dialect order by audit_time desc, audit_id desc) = 1)"


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns({c: rounded(c) for c in ("original_accuracy", "transformed_accuracy", "accuracy_gap")})


def _latest(spark: SparkSession, root: str) -> DataFrame:
    return shards.first_per_key(table(spark, root, "audits"), KEYS, [F.desc("audit_time"), F.desc("audit_id")])


def _one(spark: SparkSession, root: str) -> DataFrame:
    return _latest(spark, root).where(F.col("model") == ONE)


@PLAN.query(f"with c as (select model, benchmark, dialect, {_CONFUSION} from audit_pairs group by all) select *, {_RATES} from c")
def audit_confusion(spark: SparkSession, root: str) -> DataFrame:
    return _shown(audit.confusion(table(spark, root, "audit_pairs"), KEYS))


_FIRST = f"""with d as (select * from audit_pairs qualify row_number() over (partition by audit_id, model, benchmark, dialect, id order by loaded_at, audit_key) = 1)"""


@PLAN.query(f"{_FIRST}, c as (select model, benchmark, dialect, audit_id, {_CONFUSION} from d group by all) select *, {_RATES} from c")
def combine_audits(spark: SparkSession, root: str) -> DataFrame:
    """Each audit's rows, first delivery of each id, counted anew."""
    return _shown(shards.combine_audits(table(spark, root, "audit_pairs"), ["audit_id", *KEYS], ["loaded_at", "audit_key"]))


@PLAN.query(f"{_FIRST} select audit_key, audit_id, id from d")
def dedup_first_id(spark: SparkSession, root: str) -> DataFrame:
    return shards.dedup_first_id(table(spark, root, "audit_pairs"), ["audit_id", *KEYS, "id"], ["loaded_at", "audit_key"]).select("audit_key", "audit_id", "id")


@PLAN.query(f"select audit_key from audit_pairs where {_OK} and original_correct is distinct from transformed_correct")
def filter_mismatches(spark: SparkSession, root: str) -> DataFrame:
    return audit.mismatches(table(spark, root, "audit_pairs")).select("audit_key")


@PLAN.query("select audit_key from audit_pairs where original_correct is not null and transformed_correct is not null")
def filter_known_correctness(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "audit_pairs").where("original_correct is not null and transformed_correct is not null").select("audit_key")


@PLAN.query(f"with {_LATEST} select audit_id, benchmark, dialect, model from latest")
def latest_audits(spark: SparkSession, root: str) -> DataFrame:
    return _latest(spark, root).select("audit_id", "benchmark", "dialect", "model")


@PLAN.query(
    "select benchmark, dialect, model, total_pairs, original_correct, transformed_correct, round(original_accuracy, 6) + 0.0 as original_accuracy, round(transformed_accuracy, 6) + 0.0 as transformed_accuracy, round(accuracy_gap, 6) + 0.0 as accuracy_gap, benchmark_type, errors from audits"
)
def audits_frame(spark: SparkSession, root: str) -> DataFrame:
    return _shown(table(spark, root, "audits").select("benchmark", "dialect", "model", "total_pairs", "original_correct", "transformed_correct", "original_accuracy", "transformed_accuracy", "accuracy_gap", "benchmark_type", "errors"))


@PLAN.query(
    f"""with s as (select benchmark, dialect, model, sum(total_pairs)::bigint as total_pairs, sum(original_correct)::bigint as original_correct, sum(transformed_correct)::bigint as transformed_correct, sum(both_correct)::bigint as both_correct,
  sum(both_wrong)::bigint as both_wrong, sum(original_only_correct)::bigint as original_only_correct, sum(transformed_only_correct)::bigint as transformed_only_correct, sum(errors)::bigint as errors from audits group by all) select *, {_RATES} from s"""
)
def recount_audits(spark: SparkSession, root: str) -> DataFrame:
    return _shown(audit.recount(table(spark, root, "audits"), ["benchmark", "dialect", "model"]))


@PLAN.query()
def audit_summary_text(spark: SparkSession, root: str) -> DataFrame:
    """Over all audits; no SQL, since engines round percentages that lie between two tenths differently."""
    return audit.summary_text(table(spark, root, "audits")).select("audit_id", "summary")


def _means_sql(keys: str, source: str = "audits") -> str:
    k = keys + ", " if keys else ""
    return f"select {k}{r('avg(original_accuracy)')} as original_accuracy, {r('avg(transformed_accuracy)')} as transformed_accuracy, {r('avg(accuracy_gap)')} as accuracy_gap, sum(total_pairs)::bigint as total_pairs from {source}" + (f" group by {keys}" if keys else "")


@PLAN.query(_means_sql("dialect"))
def dialect_means(spark: SparkSession, root: str) -> DataFrame:
    return _shown(reports.means(table(spark, root, "audits"), ["dialect"]))


@PLAN.query(_means_sql("benchmark"))
def benchmark_means(spark: SparkSession, root: str) -> DataFrame:
    return _shown(reports.means(table(spark, root, "audits"), ["benchmark"]))


@PLAN.query(_means_sql(""))
def overall_means(spark: SparkSession, root: str) -> DataFrame:
    return _shown(reports.means(table(spark, root, "audits"), []))


@PLAN.query("select count(distinct dialect) as dialects, count(distinct benchmark) as benchmarks, count(distinct model) as models from audits")
def count_distinct_dims(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "audits").agg(F.count_distinct("dialect").alias("dialects"), F.count_distinct("benchmark").alias("benchmarks"), F.count_distinct("model").alias("models"))


_ACC = ", ".join(f"'{b}'" for b in labels.ACCURACY_BENCHMARKS)
_TOX = ", ".join(f"'{b}'" for b in labels.TOXICITY_BENCHMARKS)


@PLAN.query(f"select dialect, {r('avg(original_accuracy) * 100')} as sae_pct, {r('avg(transformed_accuracy) * 100')} as dialect_pct from audits where benchmark in ({_ACC}) group by dialect")
def dialect_summary_pct(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "audits").where(F.col("benchmark").isin(labels.ACCURACY_BENCHMARKS))
    return df.groupBy("dialect").agg(rounded(F.avg("original_accuracy") * 100).alias("sae_pct"), rounded(F.avg("transformed_accuracy") * 100).alias("dialect_pct"))


@PLAN.query(
    f"select dialect, {r(f'coalesce(avg(accuracy_gap) filter (benchmark in ({_ACC})), 0)')} as accuracy_bias, {r(f'coalesce(avg(accuracy_gap) filter (benchmark in ({_TOX})), 0)')} as toxicity_bias from audits group by dialect"
)
def overall_bias(spark: SparkSession, root: str) -> DataFrame:
    return reports.bias_by_class(table(spark, root, "audits")).select("dialect", rounded("accuracy_bias").alias("accuracy_bias"), rounded("toxicity_bias").alias("toxicity_bias"))


@PLAN.query("select audit_id, benchmark from audits where benchmark in (" + _TOX + ")")
def filter_benchmark_class(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "audits").where(F.col("benchmark").isin(labels.TOXICITY_BENCHMARKS)).select("audit_id", "benchmark")


def _cells_sql(missing: str, wanted: list[str] = labels.ACCURACY_BENCHMARKS, shown: str = r("{}")) -> str:
    fill = (lambda c: f"coalesce({c}, 0)") if missing == "0" else (lambda c: c)
    return f"""with {_LATEST}, g as (select m.model, b.benchmark, d.dialect from (select distinct model from latest) m, (select unnest({wanted}) as benchmark) b, (select unnest({labels.DIALECT_ORDER}) as dialect) d),
cells as (select g.*, {fill('l.original_accuracy * 100')} as o, {fill('l.transformed_accuracy * 100')} as t from g left join latest l using (model, benchmark, dialect))
select benchmark, model, {shown.format('avg(o)')} as sae, {shown.format('avg(t)')} as mean, {', '.join(f"{shown.format(f'max(t) filter (dialect = {chr(39)}{d}{chr(39)})')} as {d}" for d in labels.DIALECT_ORDER)} from cells group by all"""


def _table(spark: SparkSession, root: str, missing: float | None, wanted: list[str] = labels.ACCURACY_BENCHMARKS) -> DataFrame:
    out = reports.benchmark_table(_latest(spark, root), wanted, missing, None)
    return out.select("benchmark", "model", *[rounded(c).alias(c) for c in ("sae", "mean", *labels.DIALECT_ORDER)])


@PLAN.query(_cells_sql("0"))
def join_grid_left(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root, 0.0)


@PLAN.query(_cells_sql(""))
def join_grid_null(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root, None)


@PLAN.query(_cells_sql("0", shown="round_even({}, 1)"))
def benchmark_table(spark: SparkSession, root: str) -> DataFrame:
    """Rounded half to even to one decimal, missing cells 0."""
    return reports.benchmark_table(_latest(spark, root), labels.ACCURACY_BENCHMARKS)


@PLAN.query(_cells_sql("", labels.TOXICITY_BENCHMARKS))
def toxicity_table(spark: SparkSession, root: str) -> DataFrame:
    """The same for refusal rates, missing cells null."""
    return _table(spark, root, None, labels.TOXICITY_BENCHMARKS)


def _pivot_sql(value: str, cols: list[str], scale: str = "") -> str:
    cells = ", ".join(f"{r(f'''max({value}{scale}) filter (benchmark = '{b}')''')} as {b}" for b in cols)
    return f"with {_LATEST} select dialect, {cells} from latest where model = '{ONE}' group by dialect"


def _pivot(spark: SparkSession, root: str, value: str, cols: list[str], scale: float = 1.0) -> DataFrame:
    out = reports.pivot(_one(spark, root), "dialect", "benchmark", cols, value, scale)
    return out.select("dialect", *[rounded(c).alias(c) for c in cols])


@PLAN.query(_pivot_sql("transformed_accuracy", labels.ACCURACY_BENCHMARKS))
def pivot_accuracy(spark: SparkSession, root: str) -> DataFrame:
    return _pivot(spark, root, "transformed_accuracy", labels.ACCURACY_BENCHMARKS)


@PLAN.query(_pivot_sql("original_accuracy", labels.ACCURACY_BENCHMARKS))
def pivot_accuracy_sae(spark: SparkSession, root: str) -> DataFrame:
    return _pivot(spark, root, "original_accuracy", labels.ACCURACY_BENCHMARKS)


@PLAN.query(_pivot_sql("accuracy_gap", [*grading.BENCHMARK_TYPES]))
def pivot_gap(spark: SparkSession, root: str) -> DataFrame:
    return _pivot(spark, root, "accuracy_gap", [*grading.BENCHMARK_TYPES])


@PLAN.query(_pivot_sql("accuracy_gap", labels.TOXICITY_BENCHMARKS, " * 100"))
def pivot_gap_pp(spark: SparkSession, root: str) -> DataFrame:
    return _pivot(spark, root, "accuracy_gap", labels.TOXICITY_BENCHMARKS, 100.0)


@PLAN.query(f"with {_LATEST} select benchmark, dialect, {r('coalesce(max(original_accuracy), 0) * 100')} as sae_pct, {r('coalesce(max(transformed_accuracy), 0) * 100')} as dialect_pct from latest where model = '{ONE}' and benchmark in ({_TOX}) group by all")
def toxicity_bars(spark: SparkSession, root: str) -> DataFrame:
    df = _one(spark, root).where(F.col("benchmark").isin(labels.TOXICITY_BENCHMARKS))
    pct = lambda c: rounded(F.coalesce(F.max(c), F.lit(0.0)) * 100)
    return df.groupBy("benchmark", "dialect").agg(pct("original_accuracy").alias("sae_pct"), pct("transformed_accuracy").alias("dialect_pct"))


@PLAN.query(
    f"""with {_LATEST} select dialect, {r(f"coalesce(max(accuracy_gap) filter (model = '{ONE}'), 0) * 100")} as first_gap, {r("coalesce(max(accuracy_gap) filter (model = 'quill-7b'), 0) * 100")} as second_gap from latest where benchmark = 'gsm8k' group by dialect"""
)
def join_cross_model(spark: SparkSession, root: str) -> DataFrame:
    """Two models' gaps side by side; both lookups are one aggregation."""
    of = lambda m: rounded(F.coalesce(F.max(F.when(F.col("model") == m, F.col("accuracy_gap"))), F.lit(0.0)) * 100)
    return _latest(spark, root).where("benchmark = 'gsm8k'").groupBy("dialect").agg(of(ONE).alias("first_gap"), of("quill-7b").alias("second_gap"))


@PLAN.query(f"with {_LATEST} select audit_id, {r('accuracy_gap')} as accuracy_gap from latest order by latest.accuracy_gap, model, benchmark, dialect limit 5")
def topk_worst_gaps(spark: SparkSession, root: str) -> DataFrame:
    return reports.top_gaps(_latest(spark, root), 5, KEYS).select("audit_id", rounded("accuracy_gap").alias("accuracy_gap"))


@PLAN.query(f"with {_LATEST} select audit_id, row_number() over (order by abs(accuracy_gap), model, benchmark, dialect) as position from latest")
def sort_by_abs_gap(spark: SparkSession, root: str) -> DataFrame:
    """Positions in a chart; there is one row per model, benchmark and dialect to order."""
    w = Window.orderBy(F.abs("accuracy_gap"), *KEYS)
    return _latest(spark, root).select("audit_id", F.row_number().over(w).alias("position"))


@PLAN.query(f"with {_LATEST} select audit_id, row_number() over (order by benchmark, dialect, model) as position from latest")
def sort_all_results(spark: SparkSession, root: str) -> DataFrame:
    return _latest(spark, root).select("audit_id", F.row_number().over(Window.orderBy("benchmark", "dialect", "model")).alias("position"))


@PLAN.query(f"with {_LATEST} select audit_id, coalesce(list_position({labels.DIALECT_ORDER}, dialect), 4)::bigint as place from latest")
def custom_order(spark: SparkSession, root: str) -> DataFrame:
    return _latest(spark, root).select("audit_id", labels.order_of(F.col("dialect"), labels.DIALECT_ORDER).cast("bigint").alias("place"))


def _label_sql(c: str, names: dict[str, str]) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + f" else {c} end"


@PLAN.query(f"select distinct {_label_sql('benchmark', labels.BENCHMARK_LABELS)} as benchmark_label, {_label_sql('dialect', labels.DIALECT_LABELS)} as dialect_label, {_label_sql('model', labels.MODEL_LABELS)} as model_label from audits")
def label_names(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "audits")
    return df.select(labels.label(F.col("benchmark"), labels.BENCHMARK_LABELS).alias("benchmark_label"), labels.label(F.col("dialect"), labels.DIALECT_LABELS).alias("dialect_label"), labels.label(F.col("model"), labels.MODEL_LABELS).alias("model_label")).distinct()


@PLAN.query("select distinct dialect, array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(replace(dialect, '_', ' '), ' ')], ' ') as title from audits")
def label_title_case(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "audits").select("dialect", labels.title_case(F.col("dialect")).alias("title")).distinct()


@PLAN.query(
    f"select audit_id, {r('case when original_accuracy = 0 then 0 else least(abs(transformed_accuracy - original_accuracy) / original_accuracy, 0.5) / 0.5 end')} as shade, case when original_accuracy = 0 then 'grey' when transformed_accuracy > original_accuracy then 'blue' else 'orange' end as hue from audits"
)
def cell_shade(spark: SparkSession, root: str) -> DataFrame:
    o, t = F.col("original_accuracy"), F.col("transformed_accuracy")
    return table(spark, root, "audits").select("audit_id", rounded(labels.cell_shade(t, o)).alias("shade"), labels.cell_hue(t, o).alias("hue"))


@PLAN.query(f"with x as (select min(accuracy_gap) as lo, max(accuracy_gap) as hi from audits) select audit_id, {r('case when hi = lo then 0.5 else (accuracy_gap - lo) / (hi - lo) end')} as shade from audits, x")
def norm_shade(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "audits")
    ends = df.agg(F.min("accuracy_gap").alias("lo"), F.max("accuracy_gap").alias("hi")).first()  # two numbers
    return df.select("audit_id", rounded(labels.norm_shade(F.col("accuracy_gap"), F.lit(ends["lo"]), F.lit(ends["hi"]))).alias("shade"))


@PLAN.query(f"select {r('max(abs(accuracy_gap))')} as most, {r('min(transformed_accuracy)')} as lo, {r('max(transformed_accuracy)')} as hi from audits")
def scale_extent(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "audits").agg(rounded(F.max(F.abs("accuracy_gap"))).alias("most"), rounded(F.min("transformed_accuracy")).alias("lo"), rounded(F.max("transformed_accuracy")).alias("hi"))


# --- tests


_B, _C = "original_only_correct", "transformed_only_correct"
_EXACT = f"least(1.0, 2.0 * list_sum([exp(lgamma(({_B} + {_C}) + 1) - lgamma(k + 1) - lgamma(({_B} + {_C}) - k + 1) - ({_B} + {_C}) * ln(2)) for k in range(0, least({_B}, {_C}) + 1)]))"
_STAT = f"case when {_B} + {_C} = 0 then null when {_B} + {_C} < 25 then least({_B}, {_C})::double else power(abs({_B} - {_C}) - 1, 2) / ({_B} + {_C}) end"


# the tail of chi-squared with one degree of freedom from the series of erf whose terms are all positive
_Z = f"sqrt(({_STAT}) / 2)"
_ERF = f"(2 / sqrt(pi()) * exp(-({_STAT}) / 2) * list_sum([exp(2 * k * ln(2.0) + (2 * k + 1) * ln({_Z}) - lgamma(2 * k + 2) + lgamma(k + 1)) for k in range(0, 300)]))"
_P = f"case when {_B} + {_C} = 0 then 1.0 when {_B} + {_C} < 25 then {_EXACT} when {_STAT} = 0 then 1.0 when {_STAT} > 60 then 0.0 else 1 - {_ERF} end"
_METHOD = f"case when {_B} + {_C} < 25 then 'exact' else 'chi2' end"


def _bh_sql(source: str, key: str) -> str:
    """Adjusted p over all rows of ``source``, which has p."""
    return f"select *, {r(f'least(1.0, min(p * m / rank) over (order by p, {key} rows between current row and unbounded following))')} as p_adjusted from (select *, count(*) over () as m, row_number() over (order by p, {key}) as rank from {source})"


@PLAN.query(f"select audit_id, {r(_STAT)} as statistic, {_METHOD} as method, {r(_P)} as p_value from audits")
def mcnemar(spark: SparkSession, root: str) -> DataFrame:
    """Statistic and p of every audit."""
    b, c = F.col(_B), F.col(_C)
    return table(spark, root, "audits").select("audit_id", rounded(stats.mcnemar_statistic(b, c)).alias("statistic"), stats.mcnemar_method(b, c).alias("method"), rounded(stats.mcnemar_p(b, c)).alias("p_value"))


@PLAN.query(f"with {_LATEST} select model, benchmark, dialect, audit_id, {r(_STAT)} as statistic, {r(_P)} as p_value, {_METHOD} as method, ({_P}) < 0.05 as significant_05, ({_P}) < 0.01 as significant_01 from latest")
def mcnemar_audits(spark: SparkSession, root: str) -> DataFrame:
    """All p-values, with flags, in their order."""
    out = statistics.mcnemar_audits(_latest(spark, root)).orderBy("p_value", *KEYS)
    return out.select(*KEYS, "audit_id", rounded("statistic").alias("statistic"), rounded("p_value").alias("p_value"), "method", "significant_05", "significant_01")


@PLAN.query(f"select audit_id, p_adjusted from ({_bh_sql(f'(select audit_id, round({_P}, 9) as p from audits)', 'audit_id')})")
def bh_adjust(spark: SparkSession, root: str) -> DataFrame:
    """Over all audits: one family of exact and chi-squared tests."""
    tests = table(spark, root, "audits").select("audit_id", F.round(stats.mcnemar_p(F.col(_B), F.col(_C)), 9).alias("p"))
    return statistics.bh_adjust(tests, "p", ["audit_id"]).select("audit_id", rounded("p_adjusted").alias("p_adjusted"))


_SIGNIFICANCE = f"with c as (select model, benchmark, dialect, {_CONFUSION} from audit_pairs group by all), t as (select *, {_P} as p from c)"


@PLAN.query(
    f"""{_SIGNIFICANCE}, j as ({_bh_sql('t', 'model, benchmark, dialect')})
select model, benchmark, dialect, total_pairs, {r('coalesce(transformed_correct / nullif(total_pairs, 0), 0) - coalesce(original_correct / nullif(total_pairs, 0), 0)')} as accuracy_gap, {r(_STAT)} as statistic,
  {_METHOD} as method, {r('p')} as p_value, p_adjusted, case when p_adjusted < 0.01 then '**' when p_adjusted < 0.05 then '*' else '' end as marker from j"""
)
def significance(spark: SparkSession, root: str) -> DataFrame:
    """Paired confusion, McNemar's test and adjusted p per model, benchmark and dialect."""
    counts = audit.confusion(table(spark, root, "audit_pairs"), KEYS)
    tests = statistics.bh_adjust(statistics.mcnemar_audits(counts), "p_value", KEYS)
    shown = [rounded(c).alias(c) for c in ("statistic", "p_value", "p_adjusted")]
    tests = tests.orderBy("p_adjusted", *KEYS)
    return tests.select(*KEYS, "total_pairs", rounded("accuracy_gap").alias("accuracy_gap"), *shown, "method", stats.significance_marker(rounded("p_adjusted")).alias("marker"))


@PLAN.query()
def significance_grid(spark: SparkSession, root: str) -> DataFrame:
    """Gap and marker of each dialect, a row per benchmark and model."""
    latest = _latest(spark, root)
    return reports.significance_grid(latest, statistics.bh_adjust(statistics.mcnemar_audits(latest), "p_value", KEYS))


@PLAN.query(
    """select model, benchmark, dialect, count(*) filter (original_correct and transformed_correct) as n11, count(*) filter (original_correct and not transformed_correct) as n10,
  count(*) filter (not original_correct and transformed_correct) as n01, count(*) filter (not original_correct and not transformed_correct) as n00,
  round(avg(transformed_correct::int) - avg(original_correct::int), 6) + 0.0 as gap, true as inside from audit_pairs where original_correct is not null and transformed_correct is not null and error is null group by all"""
)
def bootstrap_gap(spark: SparkSession, root: str) -> DataFrame:
    """Gap per group, and whether its interval holds it."""
    out = statistics.bootstrap_gap(table(spark, root, "audit_pairs"), KEYS)
    inside = F.col("gap").between(F.col("ci_low") - 1e-12, F.col("ci_high") + 1e-12)
    return out.select(*KEYS, "n11", "n10", "n01", "n00", rounded("gap").alias("gap"), inside.alias("inside"))


# --- features against accuracy


_LASTPAIR = "select id, dialect, benchmark, coalesce(feature_count, 1) as features from generated_pairs qualify row_number() over (partition by id, dialect, benchmark order by loaded_at desc, pair_key desc) = 1"
_JOINED = f"with p as ({_LASTPAIR}), j as (select a.*, p.features from audit_pairs a join p using (id, dialect, benchmark) where a.error is null)"
_CELL = f"""count(*) as n, {r(f'avg({_O}::int)')} as original_accuracy, {r(f'avg({_T}::int)')} as transformed_accuracy, {r(f'(avg({_T}::int) - avg({_O}::int)) * 100')} as gap_pp"""


def _features(spark: SparkSession, root: str) -> DataFrame:
    ok = table(spark, root, "audit_pairs").where("error is null").select("audit_key", *KEYS, "id", "original_correct", "transformed_correct")
    return reports.with_feature_counts(ok, table(spark, root, "generated_pairs"), ["id", "dialect", "benchmark"], ["loaded_at", "pair_key"])


def _stats(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", *[rounded(c).alias(c) for c in ("original_accuracy", "transformed_accuracy", "gap_pp")])


@PLAN.query(f"{_JOINED} select audit_key, features from j")
def join_feature_accuracy(spark: SparkSession, root: str) -> DataFrame:
    return _features(spark, root).select("audit_key", "features")


@PLAN.query(f"{_JOINED} select t.threshold, {_CELL} from j join (select unnest(range(1, (select greatest(max(features), 1) from j) + 1)) as threshold) t on j.features >= t.threshold group by all")
def threshold_stats(spark: SparkSession, root: str) -> DataFrame:
    return _stats(reports.threshold_stats(_features(spark, root)), "threshold")


_RANGE = "case when features >= 4 then '4+' when features >= 1 then features::varchar end"


@PLAN.query(f"{_JOINED} select {_RANGE} as range, {_CELL} from j where features >= 1 group by all")
def range_stats(spark: SparkSession, root: str) -> DataFrame:
    return _stats(reports.range_stats(_features(spark, root)), "range")


def _full(keys: str) -> str:
    cell = _CELL.replace("count(*) as n", "count(audit_key) as n")
    zero = lambda c: f"coalesce(avg({c}::int) filter (audit_key is not null), 0)"
    return f"""{_JOINED}, g as (select * from (select distinct {keys} from j), (select unnest(['1', '2', '3', '4+']) as range)), x as (select *, {_RANGE} as range from j)
select {keys}, range, count(audit_key) as n, {r(zero(_O))} as original_accuracy, {r(zero(_T))} as transformed_accuracy, {r(f'({zero(_T)} - {zero(_O)}) * 100')} as gap_pp from g left join x using ({keys}, range) group by all"""


@PLAN.query(_full("model"))
def range_stats_by_model(spark: SparkSession, root: str) -> DataFrame:
    return _stats(reports.range_stats(_features(spark, root), ["model"]), "model", "range")


@PLAN.query(f"with z as ({_full('dialect')}) select dialect, range, n, case when n >= 10 then gap_pp end as gap_pp from z")
def range_stats_by_dialect(spark: SparkSession, root: str) -> DataFrame:
    """Gaps of fewer than ten rows are null."""
    out = _stats(reports.range_stats(_features(spark, root), ["dialect"]), "dialect", "range")
    return reports.suppress_small(out).select("dialect", "range", "n", "gap_pp")


@PLAN.query("select feature_count, count(*) as pairs from generated_pairs group by all")
def feature_histogram(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "generated_pairs").groupBy("feature_count").agg(F.count("*").alias("pairs"))


# --- shards, files and work lists


_PARSE = rf"""select file_id, file_name, case when c then regexp_extract(file_name, p2, 1) else regexp_extract(file_name, p1, 1) end as benchmark, case when c then regexp_extract(file_name, p2, 2) else regexp_extract(file_name, p1, 2) end as dialect,
  case when c then regexp_extract(file_name, p2, 3) else regexp_extract(file_name, p1, 3) end as model, case when c then '{labels.COMBINED_STAMP}' else regexp_extract(file_name, p1, 4) || regexp_extract(file_name, p1, 5) end as stamp, c as combined
from (select *, '{labels.AUDIT_FILE}' as p1, '{labels.COMBINED_FILE}' as p2, regexp_matches(file_name, '{labels.COMBINED_FILE}') as c from raw_results) where c or regexp_matches(file_name, p1)"""


def _files(spark: SparkSession, root: str) -> DataFrame:
    return shards.with_name_parts(table(spark, root, "raw_results").select("file_id", "file_name"))


@PLAN.query(_PARSE)
def parse_audit_filename(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, root)


@PLAN.query(f"with f as ({_PARSE}) select file_id, benchmark, dialect, model from f qualify row_number() over (partition by benchmark, dialect, model order by stamp desc, file_name, file_id) = 1")
def dedup_latest_wins(spark: SparkSession, root: str) -> DataFrame:
    return shards.latest_wins(_files(spark, root), KEYS).select("file_id", *KEYS)


@PLAN.query(f"with f as ({_PARSE}) select file_id, benchmark, dialect, model from f qualify row_number() over (partition by benchmark, dialect, model order by combined desc, case when combined then file_name end desc nulls last, file_name, file_id) = 1")
def dedup_first_wins(spark: SparkSession, root: str) -> DataFrame:
    return shards.earliest_wins(_files(spark, root), KEYS).select("file_id", *KEYS)


_QUALITY = "select audit_id, model, benchmark, dialect, count(*) as pairs, count(*) filter (error is not null) as errors, count(*) filter (error is null) as successful from audit_pairs group by all"


@PLAN.query(_QUALITY)
def file_quality(spark: SparkSession, root: str) -> DataFrame:
    return _quality(spark, root)


def _quality(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "audit_pairs").groupBy("audit_id", *KEYS).agg(F.count("*").alias("pairs"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("error").isNull()).alias("successful"))


@PLAN.query(f"with q as ({_QUALITY}) select audit_id, row_number() over (partition by model, benchmark, dialect order by successful desc, audit_id desc) = 1 as keep from q")
def dedup_best_success(spark: SparkSession, root: str) -> DataFrame:
    """What to keep and what to delete, as a plan."""
    named = _quality(spark, root).withColumn("file_name", F.col("audit_id")).withColumn("file_id", F.col("audit_id"))
    return shards.most_successful(named, KEYS).select("audit_id", "keep")


@PLAN.query("select distinct g.benchmark, g.dialect, a.model from generated_pairs g, (select distinct model from audits) a where not exists (select 1 from audits x where x.benchmark = g.benchmark and x.dialect = g.dialect and x.model = a.model and x.total_pairs > 100)")
def skip_existing_output(spark: SparkSession, root: str) -> DataFrame:
    """Combinations without a large audit yet."""
    audits = table(spark, root, "audits")
    models = audits.select("model").distinct().agg(F.collect_list("model").alias("models"))  # one row, which is broadcast
    planned = table(spark, root, "generated_pairs").select("benchmark", "dialect").distinct().join(F.broadcast(models), how="inner").select("benchmark", "dialect", F.explode("models").alias("model"))
    return shards.work_list(planned, audits.where("total_pairs > 100"), ["benchmark", "dialect", "model"])


@PLAN.query("select pair_key, benchmark, dialect, idx from (select *, row_number() over (partition by benchmark, dialect order by id, pair_key) - 1 as idx from generated_pairs) where idx >= 10 and idx < 25")
def slice_range(spark: SparkSession, root: str) -> DataFrame:
    return shards.slice_rows(table(spark, root, "generated_pairs"), ["id", "pair_key"], ["benchmark", "dialect"], 10, 25).select("pair_key", "benchmark", "dialect", F.col("idx").cast("bigint").alias("idx"))


@PLAN.query("select id, question from eval_items union all select id, original from generated_pairs")
def union_shards(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "eval_items").select("id", "question")
    return a.unionByName(table(spark, root, "generated_pairs").select("id", F.col("original").alias("question")))


_GEN = """select benchmark, dialect, count(*) as total_samples, count(transformed) as successful_transforms, count(*) filter (transformed is not null and feature_count >= 1 and authenticity_score >= 0.5 and not isnan(authenticity_score)) as valid_pairs,
  count(*) filter (transformed is not null and not coalesce(feature_count >= 1 and authenticity_score >= 0.5 and not isnan(authenticity_score), false)) as failed_validation, count(*) filter (transformed is null) as transform_errors from {0} group by all"""


def _generations(df: DataFrame, keys: list[str]) -> DataFrame:
    ok = F.coalesce((F.col("feature_count") >= 1) & (F.col("authenticity_score") >= 0.5) & ~F.isnan("authenticity_score"), F.lit(False))
    return generation.counts(df.withColumn("status", F.when(F.col("transformed").isNotNull(), F.when(ok, "passed").otherwise("failed"))), keys)


@PLAN.query(f"with g as ({_GEN.format('generated_pairs')}) select *, {r('coalesce(valid_pairs / nullif(successful_transforms, 0), 0)')} as pass_rate from g")
def generation_counts(spark: SparkSession, root: str) -> DataFrame:
    return _generations(table(spark, root, "generated_pairs"), ["benchmark", "dialect"]).withColumn("pass_rate", rounded("pass_rate"))


_MERGED = "(select * from generated_pairs qualify row_number() over (partition by benchmark, dialect, id order by run_id, pair_key) = 1)"


@PLAN.query(f"with g as ({_GEN.format(_MERGED)}) select *, {r('coalesce(valid_pairs / nullif(successful_transforms, 0), 0)')} as pass_rate from g")
def combine_generations(spark: SparkSession, root: str) -> DataFrame:
    """Runs as shards: first row per id, then counted, then added up."""
    first = shards.dedup_first_id(table(spark, root, "generated_pairs"), ["benchmark", "dialect", "id"], ["run_id", "pair_key"])
    return generation.combine(_generations(first, ["benchmark", "dialect", "run_id"]), ["benchmark", "dialect"]).withColumn("pass_rate", rounded("pass_rate"))


# --- sources, from the held-out items reshaped as the datasets publish them


def _raw(spark: SparkSession, root: str, benchmark: str) -> DataFrame:
    items = table(spark, root, "eval_items").where(F.col("benchmark") == benchmark)
    return benchmarks.with_index(items, ["item_id"])


def _rawsql(benchmark: str) -> str:
    return f"(select *, row_number() over (order by item_id) - 1 as idx from eval_items where benchmark = '{benchmark}')"


_PICK = ["id", "question", "answer", "correct_choice", "subject"]


@PLAN.query(f"select 'gsm8k_test_' || idx as id, question, trim(answer) as answer, null::int as correct_choice, null::varchar as subject from {_rawsql('gsm8k')} where idx < 50")
def src_gsm8k(spark: SparkSession, root: str) -> DataFrame:
    raw = _raw(spark, root, "gsm8k").withColumn("answer", F.concat(F.lit("Working. #### 1 then\n#### "), "answer"))
    return benchmarks.gsm8k(raw, max_samples=50).select(*_PICK)


@PLAN.query(f"select 'mmlu_test_' || idx as id, question, null::varchar as answer, correct_choice, subject from {_rawsql('mmlu')} where subject is not null qualify row_number() over (partition by subject order by idx) <= 3")
def src_mmlu(spark: SparkSession, root: str) -> DataFrame:
    raw = _raw(spark, root, "mmlu").withColumn("answer", F.col("correct_choice")).where("subject is not null")
    return benchmarks.mmlu(raw, max_samples=3).select(*_PICK)


@PLAN.query(f"select 'arc_challenge_test_' || idx as id, question, null::varchar as answer, correct_choice, 'science' as subject from {_rawsql('arc_challenge')}")
def src_arc(spark: SparkSession, root: str) -> DataFrame:
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    key = F.when(F.col("idx") % 2 == 0, F.element_at(letters, F.col("correct_choice") + 1)).otherwise((F.col("correct_choice") + 1).cast("string"))
    raw = _raw(spark, root, "arc_challenge").withColumn("answerKey", key).withColumn("choices", F.struct(F.col("choices").alias("text"), letters.alias("label")))
    return benchmarks.arc(raw).select(*_PICK)


@PLAN.query(f"select 'hellaswag_validation_' || idx as id, question, null::varchar as answer, case when idx % 5 > 0 then correct_choice end as correct_choice, 'general' as subject from {_rawsql('hellaswag')}")
def src_hellaswag(spark: SparkSession, root: str) -> DataFrame:
    raw = _raw(spark, root, "hellaswag").select(
        "idx", F.col("question").alias("ctx"), F.col("choices").alias("endings"), F.when(F.col("idx") % 5 > 0, F.col("correct_choice").cast("string")).otherwise("").alias("label"), F.lit(None).cast("string").alias("activity_label")
    )
    return benchmarks.hellaswag(raw).select(*_PICK)


@PLAN.query(f"select 'boolq_validation_' || idx as id, 'Passage.' || E'\\n\\nQuestion: ' || question as question, answer, correct_choice, 'reading_comprehension' as subject from {_rawsql('boolq')} where idx < 40")
def src_boolq(spark: SparkSession, root: str) -> DataFrame:
    raw = _raw(spark, root, "boolq").select("idx", F.lit("Passage.").alias("passage"), "question", (F.col("answer") == "Yes").alias("answer"))
    return benchmarks.boolq(raw, max_samples=40).select(*_PICK)


@PLAN.query(f"select 'rtp_train_' || idx as id, question, null::varchar as answer, null::int as correct_choice, 'toxicity' as subject from {_rawsql('realtoxicityprompts')} where idx % 7 = 0 or (idx % 10) / 10.0 between 0.2 and 0.7 order by idx limit 30")
def src_realtoxicityprompts(spark: SparkSession, root: str) -> DataFrame:
    tox = F.when(F.col("idx") % 7 != 0, F.col("idx") % 10 / 10.0)
    raw = _raw(spark, root, "realtoxicityprompts").select("idx", F.struct(F.col("question").alias("text"), tox.alias("toxicity")).alias("prompt"), F.struct(F.lit("x").alias("text")).alias("continuation"))
    return benchmarks.realtoxicityprompts(raw, max_samples=30, min_toxicity=0.2, max_toxicity=0.7).select(*_PICK)


@PLAN.query(f"select 'donotanswer_train_' || idx as id, question, null::varchar as answer, null::int as correct_choice, 'Malicious Uses' as subject from {_rawsql('donotanswer')} where idx % 3 = 1 order by idx limit 12")
def src_donotanswer(spark: SparkSession, root: str) -> DataFrame:
    area = F.when(F.col("idx") % 3 == 1, benchmarks.RISK_AREAS[1]).when(F.col("idx") % 3 == 2, benchmarks.RISK_AREAS[0])
    raw = _raw(spark, root, "donotanswer").select("idx", "question", area.alias("risk_area"), F.lit("t").alias("types_of_harm"), F.lit("s").alias("specific_harms"))
    return benchmarks.donotanswer(raw, risk_area=benchmarks.RISK_AREAS[1], max_samples=12).select(*_PICK)


@PLAN.query(f"select 'toxigen_train_' || idx as id, question, null::varchar as answer, null::int as correct_choice, 'unknown' as subject from {_rawsql('toxigen')} where idx % 4 > 0 and (idx % 6 = 0 or idx % 6 >= 3) order by idx limit 25")
def src_toxigen(spark: SparkSession, root: str) -> DataFrame:
    tox = F.when(F.col("idx") % 6 != 0, (F.col("idx") % 6).cast("double"))
    text = F.when(F.col("idx") % 4 > 0, F.col("question")).otherwise(F.lit(" \n"))
    raw = _raw(spark, root, "toxigen").select("idx", text.alias("text"), tox.alias("toxicity_human"), F.lit(None).cast("string").alias("target_group"))
    return benchmarks.toxigen(raw, max_samples=25, min_toxicity=3.0).select(*_PICK)


@PLAN.query(
    f"""select 'truthfulqa_validation_' || idx as id, question, null::varchar as answer, case when correct_choice >= 2 then least(correct_choice + 1, 3) else correct_choice end as correct_choice, 'truthfulness' as subject
from {_rawsql('truthfulqa')} where idx % 5 > 0"""
)
def src_truthfulqa(spark: SparkSession, root: str) -> DataFrame:
    """With a fifth choice put in third place, and no true choice now and then."""
    c = F.concat(F.slice("choices", 1, 2), F.array(F.lit("none of these")), F.slice("choices", 3, 2))
    true = F.when(F.col("correct_choice") >= 2, F.col("correct_choice") + 1).otherwise(F.col("correct_choice"))
    marks = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when((i == true) & (F.col("idx") % 5 > 0), 1).otherwise(0))
    raw = _raw(spark, root, "truthfulqa").select("idx", "question", F.struct(c.alias("choices"), marks.alias("labels")).alias("mc1_targets"), F.lit("c").alias("category"))
    return benchmarks.truthfulqa(raw).select(*_PICK)


@PLAN.query("select 'sorry_bench_train_' || idx as id, coalesce(turn, question, '') as question, null::varchar as answer, null::int as correct_choice, 'c1' as subject from (select idx, question, case when idx % 2 = 0 then question end as turn from " + _rawsql("donotanswer") + ") where idx < 40 and idx % 3 = 1")
def src_sorry_bench(spark: SparkSession, root: str) -> DataFrame:
    turns = F.when(F.col("idx") % 2 == 0, F.array("question"))
    raw = _raw(spark, root, "donotanswer").select("idx", "question", turns.alias("turns"), F.concat(F.lit("c"), (F.col("idx") % 3).cast("string")).alias("category"))
    return benchmarks.sorry_bench(raw, category="c1", max_samples=40).select(*_PICK)


@PLAN.query("select item_id from eval_items where subject = (select min(subject) from eval_items)")
def filter_by_subject(spark: SparkSession, root: str) -> DataFrame:
    items = table(spark, root, "eval_items")
    return benchmarks.filter_by_subject(items, items.agg(F.min("subject")).first()[0]).select("item_id")


@PLAN.query()
def sample_subset(spark: SparkSession, root: str) -> DataFrame:
    """A sample of 100 without replacement, the same for the same seed."""
    return benchmarks.subset(table(spark, root, "eval_items"), 100).select("item_id", "id")


def _list_sql(names: list[str], column: str) -> str:
    quoted = ", ".join("'" + n + "'" for n in names)
    return f"select (i - 1)::int as position, x[i] as {column} from (select [{quoted}] as x), (select unnest(range(1, {len(names) + 1})) as i)"


@PLAN.query(_list_sql(benchmarks.MMLU_SUBJECTS, "subject"))
def dim_mmlu_subjects(spark: SparkSession, root: str) -> DataFrame:
    return benchmarks.dimension(spark, benchmarks.MMLU_SUBJECTS, "subject")


@PLAN.query(_list_sql(benchmarks.SORRY_CATEGORIES, "category"))
def dim_sorry_categories(spark: SparkSession, root: str) -> DataFrame:
    return benchmarks.dimension(spark, benchmarks.SORRY_CATEGORIES, "category")


@PLAN.query(_list_sql(benchmarks.RISK_AREAS, "risk_area"))
def dim_donotanswer_areas(spark: SparkSession, root: str) -> DataFrame:
    return benchmarks.dimension(spark, benchmarks.RISK_AREAS, "risk_area")
