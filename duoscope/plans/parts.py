"""Queries on single steps: predicates, limits, orders, lookups, catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duoscope.functions import dialect as fd
from duoscope.functions import grading, labels, stats
from duoscope.operators import generation, reports, shards, statistics, validation
from duoscope.plans.audits import _CELL, _JOINED, _LATEST, _P, KEYS, ONE, _bh_sql, _features, _latest, _raw, _rawsql
from duoscope.plans.base import Plan, r, rounded
from duoscope.plans.pairs import _AUTH, _CHECKED, _F, _HIGH, _case, _checked, _count_sql, _has_sql, _quote, _rewrites
from duoscope.runtime import table
from duoscope.sources import benchmarks, results
from duoscope.specs.dialects import DIALECTS

PLAN = Plan()


# --- datasets


@PLAN.query("select benchmark, count(*) as records from eval_items group by benchmark")
def dataset_len(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "eval_items").groupBy("benchmark").agg(F.count("*").alias("records"))


@PLAN.query(f"select id, idx from {_rawsql('gsm8k')} where idx = 7")
def dataset_getitem(spark: SparkSession, root: str) -> DataFrame:
    return _raw(spark, root, "gsm8k").where("idx = 7").select("id", "idx")


@PLAN.query("select id, row_number() over (order by item_id) - 1 as idx from eval_items")
def row_index(spark: SparkSession, root: str) -> DataFrame:
    return benchmarks.with_index(table(spark, root, "eval_items"), ["item_id"]).select("id", "idx")


@PLAN.query("select item_id, trim(answer) as answer from eval_items where benchmark = 'gsm8k'")
def gsm8k_answer(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "eval_items").where("benchmark = 'gsm8k'")
    return df.select("item_id", benchmarks.gsm8k_answer(F.concat(F.lit("a #### 3 b\n####  "), "answer", F.lit(" \n"))).alias("answer"))


_WANTED = ["anatomy", "astronomy", "college_physics", "virology"]


@PLAN.query(f"select 'mmlu_test_' || idx as id, subject from {_rawsql('mmlu')} where subject in ({', '.join(map(_quote, _WANTED))})")
def filter_subject_set(spark: SparkSession, root: str) -> DataFrame:
    """The reader's own filter by subjects."""
    raw = _raw(spark, root, "mmlu").withColumn("answer", F.col("correct_choice"))
    return benchmarks.mmlu(raw, subjects=_WANTED).select("id", "subject")


@PLAN.query("select item_id from eval_items where coalesce(subject, 'unknown') = 'unknown'")
def filter_category(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "eval_items").where(F.coalesce("subject", F.lit("unknown")) == "unknown").select("item_id")


@PLAN.query(f"select 'rtp_train_' || idx as id from {_rawsql('realtoxicityprompts')} where length(trim(question)) > 0 and (idx % 7 = 0 or (idx % 10) / 10.0 between 0.25 and 0.75)")
def filter_toxicity_range(spark: SparkSession, root: str) -> DataFrame:
    """The reader's own range, which unknown toxicity passes."""
    tox = F.when(F.col("idx") % 7 != 0, F.col("idx") % 10 / 10.0)
    raw = _raw(spark, root, "realtoxicityprompts").select("idx", F.struct(F.col("question").alias("text"), tox.alias("toxicity")).alias("prompt"), F.struct(F.lit("x").alias("text")).alias("continuation"))
    return benchmarks.realtoxicityprompts(raw, min_toxicity=0.25, max_toxicity=0.75).select("id")


@PLAN.query(r"select pair_key from generated_pairs where length(regexp_replace(coalesce(transformed, ''), '[\s\p{Z}]', '', 'g')) > 0")
def filter_blank_text(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "generated_pairs").where(~labels.blank(F.col("transformed"))).select("pair_key")


@PLAN.query("select file_id from (select file_id, case when file_id % 5 = 0 then 'sample_' else '' end || file_name as file_name from raw_results) where not contains(file_name, 'sample')")
def filter_exclude_samples(spark: SparkSession, root: str) -> DataFrame:
    """What the reader of all audits leaves out; every fifth file is named as a sample here."""
    named = table(spark, root, "raw_results").withColumn("file_name", F.concat(F.when(F.col("file_id") % 5 == 0, "sample_").otherwise(""), "file_name"))
    return results.without_samples(named).select("file_id")


@PLAN.query(f"select idx, id from {_rawsql('mmlu')} where idx < 30 and coalesce(subject, '') <> ''")
def limit_source_pos(spark: SparkSession, root: str) -> DataFrame:
    """The limit counts source rows, the filter comes after it."""
    return _raw(spark, root, "mmlu").where("idx < 30").where("coalesce(subject, '') <> ''").select("idx", "id")


@PLAN.query(f"select idx, id from {_rawsql('mmlu')} where idx % 3 = 0 order by idx limit 20")
def limit_emitted(spark: SparkSession, root: str) -> DataFrame:
    """The filter comes first, the limit counts what comes out."""
    return _raw(spark, root, "mmlu").where("idx % 3 = 0").orderBy("idx").limit(20).select("idx", "id")


@PLAN.query("select audit_key from audit_pairs where error is null and original_correct is distinct from transformed_correct order by audit_key limit 10")
def limit_display(spark: SparkSession, root: str) -> DataFrame:
    """The first ten mismatches, as a run shows them."""
    df = table(spark, root, "audit_pairs").where(F.col("error").isNull() & ~F.col("original_correct").eqNullSafe(F.col("transformed_correct")))
    return df.orderBy("audit_key").limit(10).select("audit_key")


@PLAN.query("select subject, id from (select *, row_number() over (partition by subject order by item_id) as n from eval_items where subject is not null) where n <= 2")
def limit_per_subject(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "eval_items").where("subject is not null")
    w = Window.partitionBy("subject").orderBy("item_id")
    return df.withColumn("n", F.row_number().over(w)).where("n <= 2").select("subject", "id")


# --- dialects


def _rows(values: list[tuple], names: str) -> str:
    quoted = ", ".join("(" + ", ".join(_quote(str(v)) if isinstance(v, str) else str(v) for v in t) + ")" for t in values)
    return f"select * from (values {quoted}) as t({names})"


_SPEC = [(d.code, f.id, f.name, f.priority, len(f.patterns)) for d in DIALECTS.values() for f in d.features]


@PLAN.query(_rows(_SPEC, "dialect, feature_id, name, priority, patterns"))
def spec_lookup(spark: SparkSession, root: str) -> DataFrame:
    """Features by dialect, with names and priorities."""
    return spark.createDataFrame(_SPEC, "dialect string, feature_id string, name string, priority string, patterns int")


@PLAN.query(f"{_F}, n as (select pair_key, {_HIGH} as high from f) select * from n where high > 0")
def semi_high_priority(spark: SparkSession, root: str) -> DataFrame:
    out = validation.features(_rewrites(spark, root).where("transformed is not null"), "transformed", "dialect")
    return out.where("high_priority_found > 0").select("pair_key", F.col("high_priority_found").alias("high"))


@PLAN.query(
    "with c as (select pair_key, "
    + _case({k: " + ".join(_count_sql(p) for p in d.stereotypes) for k, d in DIALECTS.items()})
    + " as stereotypes, "
    + _case({k: " + ".join(_count_sql(p) for p in d.suspicious) for k, d in DIALECTS.items()})
    + " as suspicious, "
    + _case({k: " + ".join(f"cast({_has_sql(p)} as int)" for p in d.markers) for k, d in DIALECTS.items()})
    + " as markers from generated_pairs where transformed is not null) select * from c"
)
def count_markers(spark: SparkSession, root: str) -> DataFrame:
    """Matches that lower the authenticity of a rewrite, and markers that raise it."""
    t, c = F.col("transformed"), F.col("dialect")
    of = lambda f: validation.per_dialect(c, {k: f(t, d) for k, d in DIALECTS.items()})
    df = _rewrites(spark, root).where("transformed is not null")
    return df.select("pair_key", F.size(of(fd.stereotypes)).alias("stereotypes"), F.size(of(fd.suspicious)).alias("suspicious"), of(fd.marker_count).alias("markers"))


@PLAN.query(f"select pair_key from generated_pairs where transformed is not null and round({_AUTH}, 6) >= 0.9")
def validate_authenticity(spark: SparkSession, root: str) -> DataFrame:
    out = validation.authenticity(_rewrites(spark, root).where("transformed is not null"), "transformed", "dialect", 0.9)
    return out.where(F.round("score", 6) >= 0.9).select("pair_key")


_MATCHED = _case({k: "list_filter([" + ", ".join(f"case when {_has_sql(p)} then '{f.id}/{i}' end" for f in d.features for i, p in enumerate(f.patterns)) + "], lambda x: x is not null)" for k, d in DIALECTS.items()})


@PLAN.query(f"with m as (select dialect, unnest({_MATCHED}) as pattern from generated_pairs where transformed is not null) select dialect, pattern, count(*) as texts from m group by all")
def join_text_patterns(spark: SparkSession, root: str) -> DataFrame:
    """Texts per pattern; patterns are literals, so there is no join at run time."""
    from duoscope.functions import regex

    def hits(d):
        return F.array_compact(F.array(*[F.when(regex.has(F.col("transformed"), p), f"{f.id}/{i}") for f in d.features for i, p in enumerate(f.patterns)]))

    df = _rewrites(spark, root).where("transformed is not null")
    each = df.select("dialect", F.explode(validation.per_dialect(F.col("dialect"), {k: hits(d) for k, d in DIALECTS.items()})).alias("pattern"))
    return each.groupBy("dialect", "pattern").agg(F.count("*").alias("texts"))


@PLAN.query(f"{_CHECKED}, e as (select unnest(failed) as validator from w), c as (select validator, count(*) as failures from e group by all) select validator, failures, row_number() over (order by failures desc, validator) as position from c")
def sort_failure_counts(spark: SparkSession, root: str) -> DataFrame:
    """Most frequent first; there is a row per validator."""
    w = Window.orderBy(F.desc("failures"), "validator")
    return generation.failure_breakdown(_checked(spark, root)).withColumn("position", F.row_number().over(w))


@PLAN.query()
def embed_text(spark: SparkSession, root: str) -> DataFrame:
    """Vectors of the questions, from one encoder per worker."""
    return validation.embed(table(spark, root, "eval_items").select("item_id", "question"), ["question"])


# --- audits


@PLAN.query(f"select audit_id, {r('accuracy_gap * 100')} as gap_pp from audits")
def gap_pp(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "audits").select("audit_id", rounded(F.col("accuracy_gap") * 100).alias("gap_pp"))


@PLAN.query(f"select audit_id, case when p_adjusted < 0.01 then '**' when p_adjusted < 0.05 then '*' else '' end as marker from ({_bh_sql(f'(select audit_id, round({_P}, 9) as p from audits)', 'audit_id')})")
def significance_marker(spark: SparkSession, root: str) -> DataFrame:
    """Stars by the adjusted p of every audit's test."""
    tests = statistics.mcnemar_audits(table(spark, root, "audits")).withColumn("p", F.round("p_value", 9))
    return statistics.bh_adjust(tests, "p", ["audit_id"]).select("audit_id", stats.significance_marker(rounded("p_adjusted")).alias("marker"))


_DARK, _BRIGHT = (0.03, 0.19, 0.42), (0.97, 0.98, 1.0)


@PLAN.query(
    f"""with x as (select min(transformed_accuracy) as lo, max(transformed_accuracy) as hi from audits), s as (select audit_id, case when hi = lo then 0.5 else (transformed_accuracy - lo) / (hi - lo) end as v from audits, x)
select audit_id, case when {' + '.join(f'{w} * ({a} + ({b} - {a}) * v)' for w, a, b in zip((0.299, 0.587, 0.114), _DARK, _BRIGHT))} > 0.45 then '#1a1a1a' else '#FFFFFF' end as text from s"""
)
def text_contrast(spark: SparkSession, root: str) -> DataFrame:
    """Text on cells coloured by accuracy."""
    df = table(spark, root, "audits")
    ends = df.agg(F.min("transformed_accuracy").alias("lo"), F.max("transformed_accuracy").alias("hi")).first()  # two numbers
    shade = labels.norm_shade(F.col("transformed_accuracy"), F.lit(ends["lo"]), F.lit(ends["hi"]))
    return df.select("audit_id", labels.text_contrast(*labels.ramp(shade, _DARK, _BRIGHT)).alias("text"))


@PLAN.query("select audit_id from audits where model in ('heron-instruct', 'quill-7b')")
def semi_model_dirs(spark: SparkSession, root: str) -> DataFrame:
    wanted = spark.createDataFrame([(ONE,), ("quill-7b",)], "model string")
    return table(spark, root, "audits").join(wanted, "model", "left_semi").select("audit_id")


@PLAN.query(f"with {_LATEST} select model, benchmark, {r('avg(original_accuracy) * 100')} as sae, {r('avg(transformed_accuracy) * 100')} as mean from latest group by all")
def model_bench_means(spark: SparkSession, root: str) -> DataFrame:
    return _latest(spark, root).groupBy("model", "benchmark").agg(rounded(F.avg("original_accuracy") * 100).alias("sae"), rounded(F.avg("transformed_accuracy") * 100).alias("mean"))


@PLAN.query(f"with {_LATEST} select audit_id from latest where model = '{ONE}' union all select audit_id from latest where model = 'quill-7b'")
def union_models(spark: SparkSession, root: str) -> DataFrame:
    latest = _latest(spark, root).select("audit_id", "model")
    return latest.where(F.col("model") == ONE).unionByName(latest.where("model = 'quill-7b'")).select("audit_id")


@PLAN.query(f"with {_LATEST}, t as ({_bh_sql(f'(select *, {_P} as p from latest)', 'model, benchmark, dialect')}) select model, benchmark, dialect, audit_id, {r('accuracy_gap')} as accuracy_gap, p_adjusted from t")
def join_significance_audits(spark: SparkSession, root: str) -> DataFrame:
    """Audits with the adjusted p of their test."""
    latest = _latest(spark, root)
    tests = statistics.bh_adjust(statistics.mcnemar_audits(latest), "p_value", KEYS).select(*KEYS, "p_adjusted")
    return latest.select(*KEYS, "audit_id", rounded("accuracy_gap").alias("accuracy_gap")).join(tests.withColumn("p_adjusted", rounded("p_adjusted")), KEYS, "left")


@PLAN.query(f"with {_LATEST} select audit_id, {r(_P)} as p_value from latest")
def sort_by_pvalue(spark: SparkSession, root: str) -> DataFrame:
    return statistics.mcnemar_audits(_latest(spark, root)).orderBy("p_value", "audit_id").select("audit_id", rounded("p_value").alias("p_value"))


@PLAN.query("select pair_key, row_number() over (partition by benchmark, dialect order by id, pair_key) as position from generated_pairs")
def sort_pairs_by_id(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "generated_pairs").select("benchmark", "dialect", "id", "pair_key")
    return benchmarks.with_index(rows, ["id", "pair_key"], ["benchmark", "dialect"]).select("pair_key", (F.col("idx") + 1).alias("position"))


@PLAN.query(f"with z as ({_JOINED} select model, features, {_CELL} from j group by all) select model, features, n, case when n >= 10 then gap_pp end as gap_pp from z")
def filter_min_group(spark: SparkSession, root: str) -> DataFrame:
    """Gaps of groups with fewer than ten rows are null."""
    cells = _features(spark, root).groupBy("model", "features").agg(*reports._cell())
    return reports.suppress_small(reports._accuracies(cells)).select("model", "features", "n", rounded("gap_pp").alias("gap_pp"))


@PLAN.query("select distinct a.benchmark, a.dialect, a.model from audits a where not exists (select 1 from audits x where x.benchmark = a.benchmark and x.dialect = a.dialect and x.model = a.model and x.errors > 2)")
def anti_work_list(spark: SparkSession, root: str) -> DataFrame:
    audits = table(spark, root, "audits")
    return shards.work_list(audits.select("benchmark", "dialect", "model").distinct(), audits.where("errors > 2"), ["benchmark", "dialect", "model"])


@PLAN.query("select audit_id, case benchmark_type when 'toxicity' then 1 else 0 end as toxic from audits")
def filter_type(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "audits")
    return df.select("audit_id", (grading.benchmark_type_of(F.col("benchmark")) == "toxicity").cast("int").alias("toxic"))


# --- documents


@PLAN.query("select audit_id, to_json(struct_pack(audit_id := audit_id, model := model, errors := errors)) as document from audits")
def result_to_dict(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "audits").select("audit_id", F.to_json(F.struct("audit_id", "model", "errors"), {"ignoreNullFields": "false"}).alias("document"))


_CLEAN = "doc_kind = 'audit' and json_valid(payload) and json_type(payload, '$.both_correct') = 'UBIGINT'"


@PLAN.query(f"select file_id, payload->>'$.benchmark' as benchmark, payload->>'$.model' as model, (payload->>'$.both_correct')::bigint as both_correct from raw_results where {_CLEAN}")
def src_audit_json(spark: SparkSession, root: str) -> DataFrame:
    """Audit documents read with a schema; what can't be read is skipped."""
    raw = table(spark, root, "raw_results").where("doc_kind = 'audit'")
    df = raw.select("file_id", F.from_json("payload", "benchmark string, model string, both_correct bigint").alias("d"))
    return df.where("d.both_correct is not null").select("file_id", "d.benchmark", "d.model", "d.both_correct")


@PLAN.query("select id, benchmark, dialect, pair_key, original, transformed, feature_count, len(metadata.choices) as choices from generated_pairs where benchmark is not null and dialect is not null")
def src_pairs_json(spark: SparkSession, root: str) -> DataFrame:
    """Pairs put into documents, a document per 500 of them, and read back from those with the reader's schema."""
    rows = table(spark, root, "generated_pairs").where("benchmark is not null and dialect is not null")
    fields = ["original", "transformed", "subject", "semantic_score", "feature_count", "authenticity_score", "metadata"]
    one = F.struct(F.concat_ws("|", "pair_key", "id").alias("id"), "dialect", "benchmark", *[F.col(c) for c in fields])
    docs = rows.groupBy("benchmark", "dialect", F.expr("pair_key div 500").alias("part")).agg(F.collect_list(one).alias("pairs"))
    read = results.inline_pairs(docs.select(F.from_json(F.to_json(F.struct("benchmark", "dialect", "pairs")), results.PAIRS_DOC).alias("d")).select("d.*"))
    key = F.split("id", "\\|", 2)
    return read.select(key[1].alias("id"), "benchmark", "dialect", key[0].cast("bigint").alias("pair_key"), "original", "transformed", "feature_count", F.when(F.col("metadata.choices").isNotNull(), F.size("metadata.choices")).cast("bigint").alias("choices"))


@PLAN.query()
def report_tables(spark: SparkSession, root: str) -> DataFrame:
    """The gaps a report's chart shows."""
    from duoscope.sinks import report

    return report.tables(_latest(spark, root))["gaps"]


