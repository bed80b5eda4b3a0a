"""Queries of the problems that this subpackage solves, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm import abuse, leakage, packing, pair_defects, quantile_cut, stuffing, truncation
from duoscope.runtime import table

SOURCE = ["benchmark", "dialect"]
SCORES = ["semantic_score", "authenticity_score"]


def _scores(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    rows = quantile_cut.long_scores(table(spark, root, "generated_pairs"), "pair_key", SOURCE, SCORES)
    return rows, quantile_cut.cutoffs(rows, table(spark, root, "keep_targets"), SOURCE)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    rows, cuts = _scores(spark, root)
    return quantile_cut.kept(rows, cuts, "pair_key", SOURCE).select("score", "pair_key")


def p3_cutoffs(spark: SparkSession, root: str) -> DataFrame:
    """The cutoff of each source and score, with usable and kept rows."""
    rows, cuts = _scores(spark, root)
    n = quantile_cut.kept(rows, cuts, "pair_key", SOURCE).groupBy(*SOURCE, "score", "keep_pct").agg(F.count("*").alias("kept"))
    return cuts.join(n, [*SOURCE, "score", "keep_pct"]).select(*SOURCE, "score", "keep_pct", "usable", "cutoff", "kept")


def p8_pages(spark: SparkSession, root: str) -> DataFrame:
    """Every page with its curve and verdict."""
    return stuffing.classify(table(spark, root, "documents"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_pages(spark, root).where("stuffed").select("doc_id")


def p8_rates(spark: SparkSession, root: str) -> DataFrame:
    """Stuffed pages per host."""
    pages = p8_pages(spark, root).select("doc_id", "stuffed").join(table(spark, root, "documents").select("doc_id", "source"), "doc_id")
    return pages.groupBy("source").agg(F.count("*").alias("pages"), F.count_if("stuffed").alias("stuffed"))


_P3 = """
with rows_ as (
    select pair_key, benchmark, dialect, 'semantic_score' as score, semantic_score as value from generated_pairs
    union all
    select pair_key, benchmark, dialect, 'authenticity_score', authenticity_score from generated_pairs
), usable as (
    select * from rows_ where not isnan(value) and value >= 0 and value <= 1
), ranked as (
    select u.*, t.keep_pct,
           count(*) over (partition by u.benchmark, u.dialect, u.score) as n,
           count(*) over (partition by u.benchmark, u.dialect, u.score order by value desc) as upto
    from usable u join keep_targets t using (benchmark, dialect, score)
), cuts as (
    select benchmark, dialect, score, keep_pct, n, max(value) as cutoff
    from ranked where upto * 100 >= keep_pct * n group by all
)
"""

P3_FOUND_SQL = _P3 + "select r.score, r.pair_key from ranked r join cuts c using (benchmark, dialect, score) where r.value >= c.cutoff"
P3_CUTOFFS_SQL = (
    _P3
    + """select c.benchmark, c.dialect, c.score, c.keep_pct, c.n as usable, c.cutoff, count(*) as kept
from ranked r join cuts c using (benchmark, dialect, score) where r.value >= c.cutoff group by all"""
)


def p1_scores(spark: SparkSession, root: str) -> DataFrame:
    """Score, category and leading term of every value."""
    return abuse.score_values(table(spark, root, "generated_pairs"), table(spark, root, "flag_terms"), table(spark, root, "review_labels"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return p1_scores(spark, root).where("flagged").select("pair_key", "field")


def p1_rates(spark: SparkSession, root: str) -> DataFrame:
    """Flagged values per benchmark, dialect and field."""
    return abuse.rates(p1_scores(spark, root), [*SOURCE, "field"])


def p4_values(spark: SparkSession, root: str) -> DataFrame:
    """Every rewrite and reply with its verdict and terminality."""
    pairs, audits = table(spark, root, "generated_pairs"), table(spark, root, "audit_pairs")
    rewrites = truncation.values(pairs, "pair_key", ["transformed"], "concat_ws('/', benchmark, dialect)", "original")
    replies = truncation.values(audits, "audit_key", ["original_response", "transformed_response"], "model")
    options = pairs.selectExpr("concat(array_join(metadata.choices, '\\n'), '\\n') as text").where("text is not null")
    return truncation.truncated(rewrites.unionByName(replies), options)


_TABLE = "if(field = 'transformed', 'generated_pairs', 'audit_pairs') as table_name"


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_values(spark, root).where("cut").selectExpr(_TABLE, "row_key", "field")


def p4_rates(spark: SparkSession, root: str) -> DataFrame:
    """Cut values per table and source (benchmark and dialect, or model)."""
    return truncation.rates(p4_values(spark, root).selectExpr("*", _TABLE), ["table_name", "source"])


def p5_values(spark: SparkSession, root: str) -> DataFrame:
    """Every value with its defect, if any."""
    return pair_defects.classify(table(spark, root, "audit_pairs"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return p5_values(spark, root).where("defect is not null").select("audit_key", "field", "defect")


def p5_rates(spark: SparkSession, root: str) -> DataFrame:
    """Defects of each kind per model and field."""
    return pair_defects.rates(p5_values(spark, root), ["model", "field"])


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    """A container of each capacity for every document or piece."""
    return packing.pack(packing.token_sizes(table(spark, root, "documents")), table(spark, root, "pack_targets"))


def p6_waste(spark: SparkSession, root: str) -> DataFrame:
    """Containers and share of unused space per job."""
    return packing.waste(p6_containers(spark, root))


def p7_leaks(spark: SparkSession, root: str) -> DataFrame:
    """Exact and near leaks, with their length and distance."""
    return leakage.find_leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_leaks(spark, root).where(f"distance = 0 and passage = {leakage.PASSAGE}").select("doc_id", "item_id")


def p7_items(spark: SparkSession, root: str) -> DataFrame:
    """How many documents and sources each leaked item stands in."""
    sources = table(spark, root, "documents").select("doc_id", "source")
    return p7_found(spark, root).join(sources, "doc_id").groupBy("item_id").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"))


_P7 = """
with dw as (
    select doc_id, source, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents
), dg as (
    select distinct doc_id, source, array_to_string(w[i:i+9], ' ') as g
    from (select doc_id, source, w, unnest(range(1, len(w) - 8)) as i from dw where len(w) >= 10)
), iw as (
    select item_id, regexp_extract_all(lower(question), '[a-z0-9]+') as w from eval_items
), ig as (
    select distinct item_id, array_to_string(w[i:i+9], ' ') as g
    from (select item_id, w, unnest(range(1, len(w) - 8)) as i from iw where len(w) >= 10)
), leaks as (select distinct doc_id, source, item_id from dg join ig using (g))
"""
P7_FOUND_SQL = _P7 + "select doc_id, item_id from leaks"
P7_ITEMS_SQL = _P7 + "select item_id, count(*) as documents, count(distinct source) as sources from leaks group by item_id"


def queries():
    return {
        "p1_found": p1_found,
        "p1_scores": p1_scores,
        "p1_rates": p1_rates,
        "p4_found": p4_found,
        "p4_values": p4_values,
        "p4_rates": p4_rates,
        "p5_found": p5_found,
        "p5_values": p5_values,
        "p5_rates": p5_rates,
        "p6_containers": p6_containers,
        "p6_waste": p6_waste,
        "p7_found": p7_found,
        "p7_leaks": p7_leaks,
        "p7_items": p7_items,
        "p8_found": p8_found,
        "p8_pages": p8_pages,
        "p8_rates": p8_rates,
        "p3_found": p3_found, "p3_cutoffs": p3_cutoffs}


def oracle_sql():
    return {
        "p7_found": P7_FOUND_SQL,
        "p7_items": P7_ITEMS_SQL,
        "p3_found": P3_FOUND_SQL, "p3_cutoffs": P3_CUTOFFS_SQL}
