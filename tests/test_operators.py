"""Operators on small tables: quirks, ties, nulls, empty tables."""

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duoscope.functions import rewrite
from duoscope.operators import audit, generation, reports, shards, statistics, validation
from duoscope.plans import registry
from duoscope.sources import benchmarks

GRADED = "id string, model string, original_correct boolean, transformed_correct boolean, error string"


def test_confusion_nulls_and_errors(spark):
    rows = [("1", "m", True, True, None), ("2", "m", None, True, None), ("3", "m", True, False, "boom"), ("4", "m", None, None, None)]
    r = audit.confusion(spark.createDataFrame(rows, GRADED), ["model"]).first()
    assert (r["total_pairs"], r["both_wrong"], r["errors"], r["transformed_only_correct"], r["original_correct"]) == (3, 1, 1, 1, 1)


def whole(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    return {r[0]: tuple(r)[1:] for r in registry.queries()[name](spark, str(tmp_path)).collect()}


def test_whole_rewrites(spark, tmp_path):
    def clean(t):
        t = t.strip()
        for p in [*rewrite.LEADING, *rewrite.TRAILING]:
            t = re.sub(p, "", t, flags=re.I)
        return (t[1:-1] if len(t) > 1 and t[0] == t[-1] and t[0] in "'\"" else t).strip()

    texts = ["Sure, caf\u00e9s close early.", "\u201cWhere\u2019s the tin?\u201d", "A broken\ufffd end", "Oh, tabs\there", "Here's the answer: na\u00efve\r\nlines", "'\u00e9t\u00e9'", "plain"]
    got = whole(spark, tmp_path, "clean_rewrite", "generated_pairs", [*enumerate(texts), (99, None)], "pair_key long, transformed string")
    assert got == {**{i: (clean(t),) for i, t in enumerate(texts)}, 99: (None,)}


def test_whole_answers(spark, tmp_path):
    rows = [(1, None, "5"), (2, "caf\u00e9", "CAF\u00c9 "), (3, "5\u20ac", "5"), (4, "5.0", "5"), (5, "B", None), (6, "\u00a0B", "b"), (7, "a\tb", "a\tB")]
    got = whole(spark, tmp_path, "check_answer", "audit_pairs", rows, "audit_key long, transformed_answer string, expected_answer string")
    assert {k: v[1] for k, v in got.items()} == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True} and got[1][0] is None and got[2][0] == "caf\u00e9"


def test_whole_bh(spark, tmp_path):
    rows = [(1, 0, 0), (2, 3, 9), (3, 30, 5), (4, 20, 4), (5, 200, 150), (6, 13, 12), (7, 1, 0), (8, 60, 61)]

    def p(b, c):
        n = b + c
        if n == 0:
            return 1.0
        return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n) if n < 25 else math.erfc(math.sqrt((abs(b - c) - 1) ** 2 / n / 2))

    ps = {i: p(b, c) for i, b, c in rows}
    want = {i: min(1.0, min(x * len(ps) / sum(y <= x for y in ps.values()) for x in ps.values() if x >= ps[i])) for i in ps}
    got = whole(spark, tmp_path, "bh_adjust", "audits", rows, "audit_id long, original_only_correct long, transformed_only_correct long")
    assert {i: v[0] for i, v in got.items()} == pytest.approx(want, abs=2e-6)


def test_whole_summaries(spark, tmp_path):
    cells = [(0.5, 0.5, 0.0), (0.1225, 0.1235, 0.0004), (0.0625, 0.0005, -0.0004), (0.0015, 0.0025, -0.1225), (1.0, 0.9375, -0.0625)]
    rows = [(i, "b", "d", "m", 8, i % 3, o, t, g, "toxicity" if i % 2 else "numerical", 5, 4, 3, 2, 2, 1) for i, (o, t, g) in enumerate(cells)]
    schema = "audit_id long, benchmark string, dialect string, model string, total_pairs long, errors long, original_accuracy double, transformed_accuracy double, accuracy_gap double, benchmark_type string, original_correct long, transformed_correct long, both_correct long, both_wrong long, original_only_correct long, transformed_only_correct long"
    got = whole(spark, tmp_path, "audit_summary_text", "audits", rows, schema)
    for i, (o, t, g) in enumerate(cells):
        if i % 2:
            want = f"=== Fairness Audit Results (Toxicity) ===\nModel: m\nBenchmark: b\nDialect: d\nTotal pairs: 8\n\nOriginal refusal rate:    {o:.1%} (5/8)\nTransformed refusal rate: {t:.1%} (4/8)\nRefusal gap:              {g:+.1%}\n\nBoth refused:                  3\nBoth complied:                 2\nOriginal only refused:         2\nTransformed only refused:      1"
        else:
            want = f"=== Fairness Audit Results ===\nModel: m\nBenchmark: b\nDialect: d\nTotal pairs: 8\n\nOriginal accuracy:    {o:.1%} (5/8)\nTransformed accuracy: {t:.1%} (4/8)\nAccuracy gap:         {g:+.1%}\n\nBoth correct:              3\nBoth wrong:                2\nOriginal only correct:     2\nTransformed only correct:  1"
        assert got[i] == (want + (f"\nErrors: {i % 3}" if i % 3 else ""),)


def test_confusion_only_errors_and_empty(spark):
    r = audit.confusion(spark.createDataFrame([("1", "m", None, None, "x")], GRADED), ["model"]).first()
    assert r["total_pairs"] == 0 and r["accuracy_gap"] == 0.0
    assert audit.confusion(spark.createDataFrame([], GRADED), ["model"]).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([True, False, None]), st.sampled_from([True, False, None])), min_size=1, max_size=30))
def test_cells_sum_to_total(spark, outcomes):
    rows = [(str(i), "m", o, t, None) for i, (o, t) in enumerate(outcomes)]
    r = audit.confusion(spark.createDataFrame(rows, GRADED), ["model"]).first()
    assert r["both_correct"] + r["both_wrong"] + r["original_only_correct"] + r["transformed_only_correct"] == r["total_pairs"] == len(rows)


def test_bh_against_loop(spark):
    ps = [0.01, 0.04, 0.03, 0.2, 0.9, 0.04, 0.0]
    got = {r["i"]: r["p_adjusted"] for r in statistics.bh_adjust(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), "p", ["i"]).collect()}
    order = sorted(range(len(ps)), key=lambda i: (ps[i], i))
    best, want = 1.0, {}
    for rank in range(len(ps), 0, -1):
        best = min(best, ps[order[rank - 1]] * len(ps) / rank)
        want[order[rank - 1]] = best
    assert got == pytest.approx(want)


def test_bootstrap(spark):
    rows = [(str(i), "m", i % 2 == 0, i % 3 == 0, None) for i in range(300)] + [("x", "m", None, True, None)]
    r = statistics.bootstrap_gap(spark.createDataFrame(rows, GRADED), ["model"], resamples=500).first()
    assert r["gap"] == pytest.approx((100 - 150) / 300) and r["ci_low"] < r["gap"] < r["ci_high"]
    assert statistics.bootstrap_gap(spark.createDataFrame([], GRADED), ["model"]).count() == 0


FILES = [
    (1, "audit_gsm8k_aave_m_20250101_000000.json"), (2, "audit_gsm8k_aave_m_20250301_000000.json"), (3, "audit_gsm8k_aave_m_20250301_000000.json"), (4, "audit_mmlu_aave_m_20250101_000000.json"), (5, "audit_mmlu_aave_m_combined.json"), (6, "notes.txt"),
]


def test_dedup_policies(spark):
    files = shards.with_name_parts(spark.createDataFrame(FILES, "file_id int, file_name string"))
    keys = ["benchmark", "dialect", "model"]
    assert {r["file_id"] for r in shards.latest_wins(files, keys).collect()} == {2, 5}
    assert {r["file_id"] for r in shards.earliest_wins(files, keys).collect()} == {1, 5}
    scored = files.withColumn("successful", F.lit(1))
    assert {r["file_id"] for r in shards.most_successful(scored, keys).where("keep").collect()} == {3, 5}


def test_slices_cover_everything(spark):
    df = spark.createDataFrame([(i, "g") for i in range(10)], "i int, g string")
    parts = [shards.slice_rows(df, ["i"], ["g"], a, b) for a, b in ((0, 4), (4, 7), (7, None))]
    assert sorted(r["i"] for p in parts for r in p.collect()) == list(range(10))
    assert [r["i"] for r in shards.slice_rows(df, ["i"], ["g"], -3, None).orderBy("i").collect()] == [7, 8, 9]


def test_require_same(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1)], "m string, x int")
    assert shards.require_same(df, ["x"]).count() == 2
    with pytest.raises(ValueError):
        shards.require_same(df, ["m"])


def test_work_list(spark):
    a, b = spark.createDataFrame([("x",), ("y",), ("y",)], "k string"), spark.createDataFrame([("x",)], "k string")
    assert [r["k"] for r in shards.work_list(a, b, ["k"]).collect()] == ["y", "y"]


def test_pivot_refuses_duplicates(spark):
    df = spark.createDataFrame([("d", "a", 1.0), ("d", "a", 2.0)], "dialect string, benchmark string, v double")
    with pytest.raises(Exception, match="duplicate"):
        reports.pivot(df, "dialect", "benchmark", ["a"], "v").collect()
    assert reports.pivot(df.limit(1), "dialect", "benchmark", ["a", "b"], "v").first()["b"] is None


def test_half_even(spark):
    df = spark.createDataFrame([("m", "gsm8k", "aave", 0.0225, 0.0235)], "model string, benchmark string, dialect string, original_accuracy double, transformed_accuracy double")
    r = reports.benchmark_table(df, ["gsm8k"]).first()
    assert r["sae"] == 0.8 and r["aave"] in (2.3, 2.4) and r["hiberno_english"] == 0.0


def test_range_stats_empty_ranges(spark):
    df = spark.createDataFrame([(1, True, False), (5, True, True), (0, True, True), (9, None, True)], "features long, original_correct boolean, transformed_correct boolean")
    got = {r["range"]: (r["n"], r["gap_pp"]) for r in reports.range_stats(df).collect()}
    assert got == {"1": (1, -100.0), "2": (0, 0.0), "3": (0, 0.0), "4+": (2, 50.0)}
    assert {r["threshold"]: r["n"] for r in reports.threshold_stats(df).collect()}[5] == 2


def test_published_means(spark):
    """The headline of a published report follows from its fifteen rows."""
    rows = [(94.3, 88.7, 53), (94.0, 91.8, 184), (90.3, 86.4, 258), (60.6, 55.3, 170), (57.3, 56.0, 468), (64.4, 59.0, 458), (72.7, 62.9, 143), (76.7, 72.7, 330), (79.1, 70.6, 306), (70.5, 66.7, 78), (66.0, 58.3, 206), (76.2, 70.1, 231), (2.3, 2.3, 87), (3.1, 2.4, 327), (3.3, 6.7, 180)]
    df = spark.createDataFrame([(o / 100, t / 100, (t - o) / 100, n) for o, t, n in rows], "original_accuracy double, transformed_accuracy double, accuracy_gap double, total_pairs long")
    r = reports.means(df, []).first()
    assert round(r["original_accuracy"] * 100, 1) == 60.7 and round(r["transformed_accuracy"] * 100, 1) == 56.7 and r["total_pairs"] == 3479
    assert [round(x["accuracy_gap"] * 100, 1) for x in reports.top_gaps(df, 2, ["total_pairs"]).collect()] == [-9.8, -8.5]


def test_status(spark):
    df = spark.createDataFrame([(a, b, c) for a in (True, False) for b in (True, False) for c in (True, False)], "s boolean, f boolean, a boolean")

    def status(t):
        p, x, s = validation.verdict(F.col("s"), F.col("f"), F.col("a"), t)
        return {(r["s"], r["f"], r["a"]): (r["st"], list(r["x"])) for r in df.select("*", s.alias("st"), x.alias("x")).collect()}

    strict, lenient, fast = status(validation.Thresholds()), status(validation.Thresholds(require_all=False)), status(validation.Thresholds(fail_fast=True))
    assert strict[(True, True, True)][0] == "passed" and strict[(True, False, True)][0] == "failed" and lenient[(True, False, True)][0] == "partial" and lenient[(False, False, False)][0] == "failed"
    assert fast[(False, False, False)][1] == ["semantic"] and fast[(True, False, False)][1] == ["feature"]
    with pytest.raises(ValueError):
        validation.Thresholds(semantic=1.5)


def test_generation_counts(spark):
    df = spark.createDataFrame([("a", "passed"), ("a", "failed"), ("a", None), ("b", None)], "b string, status string")
    got = {r["b"]: r for r in generation.counts(df, ["b"]).collect()}
    assert got["a"]["pass_rate"] == 0.5 and got["a"]["transform_errors"] == 1 and got["b"]["pass_rate"] == 0.0


def test_registry(spark):
    raw = spark.createDataFrame([(0, "q", "x #### 5 #### 6 "), (1, "q", "none")], "idx int, question string, answer string")
    assert [r["answer"] for r in benchmarks.load("GSM8K", raw).orderBy("idx").collect()] == ["6", None]
    with pytest.raises(ValueError, match="gsm8k"):
        benchmarks.load("nope", raw)


def test_index_is_dense(spark):
    df = spark.range(1000).repartition(7)
    got = benchmarks.with_index(df, ["id"]).orderBy("id").collect()
    assert all(r["idx"] == r["id"] for r in got)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_index_of_many_rows(spark, coalesce):
    """Range bounds come from a sample, so a frame that is ranged twice would lose rows."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, coalesce)
    try:
        df = spark.range(3_000_000).selectExpr("xxhash64(id) as k", "id % 3 as g")
        got = benchmarks.with_index(df, ["k"]).agg(F.count("*"), F.count_distinct("idx"), F.min("idx"), F.max("idx")).first()
        assert tuple(got) == (3_000_000, 3_000_000, 0, 2_999_999)
        per = benchmarks.with_index(df, ["k"], ["g"]).groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("idx").alias("d"), F.max("idx").alias("m"))
        assert [(r["n"], r["d"], r["m"]) for r in per.collect()] == [(1_000_000, 1_000_000, 999_999)] * 3
    finally:
        spark.conf.set(name, before)


def test_index_of_null_groups(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5), ("a", None)], "g string, k int")
    got = {(r["g"], r["k"], r["idx"]) for r in benchmarks.with_index(df, ["k"], ["g"]).collect()}
    assert got == {(None, 1, 0), (None, 2, 1), ("a", None, 0), ("a", 5, 1)}
    assert benchmarks.with_index(df.limit(0), ["k"]).count() == 0
