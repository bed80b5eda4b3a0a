"""Schema drift against cases written by hand."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from duoscope.operators import schema_drift as sd

CATALOG = [
    ("audit", "model", "string", False), ("audit", "errors", "long", False), ("audit", "benchmark_type", "string", False), ("audit", "accuracy_gap", "double", False), ("audit", "combined_from", "array<string>", True),
    ("generation", "benchmark", "string", False), ("generation", "failed_pairs", "array<struct>", False), ("generation", "failed_pairs.id", "string", False), ("generation", "failed_pairs.semantic_score", "double", False), ("generation", "failure_breakdown", "map<string,long>", False),
]
AUDIT = {"model": "m", "errors": 1, "benchmark_type": "numerical", "accuracy_gap": 0.5}
GENERATION = {"benchmark": "b", "failed_pairs": [{"id": "b_1", "semantic_score": 0.5}], "failure_breakdown": {"semantic": 1}}


def without(d, *names, **more):
    return {k: v for k, v in d.items() if k not in names} | more


CASES = {
    "plain": ("audit", AUDIT, set()),
    "whole double": ("audit", AUDIT | {"accuracy_gap": 0}, set()),
    "fraction long": ("audit", AUDIT | {"errors": 1.0}, {("errors", "type_changed")}),
    "null": ("audit", AUDIT | {"errors": None}, set()),
    "boolean": ("audit", AUDIT | {"errors": True}, {("errors", "type_changed")}),
    "removed": ("audit", without(AUDIT, "errors"), {("errors", "removed")}),
    "case": ("audit", without(AUDIT, "errors", Errors=3), {("errors", "renamed")}),
    "renamed": ("audit", without(AUDIT, "benchmark_type", benchmarkType="toxicity"), {("benchmark_type", "renamed")}),
    "renamed and changed": ("audit", without(AUDIT, "errors", errorCount=["a", "b"]), {("errors", "renamed"), ("errors", "type_changed")}),
    "added": ("audit", AUDIT | {"judge_model": "j"}, {("judge_model", "added")}),
    "added beside": ("audit", AUDIT | {"error_count": 1}, {("error_count", "added")}),
    "optional list": ("audit", AUDIT | {"combined_from": "x.json"}, {("combined_from", "type_changed")}),
    "nested": ("generation", GENERATION | {"failed_pairs": [{"id": "b_1", "semantic_score": 1}, {"id": "b_2", "semantic_score": "0.5", "reason": "x"}]}, {("failed_pairs.semantic_score", "type_changed"), ("failed_pairs.reason", "added")}),
    "nested renamed": ("generation", GENERATION | {"failed_pairs": [{"id": "b_1", "semanticScore": 0.1}]}, {("failed_pairs.semantic_score", "renamed")}),
    "list renamed": ("generation", without(GENERATION, "failed_pairs", failedPairs=[{"id": "b_1"}]), {("failed_pairs", "renamed"), ("failed_pairs.semantic_score", "removed")}),
    "list changed": ("generation", GENERATION | {"failed_pairs": "[]"}, {("failed_pairs", "type_changed")}),
    "empty list": ("generation", GENERATION | {"failed_pairs": []}, set()),
    "map": ("generation", GENERATION | {"failure_breakdown": {"semantic": 1.5}}, {("failure_breakdown", "type_changed")}),
}


def tables(spark, payloads):
    files = spark.createDataFrame([(i, f"f{i}", k, None, p) for i, (k, p) in enumerate(payloads)], "file_id long, file_name string, doc_kind string, landed_at timestamp, payload string")
    return files, spark.createDataFrame(CATALOG, "doc_kind string, field_path string, field_type string, is_optional boolean")


def test_cases(spark):
    ordinary = [("audit", json.dumps(AUDIT))] * 30 + [("generation", json.dumps(GENERATION))] * 30
    payloads = ordinary + [(k, json.dumps(d)) for k, d, _ in CASES.values()] + [("audit", "{broken"), ("audit", None), ("audit", '{"errors": NaN}'), ("other", "{}")]
    files, catalog = tables(spark, payloads)
    got: dict[int, set] = {}
    for r in sd.found(files.withColumn("unit", files["file_id"]), catalog).collect():
        got.setdefault(r["file_id"], set()).add((r["field"], r["change"]))
    for n, (name, (_, _, want)) in enumerate(CASES.items()):
        assert got.get(60 + n, set()) == want, name
    assert not any(i < 60 or i >= 60 + len(CASES) for i in got)


def test_empty_tables(spark):
    files, catalog = tables(spark, [("audit", "{}")])
    assert sd.found(files.limit(0), catalog).count() == 0
    assert sd.union_schema(files.limit(0), catalog).count() == 0
    assert sd.found(files, catalog).where("change = 'removed'").count() == 4


def test_unify(spark):
    payloads = [("audit", json.dumps(AUDIT))] * 12 + [("audit", json.dumps(without(AUDIT, "errors", error_count="7", x=[1]))), ("audit", "nope"), ("audit", json.dumps(AUDIT | {"accuracy_gap": "12.5%", "benchmark_type": ["toxicity"]}))]
    files, catalog = tables(spark, payloads)
    rows = {r["file_id"]: r for r in sd.unify(files, catalog, "audit").collect()}
    assert rows[12]["errors"] == 7 and rows[12]["extras"] == {"x": "[1]"} and not rows[13]["readable"] and rows[14]["accuracy_gap"] == pytest.approx(0.125) and rows[14]["benchmark_type"] == "toxicity"


def test_unify_fills_one_field_per_name(spark):
    """Every renamed field of the found changes is filled, and every removed one is null, in the unified table."""
    from pyspark.sql import functions as F

    from duoscope.plans.drift import table
    from tests.conftest import DATA

    files, catalog = table(spark, DATA, "raw_results"), table(spark, DATA, "field_catalog")
    found = sd.found(files, catalog).where("not contains(field, '.')")
    for kind in ("audit", "generation"):
        wide = sd.unify(files, catalog, kind)
        names = [f.name for f in wide.schema.fields if f.name not in ("file_id", "file_name", "landed_at", "readable", "extras")]
        filled = wide.select("file_id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).isNotNull().alias("filled")) for n in names])).alias("x")).select("file_id", "x.*")
        both = found.join(filled, ["file_id", "field"])
        assert both.where("change = 'removed' and filled").count() == 0
        assert both.where("change = 'renamed'").count() > 0
        typed = found.where("change = 'type_changed'").select("file_id", "field")
        assert both.where("change = 'renamed' and not filled").join(typed, ["file_id", "field"], "left_anti").count() == 0


TYPES = st.sampled_from(["null", "long", "double", "string", "boolean", "array<string>", "array<null>", "struct", "map<string,long>"])


@given(TYPES, TYPES, TYPES)
def test_lattice(a, b, c):
    assert sd.promote(a, b) == sd.promote(b, a) and sd.promote(a, a) == a
    top = sd.promote(sd.promote(a, b), c)
    assert sd.promote(top, a) == top


@pytest.mark.parametrize("a, b, least", [("acc_gap", "accuracy_gap", 0.99), ("n_errors", "errors", 0.4), ("totalPairs", "total_pairs", 1.0), ("audited_at", "audit_time", 0.99), ("failed_items", "failed_pairs", 0.99)])
def test_names(a, b, least):
    assert sd.name_similarity(a, b) >= least
