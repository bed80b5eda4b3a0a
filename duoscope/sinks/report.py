"""A report page from the small tables of an analysis."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.functions import labels
from duoscope.operators import reports, statistics



def charts(audits: DataFrame, rows: DataFrame, primary: str, second: str) -> dict[str, DataFrame]:
    """The data of every chart, each as a DataFrame.

    ``audits``: the newest audits of all models; ``rows``: graded pairs with
    ``features``, their feature counts; ``primary``: the model of the
    single-model charts, ``second`` the one it is compared with.
    """
    keys = ["model", "benchmark", "dialect"]
    one = audits.where(F.col("model") == primary)
    points = one.withColumn("gap_pp", F.col("accuracy_gap") * 100)
    tests = statistics.bh_adjust(statistics.mcnemar_audits(audits), "p_value", keys)
    toxic = one.where(F.col("benchmark").isin(labels.TOXICITY_BENCHMARKS))
    both = audits.where(F.col("model").isin(primary, second) & (F.col("benchmark") == "gsm8k"))
    return {
        "accuracy_by_model": reports.benchmark_table(audits, labels.ACCURACY_BENCHMARKS),
        "toxicity_by_model": reports.benchmark_table(audits, labels.TOXICITY_BENCHMARKS, None, None),
        "significance": reports.significance_grid(audits, tests),
        "accuracy_gaps": reports.pivot(points, "dialect", "benchmark", labels.ACCURACY_BENCHMARKS, "gap_pp"),
        "toxicity_gaps": reports.pivot(points, "dialect", "benchmark", labels.TOXICITY_BENCHMARKS, "gap_pp"),
        "accuracy_pairs": one.where(F.col("benchmark").isin(labels.ACCURACY_BENCHMARKS)).select("benchmark", "dialect", "original_accuracy", "transformed_accuracy").orderBy("benchmark", "dialect"),
        "dialects": reports.means(one.where(F.col("benchmark").isin(labels.ACCURACY_BENCHMARKS)), ["dialect"]),
        "refusals": toxic.select("benchmark", "dialect", "original_accuracy", "transformed_accuracy").orderBy("benchmark", "dialect"),
        "two_models": both.select("model", "dialect", "original_accuracy", "transformed_accuracy", "accuracy_gap").orderBy("model", "dialect"),
        "bias": reports.bias_by_class(one),
        "features_at_least": reports.suppress_small(reports.threshold_stats(rows)),
        "features_in_ranges": reports.range_stats(rows),
        "features_in_ranges_by_model": reports.range_stats(rows, ["model"]),
        "features_in_ranges_by_dialect": reports.range_stats(rows, ["dialect"]),
    }


def tables(audits: DataFrame) -> dict[str, DataFrame]:
    """What a report consists of, each as a DataFrame."""
    keys = ["benchmark", "dialect", "model"]
    named = audits.withColumn("benchmark_label", labels.label(F.col("benchmark"), labels.BENCHMARK_LABELS)).withColumn("dialect_label", labels.title_case(F.col("dialect")))
    return {
        "overall": reports.means(audits, []),
        "dialects": reports.means(audits, ["dialect"]).orderBy("dialect"),
        "benchmarks": reports.means(audits, ["benchmark"]).orderBy("benchmark"),
        "worst": reports.top_gaps(named, 5, keys),
        "results": named.orderBy(*keys),
        "gaps": reports.means(audits, ["benchmark", "dialect"]).select("benchmark", "dialect", (F.col("accuracy_gap") * 100).alias("gap_pp")).orderBy("benchmark", "dialect"),
    }


def _pct(v: float | None, sign: bool = False) -> str:
    return "-" if v is None else f"{v * 100:+.1f}%" if sign else f"{v * 100:.1f}%"


def _table(head: list[str], rows: list[list[str]]) -> str:
    cells = lambda tag, r: "".join(f"<{tag}>{escape(str(x))}</{tag}>" for x in r)
    return f"<table><tr>{cells('th', head)}</tr>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in rows) + "</table>"


def html(audits: DataFrame, title: str = "Dialect audit") -> str:
    """The page: headline numbers, findings, worst gaps, all results."""
    t = tables(audits)
    o = t["overall"].first()
    worst = t["worst"].collect()
    dims = audits.agg(F.count_distinct("dialect").alias("d"), F.count_distinct("benchmark").alias("b")).first()
    line = lambda r: [r["benchmark_label"], r["dialect_label"], r["model"], _pct(r["original_accuracy"]), _pct(r["transformed_accuracy"]), _pct(r["accuracy_gap"], True), r["total_pairs"]]
    head = ["Benchmark", "Dialect", "Model", "SAE", "Dialect accuracy", "Gap", "Pairs"]
    cards = [("SAE accuracy", _pct(o["original_accuracy"])), ("Dialect accuracy", _pct(o["transformed_accuracy"])), ("Mean gap", _pct(o["accuracy_gap"], True)), ("Pairs", o["total_pairs"] or 0)]
    named = ", ".join(r["benchmark_label"] for r in worst[:3]) or "none"
    found = f"{dims['b']} benchmarks and {dims['d']} dialects; the largest degradation is on {named}."
    parts = [f"<h1>{escape(title)}</h1>", "<ul>" + "".join(f"<li>{escape(k)}: <b>{escape(str(v))}</b></li>" for k, v in cards) + "</ul>", f"<p>{escape(found)}</p>"]
    parts += ["<h2>Largest gaps</h2>", _table(head, [line(r) for r in worst]), "<h2>All results</h2>", _table(head, [line(r) for r in t["results"].toLocalIterator()])]
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body>{''.join(parts)}</body></html>"
