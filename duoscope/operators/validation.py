"""Rewrites checked for meaning, dialect features and authenticity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscope.functions import dialect as fd
from duoscope.functions import stats
from duoscope.specs.dialects import DIALECTS, Dialect

VALIDATORS = ["semantic", "feature", "authenticity"]


@dataclass(frozen=True)
class Thresholds:
    """What a rewrite must reach; shares outside 0 to 1 are refused."""

    semantic: float = 0.80
    min_features: int = 1
    require_high_priority: bool = False
    authenticity: float = 0.5
    fail_fast: bool = False
    require_all: bool = True

    def __post_init__(self) -> None:
        for name in ("semantic", "authenticity"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} threshold must be between 0 and 1")


class Embedder(Protocol):
    """Encodes texts as vectors; created once per worker."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Deterministic bag-of-words vectors, for tests and where no encoder is installed."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, zlib.crc32(w.encode()) % self.size] += 1.0
        return out


def embed(df: DataFrame, columns: list[str], embedder: type[Embedder] | None = None) -> DataFrame:
    """Adds {column}_embedding for each text column, one encoder per worker; null texts have null vectors."""
    make = embedder or HashEmbedder
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], *[f"`{c}_embedding` array<double>" for c in columns]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for pdf in batches:
            for c in columns:
                vectors = encoder.encode([t if isinstance(t, str) else "" for t in pdf[c]])
                pdf[f"{c}_embedding"] = [v.tolist() if isinstance(t, str) else None for v, t in zip(vectors, pdf[c])]
            yield pdf

    return df.mapInPandas(run, schema)


def semantic(df: DataFrame, a: str, b: str, threshold: float = 0.85) -> DataFrame:
    """Similarity of two vectors and whether it reaches the threshold."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be between 0 and 1")
    return df.withColumn("similarity", stats.cosine_similarity(F.col(a), F.col(b))).withColumn("is_valid", F.col("similarity") >= threshold)


def per_dialect(code: Column, of: dict[str, Column]) -> Column:
    """The expression of the row's dialect, null for others; only that one is evaluated."""
    out = F.lit(None)
    for k, e in of.items():
        out = F.when(code == k, e).otherwise(out)
    return out


def features(df: DataFrame, text: str, code: str, thresholds: Thresholds = Thresholds(), dialects: dict[str, Dialect] = DIALECTS) -> DataFrame:
    """Features found, their count, coverage, high-priority ones, and the verdict."""
    t, c = F.col(text), F.col(code)
    out = df.withColumn("features_found", per_dialect(c, {k: fd.features_found(t, d) for k, d in dialects.items()}))
    found = F.col("features_found")
    return out.select(
        "*", F.size(found).alias("features"), per_dialect(c, {k: fd.coverage(found, d) for k, d in dialects.items()}).alias("coverage_score"),
        per_dialect(c, {k: fd.high_priority_found(found, d) for k, d in dialects.items()}).alias("high_priority_found"),
        per_dialect(c, {k: fd.features_valid(found, d, thresholds.min_features, thresholds.require_high_priority) for k, d in dialects.items()}).alias("feature_valid"),
    )


def authenticity(df: DataFrame, text: str, code: str, threshold: float = 0.5, dialects: dict[str, Dialect] = DIALECTS) -> DataFrame:
    """Authenticity score and verdict, with the matches that lower it."""
    t, c = F.col(text), F.col(code)
    out = df.withColumn("score", per_dialect(c, {k: fd.authenticity_score(t, d) for k, d in dialects.items()}))
    out = out.withColumn("stereotypes", per_dialect(c, {k: fd.stereotypes(t, d) for k, d in dialects.items()}))
    return out.withColumn("authenticity_valid", F.col("score") >= threshold)


def verdict(semantic_ok: Column, feature_ok: Column, authenticity_ok: Column, thresholds: Thresholds = Thresholds()) -> tuple[Column, Column, Column]:
    """(passed, failed, status) of three checks.

    With fail_fast the first failed check is the last one made.  No failure
    means passed, no success failed; in between all are required or the
    status is partial.
    """
    oks = [semantic_ok, feature_ok, authenticity_ok]
    made = [F.lit(True), semantic_ok, semantic_ok & feature_ok] if thresholds.fail_fast else [F.lit(True)] * 3
    pick = lambda want: F.array_compact(F.array(*[F.when(m & (ok == F.lit(want)), n) for n, ok, m in zip(VALIDATORS, oks, made)]))
    passed, failed = pick(True), pick(False)
    mixed = "failed" if thresholds.require_all or thresholds.fail_fast else "partial"
    status = F.when(F.size(failed) == 0, "passed").when(F.size(passed) == 0, "failed").otherwise(mixed)
    return passed, failed, status


def failure_reasons(df: DataFrame, thresholds: Thresholds = Thresholds()) -> Column:
    """Readable reasons from the columns similarity, features, high_priority_found, score and stereotypes."""
    reasons = [
        F.when(F.col("similarity") < thresholds.semantic, F.format_string(f"Semantic similarity too low: %.3f < {thresholds.semantic:.2f}", "similarity")),
        F.when(~F.col("feature_valid"), F.format_string(f"Insufficient dialect features: %d < {thresholds.min_features} required", "features")),
        F.when(~F.col("feature_valid") & F.lit(thresholds.require_high_priority) & (F.col("high_priority_found") == 0), "No high-priority features detected"),
        F.when(F.col("score") < thresholds.authenticity, F.format_string(f"Low authenticity score: %.3f < {thresholds.authenticity:.2f}", "score")),
        F.when((F.col("score") < thresholds.authenticity) & (F.size("stereotypes") > 0), F.concat(F.lit("Stereotypes detected: "), F.array_join(F.slice("stereotypes", 1, 3), ", "))),
    ]
    return F.array_compact(F.array(*reasons))


def validate_pairs(df: DataFrame, thresholds: Thresholds = Thresholds(), similarity: str | None = None, dialects: dict[str, Dialect] = DIALECTS) -> DataFrame:
    """All three checks of (original, transformed, dialect), the status and its reasons.

    ``similarity`` names a column that holds the similarity already; without
    it both texts are embedded.
    """
    if similarity is None:
        both = embed(df, ["original", "transformed"])
        out = both.withColumn("similarity", stats.cosine_similarity(F.col("original_embedding"), F.col("transformed_embedding"))).drop("original_embedding", "transformed_embedding")
    else:
        out = df.withColumn("similarity", F.col(similarity))
    out = authenticity(features(out, "transformed", "dialect", thresholds, dialects), "transformed", "dialect", thresholds.authenticity, dialects)
    semantic_ok = F.coalesce(F.col("similarity") >= thresholds.semantic, F.lit(False))
    passed, failed, status = verdict(semantic_ok, F.coalesce("feature_valid", F.lit(False)), F.coalesce("authenticity_valid", F.lit(False)), thresholds)
    return out.withColumns({"passed_validators": passed, "failed_validators": failed, "status": status, "reasons": failure_reasons(out, thresholds)})


def filter_valid(validated: DataFrame) -> DataFrame:
    """Only rewrites that passed."""
    return validated.where("status = 'passed'")


def batch_stats(validated: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status, pass rate, mean authenticity and features per group."""
    return validated.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "partial").alias("partial"),
        (F.count_if(F.col("status") == "passed") / F.count("*")).alias("pass_rate"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("authenticity_mean"), (F.sum("features") / F.count("*")).alias("avg_features"),
    )


def similarity_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean, population deviation, extremes and pass rate of similarity and is_valid; zeros where empty."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.count("similarity").alias("count"), zero(F.avg("similarity")).alias("mean"), zero(F.stddev_pop("similarity")).alias("std"), zero(F.min("similarity")).alias("min"), zero(F.max("similarity")).alias("max"),
        zero(F.count_if("is_valid") / F.count("similarity")).alias("pass_rate"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"),
    )
