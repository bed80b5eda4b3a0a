"""Dialect features and authenticity of a text, as column expressions.

Patterns are unrolled into literals, so that each is compiled once and the
text is scanned inside one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duoscope.functions import regex
from duoscope.specs.dialects import Dialect


def _or(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def has_feature(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern of a feature is found."""
    return _or([regex.has(text, p) for p in patterns])


def features_found(text: Column, dialect: Dialect) -> Column:
    """Ids of the features found, in the specification's order."""
    return F.array_compact(F.array(*[F.when(has_feature(text, f.patterns), f.id) for f in dialect.features]))


def feature_matches(text: Column, dialect: Dialect) -> Column:
    """Every match of every pattern: feature_id, priority, matched_text, start, end (code points)."""
    parts = [_matches(text, f.id, f.priority, p) for f in dialect.features for p in f.patterns]
    return F.flatten(F.array(*parts))


def _matches(text: Column, feature_id: str, priority: str, pattern: str) -> Column:
    """Matches of one pattern; a match starts behind all that was split off and matched before it.

    The sums grow with the matches of one pattern in one text, which are few;
    carrying them along in one aggregate took three times as long.
    """
    found, between = regex.every(text, pattern), F.split(text, regex.flags(pattern), -1)
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda a, s: a + F.length(s))

    def place(match: Column, i: Column) -> Column:
        start = total(F.slice(between, F.lit(1), i + 1)) + total(F.slice(found, F.lit(1), i))
        return F.struct(F.lit(feature_id).alias("feature_id"), F.lit(priority).alias("priority"), match.alias("matched_text"), start.alias("start_pos"), (start + F.length(match)).alias("end_pos"))

    return F.transform(found, place)


def coverage(found: Column, dialect: Dialect) -> Column:
    """Share of the dialect's features that were found."""
    return F.size(found) / F.lit(float(len(dialect.features))) if dialect.features else F.lit(0.0)


def high_priority_found(found: Column, dialect: Dialect) -> Column:
    """How many high-priority features were found."""
    return F.size(F.array_intersect(found, F.array(*[F.lit(x) for x in dialect.high_priority]).cast("array<string>")))


def features_valid(found: Column, dialect: Dialect, min_features: int = 1, require_high_priority: bool = False) -> Column:
    """Whether enough features were found, one of high priority if asked for."""
    ok = F.size(found) >= min_features
    return ok & (high_priority_found(found, dialect) > 0) if require_high_priority else ok


def avoided(text: Column, dialect: Dialect) -> Column:
    """Phrases to avoid that stand in the text, case ignored."""
    return F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(p.lower())), p) for p in dialect.avoid]).cast("array<string>"))


def stereotypes(text: Column, dialect: Dialect) -> Column:
    """All matches of the stereotype patterns, in the specification's order."""
    return F.flatten(F.array(*[regex.every(text, p) for p in dialect.stereotypes]))


def suspicious(text: Column, dialect: Dialect) -> Column:
    """All matches of the suspicious patterns."""
    return F.flatten(F.array(*[regex.every(text, p) for p in dialect.suspicious]))


def marker_count(text: Column, dialect: Dialect) -> Column:
    """How many authentic markers are found at least once."""
    total = F.lit(0)
    for p in dialect.markers:
        total = total + regex.has(text, p).cast("int")
    return total


def authenticity_score(text: Column, dialect: Dialect) -> Column:
    """0.7, less 0.2 per stereotype and 0.1 per suspicious match, plus 0.1 per marker, from 0 to 1."""
    score = F.lit(0.7) - F.size(stereotypes(text, dialect)) * F.lit(0.2)
    score = score - F.size(suspicious(text, dialect)) * F.lit(0.1)
    score = score + marker_count(text, dialect) * F.lit(0.1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
