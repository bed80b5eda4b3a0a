"""Regular expressions written for Unicode-aware matching, on the JVM.

``(?U)`` gives ``\\w``, ``\\s``, ``\\d`` and ``\\b`` their Unicode meaning and
``d`` makes ``$`` and ``.`` know line feeds only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def flags(pattern: str, ignore_case: bool = True, multiline: bool = False) -> str:
    """The pattern with inline flags for the JVM's engine."""
    return f"(?{'i' if ignore_case else ''}{'m' if multiline else ''}Ud){pattern}"


def has(text: Column, pattern: str, **options: bool) -> Column:
    """Whether the pattern is found anywhere."""
    return text.rlike(flags(pattern, **options))


def first(text: Column, pattern: str, group: int = 1, **options: bool) -> Column:
    """A group of the first match, or null."""
    return F.when(has(text, pattern, **options), F.regexp_extract(text, flags(pattern, **options), group))


def every(text: Column, pattern: str, group: int = 0, **options: bool) -> Column:
    """All matches as an array."""
    return F.regexp_extract_all(text, F.lit(flags(pattern, **options)), F.lit(group))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def remove(text: Column, pattern: str) -> Column:
    """Without any match, case ignored."""
    return F.regexp_replace(text, flags(pattern), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), lambda v: body(v))[0]
