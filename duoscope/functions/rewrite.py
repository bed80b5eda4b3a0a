"""Rewritten prompts: what models add around them, and whether they are rewrites at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from duoscope.functions import regex

# Commentary before and after a rewrite, and signs that the question was solved, in the order they apply.
LEADING = [
    r"^['\"]?(?:'Tis|Sure|Ah|Well|Now|So|Right|Ok|Okay),?\s+(?:a\s+)?(?:grand|good|fine|great|lovely)\s+(?:question|one).*?[!.]\s*",
    r"^(?:Let's see|Let me see|Right then|Now then|Here we go|Here goes).*?[!.]\s*",
    r"^(?:This is|That's).*?(?:question|text|sentence).*?[!.]\s*",
    r"^(?:Ah|Oh|Aye|Sure),?\s+",
    r"^(?:Here's|Here is)\s+(?:the|my)\s+(?:transformation|answer|response).*?[:.]\s*",
    r"^Transformed(?:\s+text)?:\s*",
]
TRAILING = [
    r"\s*(?:So there you go|There you are|Hope that helps).*?[!.]?\s*$",
    r"\s*(?:Is that|Does that|Would that).*?\?\s*$",
    r"\s*(?:Let me know if).*$",
]
SOLVED = [
    r"=\s*\d+(?:\.\d+)?",
    r"(?:the answer is|answer:|result:|total:|sum:)\s*\d+",
    r"(?:that's|which is|equals?)\s+\d+\s+(?:sheep|dollars|miles|hours|days|years|pounds|euros|items|things)",
    r"(?:so|therefore|thus),?\s+(?:altogether|in total|combined)",
]


def clean_rewrite(text: Column) -> Column:
    """Without commentary at either end and one pair of quotes around it; null and empty texts stay."""
    bare = reduce(regex.remove, [*LEADING, *TRAILING], regex.strip(text))
    quoted = reduce(lambda a, q: a | (bare.startswith(q) & bare.endswith(q)), ['"', "'"], F.lit(False))
    inner = F.substring(bare, F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0)))
    return regex.strip(F.when(quoted, inner).otherwise(bare))


def detect_solution(rewrite: Column, original: Column) -> Column:
    """Whether the question was solved instead of rewritten."""
    longer = lambda f: F.length(rewrite) > F.length(original) * F.lit(f)
    solved = regex.has(rewrite, "|".join(f"(?:{p})" for p in SOLVED))
    asks = lambda c: regex.strip(c).endswith("?")
    return (solved & longer(1.5)) | (asks(original) & ~asks(rewrite) & longer(1.3))


def invalid_reason(rewrite: Column, original: Column, max_ratio: float = 2.0) -> Column:
    """Why a rewrite can't be used, or null: empty, solved, or much longer than the original."""
    ratio = F.when(F.length(original) > 0, F.length(rewrite) / F.length(original)).otherwise(F.lit(float("inf")))
    return (
        F.when(F.coalesce(rewrite, F.lit("")) == "", "Empty transformation")
        .when(detect_solution(rewrite, original), "LLM solved the problem instead of transforming")
        .when(ratio > max_ratio, F.format_string("Output too long (ratio: %.1f)", ratio))
    )


def rewrite_prompt(template: str, text: Column) -> Column:
    """A user prompt with the text in its ``{text}`` place."""
    return F.replace(F.lit(template), F.lit("{text}"), text)


def rewrite_prompt_batch(template: str, texts: Column) -> Column:
    """A user prompt with numbered texts in its ``{texts}`` place."""
    lines = F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t))
    return F.replace(F.lit(template), F.lit("{texts}"), F.array_join(lines, "\n"))
