"""Keyword-stuffed and link-list pages (problem 8).

The words of each page are counted and ranked with SQL windows, and a line is
fitted through log frequency against log rank.  Prose follows such a line and
shares its frequent words with other prose of its language; pages written for
search engines repeat a few words evenly, so their curve starts flat and falls
off, and their words are not those of prose.  Slope, residual and divergence
from the nearest language's prose are each compared with the pages of that
language and of comparable length; an extreme one of the three flags the page.
Menus, notices and footers, found as lines that stand on many pages of a host or
of all hosts, are left out first; lines made like keyword lists never are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duoscope.llm.tokens import Words, bounded
from duoscope.runtime import materialize

#: Share of all pages, and least number of them, from which a line is a menu entry, notice or footer.
COMMON_SHARE, COMMON_LEAST = 0.02, 8
#: The same of a host's pages.
HOST_SHARE, HOST_LEAST = 0.2, 5
#: Words from which a line without a sentence mark is a list, not a menu entry.
LIST_WORDS = 9
#: Lines of hosts up to which they are sent to every task; more are joined by host.
MAX_HOST_LINES = 1_000_000
#: Pages a language needs to be modelled, as a share of all; so at most 1 / LANGUAGE_SHARE languages are.
LANGUAGE_SHARE = 0.005
#: Words below which a page has no curve to speak of; it is stuffed if repetitions are more than half of it.
LEAST_WORDS = 12
#: Least probability of a word in a language, given to all words below it; so a model has at most 1 / FLOOR words of a language.
FLOOR = 5e-6
#: Different pages a language needs at a length to be compared by itself; else all languages are.
GROUP_LEAST = 40
#: Divergence beyond the median of comparable pages that is extreme: in robust deviations, and at least.
DEVIATIONS, MARGIN = 5.0, 1.0
#: The same for slope and residual: alone, and together with a divergence of three quarters of its limit.
CURVE_ALONE, CURVE_DEVIATIONS = 8.0, 6.0

#: What a word of another modelled language costs beyond its own probability, in nats.
FOREIGN = 1.0
#: Bounds of a robust deviation of divergence, and how far a language's median may lie above that of all pages.
LEAST_DEV, MOST_DEV, MOST_ABOVE = 0.1, 0.35, 1.0

_BREAK = re.compile(r"\n| \| ")
_OTHER = re.compile(r"[^\x00-\x7f]+")
_SENTENCE_END = (".", "!", "?", "…", "।", "。", ":", "»", '"', "”")


def _line(x: str) -> int:
    return xxhash.xxh64_intdigest(x) - (1 << 63)


def _may_be_menu(line: str) -> bool:
    """Entries and sentences may be parts of menus, notices and footers; lists of keywords and tags may not."""
    return bool(line) and (line.endswith(_SENTENCE_END) or line.count(",") < 3 and len(line.split()) < LIST_WORDS)


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [sorted({_line(x) for x in map(str.strip, _BREAK.split(t)) if _may_be_menu(x)}) for t in pdf["text"]]
        yield pd.DataFrame({"source": pdf["source"], "page": [xxhash.xxh64_intdigest(t) - (1 << 63) for t in pdf["text"]], "lines": found})


def common_lines(documents: DataFrame) -> tuple[list[int], DataFrame]:
    """Lines on many different pages of all hosts, and (source, line) of those on many different pages of a host.

    Pages with the same text on the same host count once.  Of the first there
    are at most fifty times, of the second at most five times a host, as many
    as a page has lines.
    """
    pages = documents.select("source", "text").mapInPandas(_lines, "source string, page bigint, lines array<bigint>").dropDuplicates(["source", "page"])
    pages = materialize(pages)
    hosts = pages.groupBy("source").agg(F.count("*").alias("of"))
    n = pages.count()
    seen = materialize(pages.select("source", F.explode("lines").alias("line")).groupBy("source", "line").agg(F.count("*").alias("n")).where("n > 1"))
    everywhere = seen.groupBy("line").agg(F.sum("n").alias("n")).where(F.col("n") >= max(COMMON_LEAST, int(COMMON_SHARE * n)))
    own = seen.where(F.col("n") >= HOST_LEAST).join(hosts, "source").where(F.col("n") >= HOST_SHARE * F.col("of")).select("source", "line")
    return sorted(r["line"] for r in everywhere.select("line").collect()), own


def _read_bodies(everywhere: set[int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def body(text: str, own: set[int]) -> str:
        kept = "\n".join(x for x in _BREAK.split(text) if (h := _line(x.strip())) not in everywhere and h not in own).lower()
        if not kept.isascii():
            other = sum(map(len, _OTHER.findall(kept)))
            if other * 2 <= len(kept):
                # runs of other characters inside Latin words are one letter, so that garbled and sound spellings are one word
                kept = _OTHER.sub("ø", kept)
        return kept.replace("'", " ").replace("-", " ")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in bounded(batches, ["text"]):
            w = Words([body(t, set(own) if own is not None else set()) for t, own in zip(pdf["text"], pdf["own"])])
            order = np.lexsort((w.exact, w.doc))
            h, doc = w.exact[order], w.doc[order]
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.zeros(0, np.int64)
            f = np.diff(np.append(first, len(h))).astype(np.int32)
            h, doc = h[first].view(np.int64), doc[first]
            at = np.searchsorted(doc, np.arange(1, w.n))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "words": np.split(h, at), "f": np.split(f, at)})

    return read


def bodies(documents: DataFrame) -> DataFrame:
    """doc_id, lang, ``words`` and ``f``: a page's different lower-cased words as hashes, common lines left out, and how often each stands."""
    lang = F.lower(F.substring(F.coalesce("lang", F.lit("")), 1, 2)).alias("lang")
    source = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source") if "source" in documents.columns else F.lit("").alias("source")
    texts = documents.where(F.length("text") > 0).select("doc_id", lang, source, "text")
    everywhere, own = common_lines(texts)
    own = materialize(own)
    per_host = own.groupBy("source").agg(F.collect_list("line").alias("own"))  # at most five times a page's lines
    if own.count() <= MAX_HOST_LINES:
        per_host = F.broadcast(per_host)
    return texts.join(per_host, "source", "left").select("doc_id", "lang", "text", "own").mapInPandas(_read_bodies(set(everywhere)), "doc_id bigint, lang string, words array<bigint>, f array<int>")


def prose_models(pages: DataFrame) -> tuple[DataFrame, int]:
    """(word, logs): log share of each language's pages that have the word, for the words that reach FLOOR in some language.

    Page shares, not counts: what a single page repeats doesn't make prose.
    """
    counts = pages.groupBy("lang").count()
    all_pages = counts.agg(F.sum("count")).first()[0] or 0
    some = counts.where((F.col("count") >= max(3, LANGUAGE_SHARE * all_pages)) & ~F.col("lang").isin("", "un")).orderBy(F.desc("count"), "lang").collect()
    langs = [r["lang"] for r in some] or [""]
    per = materialize(pages.where(F.col("lang").isin(langs)).select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("d")))
    totals = {r["lang"]: r["t"] for r in per.groupBy("lang").agg(F.sum("d").alias("t")).collect()}
    share = F.col("d") / F.create_map(*[F.lit(x) for k in langs for x in (k, float(totals.get(k) or 1))])[F.col("lang")]
    known = per.withColumn("share", share).where(F.col("share") >= FLOOR)
    model = known.groupBy("word").agg(*[F.max(F.when(F.col("lang") == k, F.col("share"))).alias(f"d{i}") for i, k in enumerate(langs)])
    logs = [F.log(F.coalesce(f"d{i}", F.lit(FLOOR))) for i in range(len(langs))]
    return materialize(model.select("word", F.array(*logs).alias("logs"))), len(langs)


def curves(pages: DataFrame) -> DataFrame:
    """Per page: words, distinct words, slope, residual, nearest language and divergence from its prose.

    One shuffle by page carries counting, ranking and fitting.
    """
    model, n = prose_models(pages)
    counted = pages.repartition("doc_id").select("doc_id", F.explode(F.arrays_zip("words", "f")).alias("x")).select("doc_id", F.col("x.words").alias("word"), "x.f")
    # at most 1 / FLOOR words of a language
    near = lambda i: F.greatest(F.col("logs")[i], F.array_max("logs") - FOREIGN)
    known = counted.join(F.broadcast(model), "word", "left").select("doc_id", "word", "f", *[F.coalesce(near(i), F.lit(math.log(FLOOR))).alias(f"p{i}") for i in range(n)])
    ranked = known.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("f"), "word")))
    x, y = "ln(r)", "ln(f)"
    fit = ranked.groupBy("doc_id").agg(
        F.sum("f").alias("words"), F.count("*").alias("distinct_words"), F.expr(f"regr_slope({y}, {x})").alias("slope"), F.expr(f"regr_sxx({y}, {x})").alias("sxx"), F.expr(f"regr_syy({y}, {x})").alias("syy"),
        F.expr("sum(f * ln(f))").alias("flogf"), *[F.sum(F.col("f") * F.col(f"p{i}")).alias(f"c{i}") for i in range(n)],
    )
    entropy = F.log("words") - F.col("flogf") / F.col("words")
    fits = F.array(*[F.struct(F.col(f"c{i}").alias("c"), F.lit(i).alias("language")) for i in range(n)])
    best = F.array_max(fits)
    slope = F.coalesce("slope", F.lit(0.0))
    residual = F.sqrt(F.greatest(F.lit(0.0), F.coalesce("syy", F.lit(0.0)) - slope * slope * F.coalesce("sxx", F.lit(0.0))) / F.col("distinct_words"))
    return fit.select("doc_id", "words", "distinct_words", slope.alias("slope"), residual.alias("residual"), best["language"].alias("language"), (-best["c"] / F.col("words") - entropy).alias("divergence"))


_FEATURES = ["slope", "residual", "divergence"]


def _usual(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Medians and robust deviations of different pages per group.

    Deviations come from the better half of the pages, which stuffed ones
    don't reach: the lower half of divergence and residual, the upper of slope.
    """
    out = fits.groupBy(*keys).agg(F.count("*").alias("n"), *[F.percentile_approx(c, F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)]), 10_000).alias(c) for c in _FEATURES])
    dev = {c: (F.col(c)[1] - F.col(c)[0]) / 0.674 for c in ("residual", "divergence")} | {"slope": (F.col("slope")[2] - F.col("slope")[1]) / 0.674}
    return out.select(*keys, "n", *[F.col(c)[1].alias(f"{c}_mid") for c in _FEATURES], *[dev[c].alias(f"{c}_dev") for c in _FEATURES])


def _of_length(different: DataFrame) -> DataFrame:
    """What is usual at each length over all languages.

    A length with few pages takes what holds for the next shorter one that has
    enough: longer prose diverges less, so this is on the safe side.
    """
    every = _usual(different, ["length"])
    values = F.struct(*[c for c in every.columns if c != "length"])
    w = Window.orderBy("length")  # a row per length, some twenty of them
    enough = F.when(F.col("n") >= GROUP_LEAST, values)
    shorter = F.last(enough, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return every.select("length", F.coalesce(shorter, values).alias("all"))


def classify(documents: DataFrame) -> DataFrame:
    """Every page with a text: its curve, how far it is from comparable pages, and ``stuffed``.

    Empty and null texts give no row; ``curve`` is the larger of the deviations
    of slope and residual; pages of fewer than LEAST_WORDS words are stuffed if
    repetitions are more than half of them; copies get the same verdict each.  Whole texts are read.
    """
    fits = materialize(curves(materialize(bodies(documents))).withColumn("length", F.floor(F.log2("words")).cast("int")))
    different = fits.where(F.col("words") >= LEAST_WORDS).dropDuplicates(["words", "distinct_words", "slope", "divergence"])
    own = _usual(different, ["language", "length"]).where(F.col("n") >= GROUP_LEAST)
    # a row per language and length
    joined = fits.join(F.broadcast(own), ["language", "length"], "left").join(F.broadcast(_of_length(different)), "length", "left")
    of = lambda c: F.coalesce(F.col(c), F.col(f"all.{c}"))
    mid = F.least(of("divergence_mid"), F.col("all.divergence_mid") + MOST_ABOVE)
    far_by = F.greatest(F.lit(MARGIN), DEVIATIONS * F.least(F.greatest(of("divergence_dev"), F.lit(LEAST_DEV)), F.lit(MOST_DEV)))
    beyond = F.col("divergence") - mid
    slope = (of("slope_mid") - F.col("slope")) / F.greatest(of("slope_dev"), F.lit(0.05))
    residual = (F.col("residual") - of("residual_mid")) / F.greatest(of("residual_dev"), F.lit(0.02))
    curve = F.greatest(slope, residual)
    repeated = (F.col("words") >= 4) & (2 * (F.col("words") - F.col("distinct_words")) > F.col("words"))
    # a curve by itself tells only against pages of the same language, and not on pages of the most usual words
    alone = (curve >= CURVE_ALONE) & F.col("n").isNotNull() & (beyond > 0)
    long_enough = (beyond >= far_by) | alone | (curve >= CURVE_DEVIATIONS) & (beyond >= 0.75 * far_by)
    stuffed = F.coalesce(F.when(F.col("words") >= LEAST_WORDS, long_enough).otherwise(repeated), F.lit(False))
    return joined.select("doc_id", "words", "distinct_words", "slope", "residual", "language", "divergence", beyond.alias("beyond"), far_by.alias("far_by"), curve.alias("curve"), stuffed.alias("stuffed"))
