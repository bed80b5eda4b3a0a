"""Score cutoffs that keep a target share of each source (problem 3).

Distributed quickselect.  Every pass reads the still undecided scores once:
each partition counts them below, at and above the pivot of their source and
takes the median of either side; the weighted median of those partition
medians is the next pivot.  A pass discards at least a quarter of the
undecided scores of each source (half of them as a rule), so the number of
passes is logarithmic in the largest source, and skew between sources costs
nothing because no pass shuffles rows: only one row per partition and source
leaves a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duoscope.runtime import materialize

#: Sources times scores whose bounds and pivots are held by the driver at once (a few numbers each); more are taken in turns.
MAX_SOURCES = 100_000

_PASS = "gid int, n_gt bigint, n_eq bigint, n_lt bigint, med_gt double, med_lt double"


def long_scores(df: DataFrame, key: str, sources: list[str], scores: list[str]) -> DataFrame:
    """Rows (key, sources, score, value) of the usable scores: numbers from 0 to 1."""
    pairs = ", ".join(f"'{s}', cast(`{s}` as double)" for s in scores)
    return df.selectExpr(f"`{key}`", *[f"`{s}`" for s in sources], f"stack({len(scores)}, {pairs}) as (score, value)").where(
        F.col("value").between(0.0, 1.0)
    )


def _median_of(medians: list[tuple[float, int]]) -> float:
    if not medians:
        return float("nan")
    value, weight = np.array([m for m, _ in medians]), np.array([w for _, w in medians])
    order = np.argsort(value, kind="stable")
    running = np.cumsum(weight[order])
    return float(value[order][np.searchsorted(running, running[-1] / 2.0)])


def _pass(lo: np.ndarray, hi: np.ndarray, pivot: np.ndarray):
    """A partition's counts and side medians; exclusive bounds lo and hi mark what is undecided."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = len(lo)
        counts = np.zeros((3, g), dtype=np.int64)
        above: list[list[tuple[float, int]]] = [[] for _ in range(g)]
        below: list[list[tuple[float, int]]] = [[] for _ in range(g)]
        for pdf in batches:
            gid, v = pdf["gid"].to_numpy(), pdf["value"].to_numpy()
            open_ = (v > lo[gid]) & (v < hi[gid])
            gid, v = gid[open_], v[open_]
            order = np.lexsort((v, gid))
            gid, v = gid[order], v[order]
            starts = np.searchsorted(gid, np.arange(g))
            ends = np.searchsorted(gid, np.arange(g), side="right")
            for i in np.nonzero(ends > starts)[0]:
                part = v[starts[i] : ends[i]]
                a, b = np.searchsorted(part, pivot[i]), np.searchsorted(part, pivot[i], side="right")
                counts[:, i] += (len(part) - b, b - a, a)
                if b < len(part):
                    above[i].append((part[(b + len(part)) // 2], len(part) - b))
                if a > 0:
                    below[i].append((part[a // 2], a))
        hit = np.nonzero(counts.sum(axis=0))[0]
        yield pd.DataFrame(
            {
                "gid": hit.astype(np.int32),
                "n_gt": counts[0, hit],
                "n_eq": counts[1, hit],
                "n_lt": counts[2, hit],
                "med_gt": [_median_of(above[i]) for i in hit],
                "med_lt": [_median_of(below[i]) for i in hit],
            }
        )

    return run


def cutoffs(rows: DataFrame, targets: DataFrame, sources: list[str], max_sources: int = MAX_SOURCES) -> DataFrame:
    """One row per target: sources, score, keep_pct, usable rows and the cutoff.

    ``rows`` is the result of :func:`long_scores`.  The cutoff is the largest
    usable score for which at least keep_pct percent of the source's usable
    rows are at or above it, hence the ``max(1, ceil(keep_pct * n / 100))``-th
    largest one.  A target without usable rows, or a null keep_pct, gives no
    row.  Null sources match null targets.  Repeated targets give one row each
    for distinct keep_pct.
    """
    spark = rows.sparkSession
    wanted = [*sources, "score", "keep_pct"]
    aims = targets.select(*wanted).where(F.col("keep_pct").isNotNull()).distinct()
    listed = aims.limit(max_sources + 1).collect()
    if len(listed) > max_sources:  # the same, a part of the targets at a time
        parts = 2 * -(-aims.count() // max_sources)
        turn = F.pmod(F.xxhash64(*wanted), F.lit(parts))
        each = [cutoffs(rows, aims.where(turn == i), sources, max(max_sources, 2)) for i in range(parts)]
        return reduce(DataFrame.unionByName, each)
    fields = targets.select(*wanted).schema.fields
    result = T.StructType([*fields, T.StructField("usable", T.LongType()), T.StructField("cutoff", T.DoubleType())])
    if not listed:
        return spark.createDataFrame([], result)
    ids = spark.createDataFrame([(*r, i) for i, r in enumerate(listed)], T.StructType([*fields, T.StructField("gid", T.IntegerType())]))
    match = F.col("t.score").eqNullSafe(F.col("r.score"))
    for s in sources:
        match = match & F.col(f"t.{s}").eqNullSafe(F.col(f"r.{s}"))
    # at most MAX_SOURCES short rows
    values = rows.alias("r").join(F.broadcast(ids.alias("t")), match).select("t.gid", "r.value")

    g = len(listed)
    lo, hi, pivot = np.full(g, -np.inf), np.full(g, np.inf), np.full(g, 0.5)
    usable, k, cut = np.zeros(g, np.int64), np.zeros(g, np.int64), np.full(g, np.nan)
    first, held, open_rows = True, None, 0
    while True:
        seen = (
            values.mapInPandas(_pass(lo, hi, pivot), _PASS)
            .groupBy("gid")
            .agg(
                *[F.sum(c).alias(c) for c in ("n_gt", "n_eq", "n_lt")],
                F.expr("percentile(if(isnan(med_gt), null, med_gt), 0.5, n_gt)").alias("med_gt"),
                F.expr("percentile(if(isnan(med_lt), null, med_lt), 0.5, n_lt)").alias("med_lt"),
            )
            .collect()
        )  # at most one row per source
        open_rows = 0
        for r in seen:
            i = r["gid"]
            if first:
                usable[i] = r["n_gt"] + r["n_eq"] + r["n_lt"]
                k[i] = max(1, -(-int(listed[i]["keep_pct"]) * int(usable[i]) // 100))
                k[i] = min(k[i], usable[i])
            if not np.isnan(cut[i]):
                continue
            if k[i] <= r["n_gt"]:
                lo[i], pivot[i] = pivot[i], r["med_gt"]
                open_rows += r["n_gt"]
            elif k[i] <= r["n_gt"] + r["n_eq"]:
                cut[i] = pivot[i]
                lo[i], hi[i] = np.inf, -np.inf
            else:
                k[i] -= r["n_gt"] + r["n_eq"]
                hi[i], pivot[i] = pivot[i], r["med_lt"]
                open_rows += r["n_lt"]
        first = False
        left = [i for i in range(g) if usable[i] and np.isnan(cut[i])]
        if not left:
            break
        bounds = spark.createDataFrame([(int(i), float(lo[i]), float(hi[i]), int(k[i])) for i in left], "gid int, lo double, hi double, k bigint")
        undecided = values.join(F.broadcast(bounds), "gid").where("value > lo and value < hi").select("gid", "value")
        if held is None or open_rows * 8 <= held:
            values, held = (undecided, open_rows) if held is None else (materialize(undecided), open_rows)
    done = [(*listed[i], int(usable[i]), float(cut[i])) for i in range(g) if usable[i]]
    return spark.createDataFrame(done, result)


def kept(rows: DataFrame, cuts: DataFrame, key: str, sources: list[str]) -> DataFrame:
    """The rows (sources, score, key, value, cutoff) at or above their cutoff; ties at the cutoff stay."""
    match = F.col("r.score").eqNullSafe(F.col("c.score")) & (F.col("r.value") >= F.col("c.cutoff"))
    for s in sources:
        match = match & F.col(f"r.{s}").eqNullSafe(F.col(f"c.{s}"))
    return rows.alias("r").join(cuts.alias("c"), match).select(*[F.col(f"r.{c}") for c in [*sources, "score", key, "value"]], "c.keep_pct", "c.cutoff")
