"""Documents filled into containers of fixed capacity (problem 6).

Sizes are tokens of a public tokenizer.  Documents are dealt by hash into
groups of bounded size, each group is packed by itself: best fit decreasing
first, then a swap-based local search that moves documents, exchanges one for
one or two for one between underfull bins, each step increasing the sum of
squared fills, until bins empty.  Bins that stay underfull are pooled over many
groups and packed once more, so that dealing into groups costs next to nothing.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.runtime import materialize

#: Documents of a group, expected; what a task holds at once.
GROUP = 4_000
#: Bins filled less than this share are pooled and packed again.
UNDERFULL = 0.97
_SIZES = "doc_id bigint, tokens bigint"
_BINS = "job_name string, capacity bigint, container string, doc_id bigint, piece int, tokens bigint, filled bigint"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public vocabulary files lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counter(path: str) -> Callable[[str], int]:
    """Counts tokens of the byte-level BPE vocabulary (ranks, one per line) at ``path``."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))


def token_sizes(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and tokens of the whole text; null and empty texts have none."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [count(t) if isinstance(t, str) and t else 0 for t in pdf["text"]]})

    return documents.select("doc_id", "text").mapInPandas(run, _SIZES)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item."""
    out = np.zeros(len(sizes), dtype=np.int64)
    spaces: list[tuple[int, int]] = []  # (space, bin), sorted
    bins = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        at = bisect_left(spaces, (s, -1))
        if at == len(spaces):
            space, b = capacity, bins
            bins += 1
        else:
            space, b = spaces.pop(at)
        out[i] = b
        if space > s or s == 0:
            insort(spaces, (space - s, b))
    return out


def _outs(sizes: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """What one or two of some items amount to, ascending, and the items of each amount.

    Only different sizes are paired; as they lie in one bin, there are at most
    the square root of twice its capacity of them.
    """
    of = sizes[mine]
    order = np.argsort(of, kind="stable")
    u, first, n = np.unique(of[order], return_index=True, return_counts=True)
    at = mine[order][first]
    twice = n > 1
    second = mine[order][np.minimum(first + 1, len(mine) - 1)]
    x, y = np.triu_indices(len(u), 1)
    sums = np.concatenate((u, 2 * u[twice], u[x] + u[y]))
    given = [(int(i),) for i in at] + [(int(i), int(k)) for i, k in zip(at[twice], second[twice])]
    outs, where = np.unique(sums, return_index=True)
    own = len(given)
    return outs, [given[w] if w < own else (int(at[x[w - own]]), int(at[y[w - own]])) for w in where.tolist()]


def local_search(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Empties bins by moves and by exchanges one for one and two for one that increase squared fill.

    The search ends when the least possible number of bins is reached or when
    no bin with space can be emptied by any move or exchange.
    """
    bins = bins.copy()
    n = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, sizes, n).astype(np.int64)
    least = max(1, -(-int(sizes.sum()) // capacity))
    used = int((np.bincount(bins, minlength=n) > 0).sum())
    stuck: set[int] = set()
    alive = np.bincount(bins, minlength=n) > 0
    while used > least:
        open_bins = [b for b in np.nonzero(alive)[0] if b not in stuck and fill[b] < capacity]
        if len(open_bins) < 2:
            break
        a = min(open_bins, key=lambda b: fill[b])
        while True:
            mine = np.nonzero(bins == a)[0]
            if not len(mine):
                alive[a] = False
                used -= 1
                break
            others = np.nonzero(alive)[0]
            others = others[others != a]
            step = False
            # move: into the fullest bin that has the space
            for i in mine[np.argsort(-sizes[mine])]:
                room = others[capacity - fill[others] >= sizes[i]]
                if len(room):
                    b = room[np.argmax(fill[room])]
                    bins[i] = b
                    fill[a] -= sizes[i]
                    fill[b] += sizes[i]
                    step = True
            if step:
                continue
            theirs = np.nonzero((bins != a) & (fill[bins] < capacity))[0]
            if not len(theirs):
                break
            size_b, fill_b = sizes[theirs], fill[bins[theirs]]
            outs, given = _outs(sizes, mine)
            # a larger difference gains more, so of what may leave only the largest that fits is tried for each item
            k = np.searchsorted(outs, size_b + capacity - fill_b, side="right") - 1
            diff = np.where(k >= 0, outs[k] - size_b, 0)
            gain = np.where(diff > 0, (fill_b + diff) ** 2.0 - fill_b**2.0 + (fill[a] - diff) ** 2.0 - float(fill[a]) ** 2, 0.0)
            t = int(np.argmax(gain))
            if gain[t] <= 0:
                break
            g, j = given[k[t]], theirs[t]
            b = bins[j]
            moved = int(sizes[list(g)].sum())
            bins[list(g)], bins[j] = b, a
            fill[a] += sizes[j] - moved
            fill[b] += moved - sizes[j]
        if alive[a]:
            stuck.add(int(a))
    return bins


def _pack(prefix: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], ignore_index=True)
        sizes, capacity = pdf["tokens"].to_numpy(np.int64), int(pdf["capacity"].iloc[0])
        bins = local_search(sizes, best_fit_decreasing(sizes, capacity), capacity)
        fill = np.bincount(bins, sizes).astype(np.int64)
        name = prefix + str(pdf["grp"].iloc[0]) + "-"
        return pd.DataFrame(
            {"job_name": pdf["job_name"], "capacity": capacity, "container": [name + str(b) for b in bins], "doc_id": pdf["doc_id"], "piece": pdf["piece"], "tokens": sizes, "filled": fill[bins]}
        )

    return run


def pack(sizes: DataFrame, targets: DataFrame, group: int = GROUP) -> DataFrame:
    """A container for each document, or for each piece of one longer than the capacity.

    ``sizes``: doc_id and tokens; ``targets``: job_name and capacity_tokens,
    a short list written by hand.  A longer document is split into full pieces,
    each with a container of its own, and a rest that is packed like any other
    item; no other document is split.  Empty documents lie in a container like
    any other.  Targets without a positive capacity give no row.
    """
    jobs = [(r["job_name"], int(r["capacity_tokens"])) for r in targets.where("capacity_tokens > 0").distinct().collect()]  # written by hand
    columns = "job_name string, capacity bigint, container string, doc_id bigint, piece int, tokens bigint"
    if not jobs:
        return sizes.sparkSession.createDataFrame([], columns)
    sizes = materialize(sizes.where("doc_id is not null"))
    groups = max(1, -(-sizes.count() // group))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("job_name"), F.lit(c).cast("bigint").alias("capacity")) for n, c in sorted(jobs)])).alias("job")
    items = sizes.select("doc_id", "tokens", each).select("doc_id", "tokens", "job.*")
    full = items.where("tokens >= capacity").selectExpr(
        "job_name", "capacity", "doc_id", "explode(sequence(0, cast(tokens div capacity as int) - 1)) as piece", "capacity as tokens"
    )
    full = full.selectExpr("job_name", "capacity", "concat('full-', doc_id, '-', piece) as container", "doc_id", "piece", "tokens")
    rest = items.where("tokens % capacity > 0 or tokens = 0").selectExpr(
        "job_name", "capacity", "doc_id", "cast(tokens div capacity as int) as piece", "tokens % capacity as tokens", f"pmod(xxhash64(doc_id), {groups}) as grp"
    )
    packed = materialize(rest.groupBy("job_name", "grp").applyInPandas(_pack("a"), _BINS))
    good = packed.where(f"filled >= {UNDERFULL} * capacity")
    poor = packed.where(f"filled < {UNDERFULL} * capacity").drop("container", "filled", "grp")
    pools = {r["job_name"]: max(1, -(-r["count"] // group)) for r in poor.groupBy("job_name").count().collect()}  # a row per job
    pool = F.create_map(*[F.lit(x) for n, k in pools.items() for x in (n, k)])[F.col("job_name")] if pools else F.lit(1)
    poor = poor.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(1)), pool))
    again = poor.groupBy("job_name", "grp").applyInPandas(_pack("b"), _BINS)
    out = ["job_name", "capacity", "container", "doc_id", "piece", "tokens"]
    return full.select(*out).unionByName(good.select(*out)).unionByName(again.select(*out))


def waste(packed: DataFrame) -> DataFrame:
    """Containers, tokens, the least possible number of containers and the share of unused space per job."""
    total = packed.groupBy("job_name", "capacity").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return total.withColumn("least", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity")))
