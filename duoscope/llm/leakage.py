"""Evaluation items inside training documents (problem 7).

Pigeonhole edit matching.  A leaked passage is ``PASSAGE`` consecutive words
of an item.  With an error budget of one word a passage falls into two pieces
of which one is untouched and at least ``PASSAGE // (budget + 1)`` words long,
wherever it starts in the item.  So the pieces of that length at every word of
an item are indexed and a document is searched for exact piece hits only, which
misses no passage within the budget.  Each hit is verified: Myers'
bit-parallel algorithm, over words as symbols, gives the smallest edit
distance between the item's passage around the piece and the document there,
and the run of equal words through the piece is measured.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a passage and word edits allowed in it.
PASSAGE, BUDGET = 10, 1
#: Items up to which the piece automaton is sent to every task (about 35 KB an item of 42 words); more are joined by piece.
MAX_AUTOMATON_ITEMS = 10_000
#: Parts that each piece of the documents is dealt to in that join, so that a frequent piece isn't one task's.
SALTS = 16

_NOT_WORD = re.compile(r"[^a-z0-9]+")
_OUT = "doc_id bigint, item_id bigint, run bigint, distance bigint, doc_from bigint, item_from bigint, passage int"


def words(text: str | None) -> list[str]:
    """Runs of a-z and digits after lower-casing."""
    return _NOT_WORD.sub(" ", text.lower()).split() if text else []


def myers(pattern: list[str], text: list[str]) -> int:
    """Smallest edit distance between ``pattern`` and any stretch of ``text``, words as symbols."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    ones, high = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = ones, 0, m
    best = m
    for w in text:
        eq = peq.get(w, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp) & ones, d0 & vp
        score += bool(hp & high) - bool(hn & high)
        hp, hn = hp << 1, hn << 1  # a match may start anywhere, so nothing is carried in
        vp, vn = (hn | ~(d0 | hp)) & ones, hp & d0 & ones
        best = min(best, score)
    return best


def pieces(item: list[str], size: int) -> list[tuple[int, str]]:
    """Pieces of an item at every word: (first word, piece)."""
    return [(i, " ".join(item[i : i + size])) for i in range(len(item) - size + 1)]


def _verified(doc: list[str], item: list[str], at: int, i: int, size: int, passage: int, budget: int) -> tuple[int, int, int, int]:
    """(run, distance, first word of the run in the document, in the item) for the hit of the piece item[i:i+size] at doc[at:]."""
    a, b = i, i + size
    while a > 0 and at - (i - a) > 0 and item[a - 1] == doc[at - (i - a) - 1]:
        a -= 1
    while b < len(item) and at + (b - i) < len(doc) and item[b] == doc[at + (b - i)]:
        b += 1
    run = b - a
    lo, hi = at - (passage - size) - budget, at + passage + budget
    around = doc[max(0, lo) : hi]
    best = passage
    for s in range(max(0, i + size - passage), min(i, max(0, len(item) - passage)) + 1):
        best = min(best, myers(item[s : s + passage], around))
        if not best:
            break
    return run, best, at - (i - a), a


class PieceIndex:
    """Aho-Corasick automaton over the pieces of all items, with the items' words."""

    def __init__(self, items: list[tuple[int, list[str]]], passage: int, budget: int):
        self.passage, self.budget, self.size = passage, budget, passage // (budget + 1)
        groups: dict[tuple[str, ...], list[int]] = defaultdict(list)  # equal questions are verified once
        for item_id, w in items:
            groups[tuple(w)].append(item_id)
        self.texts = [list(w) for w in groups]
        self.ids = list(groups.values())
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, w in enumerate(self.texts):
            for i, piece in pieces(w, self.size):
                where[piece].append((k, i))
        self.automaton = ahocorasick.Automaton()
        for piece, hits in where.items():
            self.automaton.add_word(f" {piece} ", (len(piece), hits))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def leaks(self, text: str | None) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(item id, run, distance, word in the document, word in the item, passage), best hit of each item."""
        if self.empty or not text:
            return
        doc = words(text)
        if len(doc) < self.size:
            return
        joined = f" {' '.join(doc)} "
        best: dict[int, tuple[int, int, int, int]] = {}
        done: dict[int, dict[int, int]] = defaultdict(dict)
        last, at = 0, 0
        for end, (length, hits) in self.automaton.iter(joined):
            start = end - length
            at += joined.count(" ", last, start) if start >= last else -joined.count(" ", start, last)
            last = start
            first = at - 1
            for k, i in hits:
                if i < done[k].get(first - i, 0):  # in a long run that is already measured
                    continue
                got = _verified(doc, self.texts[k], first, i, self.size, self.passage, self.budget)
                if got[0] >= self.passage:
                    done[k][first - i] = got[3] + got[0]
                if k not in best or (-got[1], got[0]) > (-best[k][1], best[k][0]):
                    best[k] = got
        for k, got in best.items():
            if got[1] <= self.budget:
                for item_id in self.ids[k]:
                    yield item_id, *got, min(self.passage, len(self.texts[k]))


def find_leaks(documents: DataFrame, items: DataFrame, passage: int = PASSAGE, budget: int = BUDGET, max_automaton_items: int = MAX_AUTOMATON_ITEMS) -> DataFrame:
    """Pairs of documents (doc_id, text) and items (item_id, question) that share a passage.

    Columns: doc_id, item_id, run (stretch of equal words through the best
    piece), distance (Myers' word edits of the item's nearest passage,
    at most the budget; 0 if it stands there word for word), ``passage`` (the words
    of that passage, fewer than asked for only in shorter items) and where the run starts in either text.  One row per document and
    item, whatever the number of hits; equal questions under several ids give
    one row each, and so do documents that repeat.  Null or empty texts and
    items shorter than a piece match nothing.  The items are a fixed test set:
    up to ``max_automaton_items`` they are sent to the tasks, beyond that both
    sides are joined by piece; the rows are the same.
    """
    small = items.select("item_id", "question").limit(max_automaton_items + 1).collect()
    if len(small) > max_automaton_items:
        return _joined(documents, items, passage, budget)
    listed = [(r["item_id"], words(r["question"])) for r in small]
    shared = documents.sparkSession.sparkContext.broadcast(listed)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = PieceIndex(shared.value, passage, budget)
        for pdf in batches:
            rows = [(d, *leak) for d, t in zip(pdf["doc_id"], pdf["text"]) for leak in index.leaks(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run", "distance", "doc_from", "item_from", "passage"])

    return documents.select("doc_id", "text").where(F.length("text") > 0).mapInPandas(search, _OUT)


def _joined(documents: DataFrame, items: DataFrame, passage: int, budget: int) -> DataFrame:
    """The same by an equi-join on pieces: for item sets too large to send to each task."""
    size = passage // (budget + 1)
    split = F.expr("split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ')), ' ')")
    docs = documents.select("doc_id", "text").where(F.length("text") > 0).withColumn("w", split)
    last = f"greatest(size(w) - {size}, -1)"
    doc_pieces = docs.where(f"size(w) >= {size}").selectExpr(
        "doc_id", f"explode(array_distinct(transform(sequence(0, {last}), i -> xxhash64(array_join(slice(w, i + 1, {size}), ' '))))) as piece"
    )
    its = items.selectExpr("item_id", "question", "split(trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ')), ' ') as w")
    item_pieces = its.where(f"size(w) >= {size}").selectExpr(
        "item_id", f"explode(array_distinct(transform(sequence(0, {last}), i -> xxhash64(array_join(slice(w, i + 1, {size}), ' '))))) as piece"
    )
    salted = item_pieces.selectExpr("item_id", "piece", f"explode(sequence(0, {SALTS - 1})) as salt")
    pairs = doc_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["piece", "salt"]).select("doc_id", "item_id").distinct()
    texts = pairs.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", "question"), "item_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t, i, q in zip(pdf["doc_id"], pdf["text"], pdf["item_id"], pdf["question"]):
                rows += [(d, *leak) for leak in PieceIndex([(i, words(q))], passage, budget).leaks(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run", "distance", "doc_from", "item_from", "passage"])

    return texts.select("doc_id", "text", "item_id", "question").mapInPandas(verify, _OUT)
