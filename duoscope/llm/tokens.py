"""Words of many texts at once, as arrays of 64-bit hashes.

A batch is read as one run of bytes: a table gives each byte's class, word
borders come from its changes, and a running polynomial hashes every word, so
no text is walked through in Python.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

_NUMBER, _NAME, _START = 11, 13, 17
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
_BREAK = re.compile(r"[^\w\x00-\x7f]+")  # beyond ASCII: blanks, punctuation, marks

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_IS_CLOSER = np.zeros(256, bool)
_IS_CLOSER[[ord(c) for c in ".?!\n"]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_powers = np.array([1], np.uint64), np.array([1], np.uint64)


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Hash of a pair of hashes."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(29))) * _M1 + b * _M2
        return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers = tables[0], tables[1]
    return _powers


def _plain(text: str | None) -> str:
    """Typographic marks as their ASCII ones, other punctuation and blanks beyond ASCII as a blank, letters in lower case there."""
    if not text:
        return ""
    if text.isascii():
        return text.replace("\x00", " ") if "\x00" in text else text
    out = _BREAK.sub(" ", text.replace("\x00", " ").replace("’", "'").replace("…", ".").replace("।", "."))
    return out


class Words:
    """The words of a batch of texts: runs of letters and digits, joined by single apostrophes and hyphens.

    ``ids``: hash of each word, in lower case, numbers made alike; ``exact``:
    the same with numbers apart; ``doc``: which text it belongs to; ``first``:
    starts a sentence; ``closed``: a closing mark or line break follows;
    ``masked``: ``ids`` with capitalised words inside a sentence made one.
    ``starts`` and ``counts``: a text's first word and its number of words.
    """

    def __init__(self, texts: Sequence[str | None]):
        raw = ("\x00".join(map(_plain, texts)) + "\x00").encode("utf-8", "replace")
        b = np.frombuffer(raw, np.uint8)
        is_word = _IS_WORD[b]
        joins = (b == 39) | (b == 45)
        joins[1:-1] &= is_word[:-2] & is_word[2:]
        joins[0] = joins[-1] = False
        is_word |= joins
        edge = np.diff(is_word.astype(np.int8), prepend=np.int8(0))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the closing zero byte ends the last word
        power, inverse = _power_table(len(b))
        with np.errstate(over="ignore"):
            low = _LOWER[b]
            # two-byte capitals of Latin-1, Greek and Cyrillic differ from small ones in the second byte only where this says so
            latin = np.zeros(len(b), bool)
            latin[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)
            low = low + latin.astype(np.uint64) * np.uint64(32)
            running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((low + np.uint64(1)) * power[: len(b)])))
            exact = mix((running[e] - running[s]) * inverse[s], (e - s).astype(np.uint64))
        self.n = len(texts)
        zero = np.flatnonzero(b == 0)
        self.doc = np.searchsorted(zero, s)
        end = zero[self.doc] if len(s) else s
        closers = np.concatenate((np.zeros(1, np.int32), np.cumsum(_IS_CLOSER[b], dtype=np.int32)))
        limit = np.minimum(np.append(s[1:], len(b))[: len(s)], end)
        self.closed = closers[limit] > closers[e]
        self.last = ~self.closed & (limit == end)
        self.first = np.ones(len(s), bool)
        if len(s) > 1:
            self.first[1:] = (self.doc[1:] != self.doc[:-1]) | self.closed[:-1]
        head = b[s]
        digit = (head >= 48) & (head <= 57)
        upper = (head >= 65) & (head <= 90)
        if len(s):
            upper |= latin[np.minimum(s + 1, len(b) - 1)]
        self.capital = upper & (e - s > 1)
        self.letter = _LOWER[head]  # the first byte in lower case
        self.digit = digit
        self.at_end = e == end  # nothing at all stands behind the word
        self.length = e - s  # in bytes
        inside = np.concatenate((np.zeros(1, np.int32), np.cumsum(joins, dtype=np.int32)))
        self.joined = inside[e] > inside[s]
        self.exact = exact
        self.ids = np.where(digit, np.uint64(_NUMBER), exact)
        self.masked = np.where(self.capital & ~self.first, np.uint64(_NAME), self.ids)
        self.starts = np.searchsorted(self.doc, np.arange(self.n))
        self.counts = np.bincount(self.doc, minlength=self.n)
        self._raw, self._s, self._e = raw, s, e

    def word(self, i: int) -> str:
        """The word at a position, in lower case."""
        return self._raw[self._s[i] : self._e[i]].decode("utf-8", "replace").lower()

    def contexts(self) -> dict[str, np.ndarray]:
        """Hashes of what stands around each word in its sentence, names and numbers made alike.

        c1 to c4: the word with none to three words before it; s1 and s2: the
        three words before the last one, or before the last two, which tells
        the place of a word in its sentence whatever the word itself is.
        """
        m = self.masked
        begin = np.uint64(_START)
        back = [m]
        stop = self.first.copy()  # a sentence starts at or after the word looked back from
        for k in range(1, 5):
            w = np.concatenate((np.full(min(k, len(m)), begin, np.uint64), m[:-k] if k < len(m) else m[:0]))
            back.append(np.where(stop, begin, w))
            stop = stop | np.concatenate((np.ones(min(k, len(m)), bool), self.first[:-k] if k < len(m) else self.first[:0]))
        out = {"c1": mix(m, np.uint64(1))}
        out["c2"] = mix(m, back[1])
        out["c3"] = mix(out["c2"], back[2])
        out["c4"] = mix(out["c3"], back[3])
        out["s1"] = mix(mix(mix(back[1], back[2]), back[3]), np.uint64(101))
        out["s2"] = mix(mix(mix(back[2], back[3]), back[4]), np.uint64(102))
        return out

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the run of ``size`` words that starts at each word, numbers apart, and whether it stays in its text."""
        n = len(self.exact) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = self.exact[:n]
        for k in range(1, size):
            h = mix(h, self.exact[k : k + n])
        return h, self.doc[:n] == self.doc[size - 1 :]


def bounded(batches, columns, most: int = 2_000_000):
    """Batches cut so that the texts of each, taken together, have at most ``most`` characters; a longer text stands alone."""
    for pdf in batches:
        size = sum(pdf[c].str.len().fillna(0) for c in columns).to_numpy(np.int64) if len(pdf) else np.zeros(0, np.int64)
        if size.sum() <= most:
            yield pdf
            continue
        at, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if held and held + n > most:
                yield pdf.iloc[at:i]
                at, held = i, 0
            held += n
        yield pdf.iloc[at:]


class Bloom:
    """A bit set of hashes whose size has a bound: beyond it more hashes pass that aren't in it, none is lost."""

    MOST_BITS = 1 << 27

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    @staticmethod
    def places(keys: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
        a = mix(keys, np.uint64(7))
        return [a & mask, (a >> np.uint64(32)) & mask, mix(keys, np.uint64(9)) & mask]

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self.places(keys, self.mask):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    @classmethod
    def of(cls, keys, column: str) -> "Bloom":
        """The filter of a DataFrame's long column; what reaches the driver is at most ``MOST_BITS`` bits."""
        import pandas as pd
        from pyspark.sql import functions as F

        n = keys.count()
        bits = min(cls.MOST_BITS, 1 << max(16, (16 * n).bit_length()))
        mask = np.uint64(bits - 1)

        def fill(batches):
            words = np.zeros(bits // 64, np.uint64)
            for pdf in batches:
                k = pdf[column].to_numpy().view(np.uint64)
                for p in cls.places(k, mask):
                    np.bitwise_or.at(words, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
            at = np.flatnonzero(words)
            yield pd.DataFrame({"slot": at, "bits": words[at].view(np.int64)})

        slots = keys.select(column).mapInPandas(fill, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
        words = np.zeros(bits // 64, np.uint64)
        words[slots["slot"].to_numpy(np.int64)] = slots["bits"].to_numpy(np.int64).view(np.uint64)
        return cls(words)


#: Share of all word occurrences from which a word is listed; at most 1 / SHARE words can reach it, whatever the size.
SHARE = 2e-6


def count_words(batches):
    """Words of all columns with how often they stand, and how often in columns named like prompts; what stands last in another column may be broken and doesn't count."""
    import pandas as pd

    names = ["word", "n", "n_prompt"]
    held: dict[int, list] = {}
    for pdf in (part for batch in batches for part in bounded([batch], list(batch.columns))):
        for c in pdf.columns:
            w = Words([t if isinstance(t, str) else None for t in pdf[c]])
            inner = np.flatnonzero(~w.digit & (~w.at_end | c.endswith("prompt")))
            ids, at, n = np.unique(w.exact[inner], return_index=True, return_counts=True)
            for k, i, x in zip(ids.tolist(), inner[at].tolist(), n.tolist()):
                seen = held.get(k)
                if seen is None:
                    seen = held[k] = [w.word(i), 0, 0]
                seen[1] += x
                seen[2] += x if c.endswith("prompt") else 0
        if len(held) > 500_000:
            yield pd.DataFrame(held.values(), columns=names)
            held = {}
    if held:
        yield pd.DataFrame(held.values(), columns=names)


def frequent_words(texts, share: float = SHARE) -> dict[str, int]:
    """Words of all columns that have at least ``share`` of all occurrences, so at most 1 / share of them, and stand at least twice."""
    from pyspark.sql import functions as F

    from duoscope.runtime import materialize

    counts = materialize(texts.mapInPandas(count_words, "word string, n bigint, n_prompt bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r["word"]: r["n"] for r in counts.where(F.col("n") >= max(2, int(share * total))).orderBy("word").collect()}
