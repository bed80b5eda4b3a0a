"""Abusive, hateful and sexually explicit language (problem 1).

Words are read through their disguises: look-alike letters, digits and signs
for letters, zero-width and other separators, stretched letters, masked
letters.  What comes out is a sequence of letter sets, and a Levenshtein
automaton over that sequence is intersected with a trie of the lexicon, so that
misspelled terms are found as well.  A window around each hit then tells abuse
from mention: who is addressed, which group is meant, and whether the sentence
reports, defines, or speaks of medicine, animals, sport or machines.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.llm.tokens import frequent_words

#: Labelled values read for calibration; a bound on the sample, not on what is scored.
MAX_LABELS = 20_000
#: Score from which a value is flagged when there are no labels to calibrate with.
THRESHOLD = 0.5
#: Normal forms of tokens kept by a worker.
MEMO = 200_000

# The lexicon, general English words by class; a word that stands with "+" is taken with its endings.
INSULTS = """
arsehole arsewipe asshole asshat bastard bellend bitch bollocks clot cretin cunt dickhead dimwit dipshit douchebag dullard dumbass dumbfuck dunce
fuckface fuckwit gobshite halfwit idiot imbecile jackass knobhead lowlife moron motherfucker muppet nitwit numbskull pillock plonker prick
retard scumbag shithead simpleton slut swine tosser twat wanker whore wretch
"""
#: An adjective of contempt within two words before a noun of contempt is an insult.
SCORN = "brainless dirty filthy miserable pathetic spineless stupid ugly useless worthless lying fat lazy rotten disgusting vile stinking"
SCORNED = "clown slob pig worm loser rat cow freak waste trash shit garbage coward liar fool dog leech toad snake hag failure nobody"
PROFANITY = "fuck fucking fucked shit shitty bullshit goddamn goddamned crappy bloody damned bugger"
DEHUMANISING = "animals apes beasts cockroaches filth maggots parasites rats savages scum subhuman subhumans vermin disease plague lice locusts cancer pests swarm mongrels monkeys"
SEXUAL = "blowjob boobs cock cum dildo erection erotic fetish hardcore horny masturbate nude nudes orgasm orgasms porn porno pornographic pussy striptease threesome topless xxx"
SEXUAL_HINT = "adult adults bed breast breasts camera clothes dress wearing legs thighs lips naked selfies selfie sex sexual sexy wet undress undressed undressing strangers begging moaning moaned tape pictures photos tits touched touching kissed kissing skin body inch spread hot lust tongue lap shower panties underwear bra strip stripped webcam"
HARM = "kill+ murder+ strangle+ stab+ shoot shot hang+ burn+ drown+ choke+ beat beating smash+ break breaking broken crush+ cut cutting slit poison+ bury buried hurt gut+ knock+ punch+ kick+ whip+ rape+ lynch+ gas gassed slaughter+ butcher+ die dies rot+ suffer+ bleed+ perish+ jump+ rope bullet crash+ dead death grave ditch hell"
BODY = "neck throat jaw skull head face teeth legs arms bones nose eyes knees fingers ribs spine mouth guts back"
WISH = "hope wish pray deserve deserves"
EXPEL = "driven wiped shot hanged hung gassed burned burnt expelled deported thrown removed sterilised sterilized cleansed eradicated exterminated purged rounded locked caged drowned whipped starved banished killed beaten banned mercy cure+ rope spit+ exterminate eradicate deport purge"
STEREOTYPE = "breed breeding steal+ stole stolen thieves thief liars criminals infect+ invade+ pollute+ contaminate+ swarm+ brains blood bred dirty filthy stupid lazy backward inferior diseased rapists murderers primitive uncivilised stink stinks children daughters"
PEOPLE = "foreigners immigrants migrants newcomers outsiders refugees strangers natives dwellers folk peasants tribes people families villagers settlers gypsies kind lot ilk race nomads travellers farmhands islanders southerners northerners minorities believers"
DISMISSED = "lost mouth face trap off shove+ shut gob"
UNLOVED = "miss misses missed want wants wanted like likes love loves loved care cares laugh+ better without allowed mother father born"
NOBODY = "nobody noone everyone everybody anyone world they"
DIRECT = "you your yourself yours yourselves ur youse ye y'all ya"
THEY = "they them their theirs those these"
REPORTED = """
moderator moderators removed post posts comment dictionary entry words spelled means meaning quoted quotation quote article headline report reported reports report's
novel film lyrics court judge witness inspector police historian historians archive lesson class discussed explains explained history banned filter
doctor clinic hospital patient patients vet farm farmer team match score process program server engine
called someone|called somebody|was called|the word|a word|said the|according to
"""
#: Words either side of a hit that reporting or technical words are looked for in.
WINDOW = 8
# Ordinary words within one edit of a lexicon word; words that the corpus has more often than the term count as well.
ORDINARY = "books boots harem idiom idioms mustard custard bustard buzzard clowns brick bricks pricks trick tricks price crick shore chore whole shot short shift shirt slots slits slot clocks clock clots plot moran maroon boron twine spine swing swim swede count aunt hunt punt stunt bitten batch ditch pitch witch hitch birch butch stitch cocks tosses tossed closer loser lose loses freak bread tread dread creek words warm worn form filter party thirty fully studio row record reward regard retired buried dull duller floody flood broody ruddy muddy body crabby happy puppy poppy pork port born corn torn horn horns honey horse nacre rude nudge node dude crown brown crow flown town blown slab slow rates mats cats bats raft line life live nice dice mice rice tapes shapes grapes scrum slum feasts beats boasts permit annals salvage salvages league erection election elections exotic aerobic sauce faucet savage ranges organs orgasmic topics tropics muppets puppet puppets pellock hillock pollock planter blinker banker tanker ranker thinker anchor whose horses cleft clout twit tweet sweat swan seine wench wrench hooded damned darned bugle burger budget shitake sheet".split()

_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
# Letters that look like Latin ones.
_LOOKS = str.maketrans(dict(
    pair.split("=")
    for pair in "а=a б=b в=b г=r д=d е=e з=z и=u ј=j к=k л=l м=m н=h о=o р=p с=c т=t у=y х=x і=i ї=i ѕ=s ћ=h ԁ=d ԛ=q ԝ=w һ=h ɡ=g ɑ=a ɩ=l ɪ=i ı=i ɴ=n ʀ=r ʏ=y α=a β=b ε=e η=n ι=i κ=k ν=n ο=o ρ=p τ=t υ=u χ=x ω=w γ=y µ=u".split()
))
# Signs and digits written for letters.
_SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
_ANY = ""
_SPACED = re.compile(r"(?<![^\s\"'(])[a-z0-9$@*](?P<by>[ ._\-])(?:[a-z0-9$@*](?P=by))+[a-z0-9$@*](?![a-z0-9$@])")
_SENTENCE = re.compile(r"(?<=[.?!…])[\"'”)]*\s+|\n+")
_STRETCH = re.compile(r"([^*])\1{2,}")
_EDGE = " \t\"'“”‘’()[]{}<>.,;:?…—–#&/\\"


_JOINT = re.compile(r"[—–/…]+|\.{2,}|-{2,}")
# Spellings of the second person.
_YOU = {"ye": "you", "youse": "you", "ya": "you", "u": "you", "yer": "your", "ur": "your"}


def _terms(text: str) -> list[tuple[str, ...]]:
    out = []
    for line in text.strip().splitlines():
        out += [tuple(t.split()) for t in line.split("|")] if "|" in line else [(t,) for t in line.split()]
    return out


def _forms(text: str) -> frozenset[str]:
    """Words of a class, those with "+" in all their endings."""
    out = set()
    for w in text.split():
        base = w.rstrip("+")
        out.add(base)
        if w.endswith("+"):
            stem = base[:-1] if base.endswith("e") else base
            out |= {base + "s", base + "es", stem + "ed", stem + "ing", base + "d", base + base[-1] + "ed", base + base[-1] + "ing"}
    return frozenset(out)


class Trie:
    """A lexicon as nested dicts; ``"$"`` ends a word."""

    def __init__(self, words: Iterator[str] | list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node["$"] = w

    def match(self, letters: list[str], budget: int) -> list[tuple[str, int]]:
        """Words within ``budget`` edits of a sequence of letter sets (an empty set is any letter).

        The state of the automaton is a row of distances; a branch of the trie
        is left as soon as every entry of its row is beyond the budget.
        """
        n, out = len(letters), []
        stack = [(self.root, list(range(n + 1)), "")]
        while stack:
            node, row, last = stack.pop()
            word = node.get("$")
            if word is not None and row[n] <= budget:
                out.append((word, row[n]))
            for c, child in node.items():
                if c == "$":
                    continue
                new = [row[0] + 1]
                for i in range(n):
                    same = not letters[i] or c in letters[i]
                    new.append(min(row[i] + (not same), row[i + 1] + 1, new[i] + 1))
                if min(new) <= budget:
                    stack.append((child, new, c))
        return sorted(out, key=lambda x: (x[1], x[0]))


def fold(text: str) -> str:
    """Lower case without invisible characters and accents, look-alike letters made Latin."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().translate(_LOOKS)
    return text.lower()


def letter_sets(token: str) -> list[str]:
    """What each character of a token may stand for."""
    token = _STRETCH.sub(r"\1", token)
    out = []
    for c in token:
        if c == "*":
            out.append(_ANY)
        elif c in _SIGNS:
            out.append(_SIGNS[c])
        elif c.isalpha():
            out.append(c)
    return out


class Lexicon:
    """Terms by class, their words in a trie, and the token memo; ``counts`` are the corpus's words."""

    CLASSES = {"harm": HARM, "body": BODY, "wish": WISH, "expel": EXPEL, "stereotype": STEREOTYPE, "people": PEOPLE, "hint": SEXUAL_HINT, "scorn": SCORN, "scorned": SCORNED, "dismissed": DISMISSED, "unloved": UNLOVED, "nobody": NOBODY, "they": THEY, "direct": DIRECT}

    def __init__(self, flag_terms: list[tuple[str, str, int]], counts: dict[str, int] | None = None, budget: int = 2):
        self.counts, self.budget = counts or {}, budget
        self.terms: dict[tuple[str, ...], str] = {}
        for kind, text in (("dehumanising", DEHUMANISING), ("sexual", SEXUAL), ("profanity", PROFANITY), ("insult", INSULTS)):
            for t in _terms(text):
                self.terms[t] = kind
        self.of = {k: _forms(v) for k, v in self.CLASSES.items()}
        # the reviewers' list adds to ours; words it rates low are often harmless and count as hints only
        for term, category, severity in flag_terms:
            t = tuple(fold(term or "").split())
            if t and t not in self.terms and (severity or 0) >= 3:
                if t[0] in ("a", "an") and t[1:] in self.terms or len(t) == 1 and any(t[0] in c for c in self.of.values()):
                    continue
                self.terms[t] = {"abuse": "insult", "hate": "dehumanising", "sexual": "sexual", "profanity": "profanity"}.get(category or "", "insult")
        self.words = {w for t in self.terms for w in t if len(w) > 1}
        # words of the classes that carry a threat or a slur are looked for in disguise as well
        self.hidden = {w for k in ("harm", "body", "scorn", "scorned", "hint", "expel", "stereotype") for w in self.of[k] if len(w) >= 4}
        self.trie = Trie(sorted(self.words | self.hidden | {"".join(t) for t in self.terms if len(t) > 1}))
        self.joined = {"".join(t): t for t in self.terms if len(t) > 1}
        self.longest = max(map(len, self.terms))
        self.longest_word = max(map(len, self.words | self.hidden | set(self.joined)))
        self.ordinary = set(ORDINARY)
        self.reported = set(_terms(REPORTED))
        self.reported_one = {t[0] for t in self.reported if len(t) == 1}
        self.reported_two = {t for t in self.reported if len(t) == 2}
        self.clue = frozenset().union(*self.of.values()) - self.of["direct"]
        self.read = lru_cache(MEMO)(self._read)

    def _read(self, raw: str) -> tuple[tuple[str, ...], int]:
        """The words a raw token stands for, and 2 if it is a term, by itself or in disguise, 1 if that is so only where somebody is addressed."""
        t = fold(raw).strip(_EDGE)
        if not t:
            return (), 0
        plain = t.replace("’", "'")
        if plain in _YOU:
            return (_YOU[plain],), 0
        if plain in self.words:
            return (plain,), 2
        if plain in self.clue or not any(c.isalpha() for c in t):
            return (plain,), 0
        bare = t.rstrip("!")
        masked = "*" in bare
        signs = any(c in _SIGNS for c in bare) and not bare.isdigit()
        joined = _SPACED.fullmatch(t) is not None or bool(re.fullmatch(r"(?:[a-z0-9$@*][._\-])+[a-z0-9$@*]", t))
        if not masked and not signs and not joined and plain.isalpha():
            squeezed = _STRETCH.sub(r"\1", plain)
            if squeezed != plain and (squeezed in self.words or squeezed in self.clue):
                return (squeezed,), 2 if squeezed in self.words else 0
            if plain in self.ordinary or len(squeezed) < 4 or not self.budget:
                return (plain,), 0
            hit = self._misspelt(plain, squeezed)
            return ((hit,), (2 if len(hit) >= 5 else 1) if hit in self.words else 0) if hit else ((plain,), 0)
        sets = letter_sets(bare if not joined else re.sub(r"[ ._\-]", "", bare))
        if len(sets) < 3 or len(sets) > self.longest_word + 1 or masked and (sum(1 for s in sets if s) < 2 or len(sets) < 4):
            return (plain,), 0
        hit = self._nearest(sets, 0, joined) or (self._nearest(sets, 1, joined) if self.budget and not masked and len(sets) >= 6 else None)
        if hit is None:
            return (plain,), 0
        got = self.joined[hit] if hit in self.joined and hit not in self.words else (hit,)
        return got, 2 if hit in self.words or hit in self.joined else 0

    def _nearest(self, letters: list[str], budget: int, joined: bool) -> str | None:
        for word, _ in self.trie.match(letters, budget):
            if (joined or word in self.words or word in self.hidden) and (budget == 0 or len(word) >= 5):
                return word
        return None

    def _misspelt(self, plain: str, squeezed: str) -> str | None:
        """The term that a word misspells: one edit, two from nine letters on, a changed first letter from six on; not if the corpus has the word itself as often."""
        if len(squeezed) > self.longest_word + self.budget:
            return None
        allowed = min(self.budget, 1 if len(squeezed) < 9 else 2)
        for word, d in self.trie.match([*squeezed], allowed):
            strong = self.terms.get((word,)) in ("insult", "dehumanising", "profanity", "sexual")
            if not strong or len(word) < 4 or len(word) < 6 and word[0] != squeezed[0]:
                continue
            if plain.rstrip("s") == word.rstrip("s") or self.counts.get(plain, 0) < max(2, self.counts.get(word, 0)) and len(word) >= 5 or len(word) == 4 and plain not in self.counts:
                return word
        return None

    def sentence(self, text: str) -> tuple[list[str], list[int]]:
        """Normalised words of a sentence and how sure it is that each is a lexicon word."""
        if _SPACED.search(low := fold(text)):
            text = _SPACED.sub(lambda m: re.sub(r"[ ._\-]", "-", m.group()), low)
        words: list[str] = []
        marks: list[int] = []
        for raw in _JOINT.sub(" ", text).split():
            got, mark = self.read(raw)
            words += got
            marks += [mark] * len(got)
        return words, marks


#: Names of a window's features; the weights start from these values and are refitted on labels.
PRIOR = {
    "bias": -3.0, "insult": 4.6, "insult_direct": 5.2, "scorned": 4.6, "profanity": 1.5, "profanity_direct": 3.5, "dehumanising_of": 5.0, "sexual": 3.6, "sexual_hint": 1.0, "sexual_many": 2.4, "harm_you": 3.2, "harm_body": 4.4, "wish_harm": 4.4,
    "expel_group": 4.2, "expel": 2.0, "stereotype_group": 3.8, "stereotype_direct": 3.2, "dismissal": 3.2, "unloved": 3.6, "group": 0.2, "direct": 0.3, "disguised": 1.6, "reported": -4.5, "learned": 1.6,
}
_ORDER = list(PRIOR)
_HITS = frozenset(PRIOR) - {"bias", "group", "direct", "disguised", "reported", "sexual_hint"}
#: What category the features stand for.
_CATEGORY = {
    "insult": "insult", "insult_direct": "insult", "scorned": "insult", "profanity": "profanity", "profanity_direct": "profanity", "dehumanising_of": "hate", "sexual": "sexual", "sexual_many": "sexual", "harm_you": "threat", "harm_body": "threat", "wish_harm": "threat",
    "expel_group": "hate", "expel": "hate", "stereotype_group": "hate", "stereotype_direct": "insult", "dismissal": "dismissal", "unloved": "insult", "learned": "learned",
}


class Scorer:
    """Scores values; holds the lexicon, the weights and the words learned from labels."""

    def __init__(self, flag_terms: list[tuple[str, str, int]], weights: dict[str, float] | None = None, learned: dict[str, float] | None = None, threshold: float = THRESHOLD, counts: dict[str, int] | None = None, budget: int = 2):
        self.lexicon, self.weights = Lexicon(flag_terms, counts, budget), {**PRIOR, **(weights or {})}
        self.learned, self.threshold = learned or {}, threshold
        self.leads = lru_cache(MEMO)(self._leads)

    def _leads(self, raw: str) -> int:
        """2 if a token is reason to look at its sentence: a term, a spaced letter; 1 for a word of a class or a learned one, of which it takes two."""
        if any(_JOINT.finditer(raw)):
            return max(map(self._leads, [x for x in _JOINT.sub(" ", raw).split()] or [""]))
        got, mark = self.lexicon.read(raw)
        if mark or len(got) > 1:
            return 2
        core = fold(raw).strip(_EDGE + "_")
        if len(core) == 1 and core.isalpha() and core not in "ai":
            return 2
        return int(any(w in self.lexicon.clue or w in self.learned for w in got))

    def features(self, sentence: str) -> tuple[dict[str, float], str | None, str | None]:
        """Features of a sentence with its leading category and term; empty if nothing in it is a hit."""
        lex = self.lexicon
        words, marks = lex.sentence(sentence)
        of = lex.of
        has = {k: [i for i, w in enumerate(words) if w in v] for k, v in of.items()}
        out: dict[str, float] = {}
        hits: list[tuple[int, str]] = []

        def near(i: int, kind: str, before: int, after: int) -> bool:
            return any(i - before <= j <= i + after and j != i for j in has[kind])

        def hit(name: str, i: int) -> None:
            out[name] = 1.0
            hits.append((i, name))

        covered = -1
        for i, mark in enumerate(marks):
            if not mark or i <= covered or mark == 1 and not near(i, "direct", 3, 3):
                continue
            for n in range(min(lex.longest, len(words) - i), 0, -1):
                kind = lex.terms.get(tuple(words[i : i + n]))
                if kind is None:
                    continue
                covered = i + n - 1
                if kind == "insult":
                    hit("insult_direct" if near(i, "direct", 6, n + 3) else "insult", i)
                elif kind == "profanity":
                    direct = near(i, "direct", 3, n + 2)
                    if direct or words[i] != "bloody":
                        hit("profanity_direct" if direct else "profanity", i)
                elif kind == "dehumanising":
                    before = words[max(0, i - 4) : i]
                    if {"like", "born", "are", "is", "be", "were", "ain't"} & set(before[-3:]) and (has["people"] or has["they"]) or near(i, "they", 4, 0) or near(i, "people", 2, 0) or near(i, "expel", 0, 4):
                        hit("dehumanising_of", i)
                elif kind == "sexual":
                    hit("sexual", i)
                break
        for i in has["scorned"]:
            if near(i, "scorn", 3, 0):
                hit("scorned", i)
        group = bool(has["people"]) and (bool(has["they"]) or any(w in ("all", "every", "who", "from", "whole") for w in words)) or len(has["people"]) > 0 and len(has["they"]) > 0
        for i in has["harm"]:
            if near(i, "direct", 2, 3):
                hit("harm_you", i)
            if any(i < j <= i + 5 for j in has["body"]) and any(i < j <= i + 4 for j in has["direct"]):
                hit("harm_body", i)
            if any(j < i <= j + 8 for j in has["wish"]) and has["direct"] and min(has["direct"]) < len(words):
                hit("wish_harm", i)
        if has["people"] or has["they"]:
            for i in has["expel"]:
                before = words[max(0, i - 4) : i]
                if {"be", "should", "must", "ought", "deserve", "get", "need", "needs", "no", "the", "only", "them", "on"} & set(before):
                    hit("expel_group", i)
            for i in has["stereotype"]:
                if near(i, "they", 5, 3) or near(i, "people", 8, 3):
                    hit("stereotype_group", i)
        else:
            for i in has["expel"]:
                if {"be", "were", "get"} & set(words[max(0, i - 2) : i]):
                    hit("expel", i)
        for i in has["stereotype"]:
            if near(i, "direct", 7, 2):
                hit("stereotype_direct", i)
        for i in has["dismissed"]:
            if i and words[i - 1] in ("get", "your", "piss", "sod", "bugger", "clear", "and") and (i <= 3 or near(i, "direct", 3, 2)) or i + 1 < len(words) and words[i] in ("shut", "shove") and words[i + 1] in ("up", "it", "your"):
                hit("dismissal", i)
        for i in has["unloved"]:
            if any(i - 4 <= j < i for j in has["nobody"]) and any(i < j <= i + 3 for j in has["direct"]) and "would" not in words[:1]:
                hit("unloved", i)
        if has["hint"]:
            n = len({words[i] for i in has["hint"]})
            out["sexual_hint"] = min(3.0, float(n - 1))
            if n >= 2 and (near(has["hint"][0], "hint", 0, 8) or "sexual" in out):
                hit("sexual_many", has["hint"][0])
        known = [w for w in _grams(words) if w in self.learned] if self.learned else []
        strength = sum(self.learned[w] for w in set(known))
        if strength >= 2.0 or strength >= 1.0 and hits:
            out["learned"] = min(4.0, strength)
            hits.append((next(i for i, w in enumerate(words) if w in known[0].split()), "learned"))
        if not _HITS & set(out):
            return {}, None, None
        if group:
            out["group"] = 1.0
        if has["direct"]:
            out["direct"] = 1.0
        at = {i for i, w in enumerate(words) if w in lex.reported_one} | {i for i in range(len(words) - 1) if (words[i], words[i + 1]) in lex.reported_two}
        best = max(hits, key=lambda x: self.weights[x[1]])
        if any(abs(i - best[0]) <= WINDOW for i in at):
            out["reported"] = 1.0
        raw = set(re.findall(r"[^\s.,?!;:\"]+", sentence.lower()))
        if any(m and w not in raw for w, m in zip(words, marks)):
            out["disguised"] = 1.0
        i, name = best
        return out, _CATEGORY[name], words[i]

    def value(self, text: str | None) -> tuple[float, str | None, str | None]:
        """(score, category, term) of the worst sentence; 0 for null and empty values."""
        best: tuple[float, str | None, str | None] = (0.0, None, None)
        leads = self.leads
        if not text or sum(map(leads, text.split())) < 2:
            return best
        for s in _SENTENCE.split(text):
            if sum(map(leads, s.split())) < 2:
                continue
            f, category, term = self.features(s)
            if f:
                z = self.weights["bias"] + sum(self.weights[k] * v for k, v in f.items())
                p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))
                if p > best[0]:
                    best = (p, category, term)
        return best


def _grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def learn_words(values: list[tuple[str, int]], lexicon: Lexicon) -> dict[str, float]:
    """Words and pairs of words that stand nearly only in flagged values, with a weight by how sure that is."""
    flagged, other = Counter(), Counter()
    n = sum(y for _, y in values)
    if n < 30 or len(values) - n < 30:
        return {}
    for text, y in values:
        seen = {w for s in _SENTENCE.split(text or "") for w in _grams(lexicon.sentence(s)[0])}
        (flagged if y else other).update(seen)
    base = n / len(values)
    out = {}
    for w, k in flagged.items():
        if len(w) < 3 or k < 5 or w in lexicon.of["direct"] or k + other[w] > 0.05 * len(values):
            continue
        share = k / (k + other[w])
        if share >= 0.93 and -k * math.log(max(base, 1e-6)) >= 5.0:
            out[w] = 1.0 if " " not in w else 0.7
    return out


def calibrate(values: list[tuple[str, int]], scorer: Scorer) -> Scorer:
    """Refit the weights near their prior on the worst sentence of each labelled value, then set the threshold."""
    scorer.learned = learn_words(values, scorer.lexicon)
    if len(values) < 60:
        return scorer
    w = dict(scorer.weights)
    every = [([f for s in _SENTENCE.split(text or "") if (f := scorer.features(s)[0])], y) for text, y in values]
    for _ in range(3):
        rows = []
        for found, y in every:
            rows.append((max(found, key=lambda f: sum(w[k] * v for k, v in f.items()), default={}), y))
        for _ in range(60):
            grad = {k: 0.02 * len(rows) * (w[k] - PRIOR[k]) for k in w}
            for f, y in rows:
                if not f:
                    continue
                p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, w["bias"] + sum(w[k] * v for k, v in f.items())))))
                for k, v in [("bias", 1.0), *f.items()]:
                    grad[k] += (p - y) * v
            for k in w:
                w[k] -= grad[k] / len(rows)
        scorer.weights = w
    scorer.leads.cache_clear()
    scores = sorted((scorer.value(t)[0], y) for t, y in values)
    options = sorted({0.5, *[round(i / 20, 2) for i in range(6, 15)]}, key=lambda c: abs(c - 0.5))
    scorer.threshold = min(options, key=lambda c: sum((s >= c) != bool(y) for s, y in scores))
    return scorer


def labelled(pairs: DataFrame, labels: DataFrame, limit: int = MAX_LABELS) -> list[tuple[str, int]]:
    """Up to ``limit`` labelled values with their verdicts, for calibration only."""
    some = labels.where("flagged is not null and field in ('original', 'transformed')").select("label_id", "pair_key", "field", "flagged")
    some = some.orderBy(F.xxhash64("label_id"), "label_id").limit(limit).drop("label_id")  # at most MAX_LABELS short rows, the same ones each time
    rows = pairs.select("pair_key", "original", "transformed").join(F.broadcast(some), "pair_key").select(F.when(F.col("field") == "original", F.col("original")).otherwise(F.col("transformed")).alias("value"), "flagged")
    return [(r["value"], int(r["flagged"])) for r in rows.where("value is not null").collect()]


_OUT = "pair_key bigint, benchmark string, dialect string, field string, score double, category string, term string, flagged boolean"


def score_values(pairs: DataFrame, flag_terms: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per value that isn't null: score 0 to 1, category and term of its worst sentence, and the verdict.

    Empty values score 0; null values give no row; repeated rows count each.
    Whole texts are read, sentence by sentence.
    """
    terms = [(r["term"], r["category"], r["severity"]) for r in flag_terms.select("term", "category", "severity").orderBy("term", "category", "severity").collect()]  # a word list of reviewers
    counts = frequent_words(pairs.select("original", "transformed"))
    fitted = calibrate(labelled(pairs, labels), Scorer(terms, counts=counts))
    weights, learned, threshold = fitted.weights, fitted.learned, fitted.threshold
    shared = pairs.sparkSession.sparkContext.broadcast(counts)  # at most 1 / SHARE words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(terms, weights, learned, threshold, counts=shared.value)
        for pdf in batches:
            rows = []
            for key, b, d, *values in zip(pdf["pair_key"], pdf["benchmark"], pdf["dialect"], pdf["original"], pdf["transformed"]):
                for field, v in zip(("original", "transformed"), values):
                    if v is not None:
                        s, c, t = scorer.value(v)
                        rows.append((key, b, d, field, s, c, t, s >= scorer.threshold))
            yield pd.DataFrame(rows, columns=["pair_key", "benchmark", "dialect", "field", "score", "category", "term", "flagged"])

    return pairs.select("pair_key", "benchmark", "dialect", "original", "transformed").mapInPandas(run, _OUT)


def rates(scored: DataFrame, by: list[str]) -> DataFrame:
    """Values, flagged values and their rate per group."""
    return scored.groupBy(*by).agg(F.count("*").alias("values"), F.count_if("flagged").alias("flagged")).withColumn("rate", F.col("flagged") / F.col("values"))
