"""Operators for training data: brute force, round trips, planted cases, dirty input."""

import importlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duoscope.llm import abuse, leakage, packing, pair_defects, quantile_cut, queries, truncation
from tests.conftest import DATA, same_rows

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    same_rows(spark, queries.queries()[name], SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_runs(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0


def test_core_does_not_need_llm():
    for m in ("duoscope.plans.registry", "duoscope.operators.schema_drift", "duoscope.backends", "duoscope.streaming.incremental"):
        assert "duoscope.llm" not in open(importlib.import_module(m).__file__).read()


# --- 1


TERMS = [("idiot", "abuse", 1), ("gobshite", "abuse", 3), (None, None, None)]
ABUSIVE = [
    "You are an 1d10t.", "What a b@st@rd, I hope you choke on it.", "Get lost, m o r o n!", "Look at this h_a_l_f_w_i_t.", "You FiLtHy PiG", "you іdіоt", "Those outsiders are v*****n and should be driven out.", "Newcomers breed like cockroaches.",
    "Click for hardcore sex, adults only.", "I will break your jaw.", "She is a gobshiteeee", "you are an idiet",
]
HARMLESS = [
    "The dictionary entry explains where the word idiot comes from.", "A bloody nose kept Ann at home.", "Rats and cockroaches were found in the cabin, said the inspector.", "Kill the stuck process and start the pump again.", "Great tits and blue tits visited the feeder.",
    "The clinic offers breast screening.", "Foreigners who settle in Brenmoor get 57 hours of free lessons.", "An idiom is a saying.", "", "12 34", "The moderator removed a post that called someone a moron.",
]


def test_abuse_cases():
    s = abuse.Scorer(TERMS)
    assert [t for t in ABUSIVE if s.value(t)[0] < 0.5] == []
    assert [t for t in HARMLESS if s.value(t)[0] >= 0.5] == []
    assert s.value(None)[0] == 0.0


# Written for this test; they stand neither in the tables nor, as phrases, in the lexicon.
HELD_OUT = [
    "I will smash your ugly face.", "You deserve to rot in prison.", "I hope you drown in a ditch.", "Those immigrants should be shot.", "They are vermin and must be exterminated.", "All foreigners are thieves.", "You pathetic worthless pig.", "Shut your mouth, you moron.",
    "Somebody ought to strangle you.", "She is a filthy whore.", "Go hang yourself.", "The newcomers breed like rats.", "You are a disgusting slob.", "Nobody likes you, cretin.", "Those people are parasites.", "I'll punch your teeth out.", "Refugees must be driven out of this town, no mercy for them.",
    "Watch me strip naked on the webcam.", "Send me your topless selfies.", "What a stupid bitch.", "We should gas them all.", "Nobody would miss you if you died.", "You lazy lying rat.", "I want to lick your naked body all night in bed.", "Their kind steal everything and infect our children.", "Kill yourself, wanker.",
    "I wish you would choke.", "These peasants are subhuman.", "I will cut your throat while you sleep.", "Piss off, you arsehole.",
]
MENTIONED = [
    "The doctor examined his neck and broken nose.", "The farmer said the rats had infected the grain.", "The word bitch originally meant a female dog.", "The police report said he had been called an idiot.", "The team killed the clock and won the match.", "The patient lost both legs and his teeth.", "A historian explains how refugees were driven out in 1755.",
    "The moderator deleted a comment in which someone called her a slut.", "Please hang your coat near the bed.", "The novel quoted the line, you moron, twice.", "The swarm of locusts destroyed the crops.", "Breast cancer screening is offered to all women.", "They shot the film in the mountains.", "He stole second base in the match.", "You can cut the cake now.",
    "She broke her leg in the dictionary room.", "The dog jumped into the ditch.", "We hope you enjoy the show.",
]
MISSPELT = ["You are an idiit.", "What a bastrd you are.", "You stupid moroon.", "Look at this wnker, you said.", "You are scvmbag material.", "You absolute dickheed.", "She is a gobshote.", "They are paresites, all of them.", "Those outsiders are vermyn.", "You jidiot, you."]


def test_abuse_held_out():
    s = abuse.Scorer([])
    found = [t for t in HELD_OUT if s.value(t)[0] >= 0.5]
    assert len(found) >= 0.9 * len(HELD_OUT), sorted(set(HELD_OUT) - set(found))
    wrong = [t for t in MENTIONED if s.value(t)[0] >= 0.5]
    assert len(wrong) <= 1, wrong


def test_misspelled_terms_come_through_the_automaton():
    with_edits, without = abuse.Scorer([]), abuse.Scorer([], budget=0)
    found = [t for t in MISSPELT if with_edits.value(t)[0] >= 0.5]
    assert len(found) >= 9, sorted(set(MISSPELT) - set(found))
    assert sum(without.value(t)[0] >= 0.5 for t in MISSPELT) <= 1
    # a word that the corpus has as often as the term is a word of its own
    assert abuse.Scorer([], counts={"idiit": 50, "idiot": 40}).value("You are an idiit.")[0] < 0.5
    assert abuse.Scorer([], counts={"idiit": 3, "idiot": 40}).value("You are an idiit.")[0] >= 0.5


def test_joined_and_long_tokens():
    s = abuse.Scorer([])
    for t in ("You are wrong—idiot.", "you...moron", "You i-d-i-o-t and w-o-r-m.", "you " + "i" * 60 + "diot", "fool/idiot, you"):
        assert s.value(t)[0] >= 0.5, t


def test_automaton_against_distance():
    words = ["bastard", "idiot", "moron", "scum", "filth"]
    trie, rng = abuse.Trie(words), random.Random(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(200):
        w = list(rng.choice(words))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgio")
        got = dict(trie.match(w, 2))
        assert got == {x: d for x in words if (d := distance("".join(w), x)) <= 2}


def test_abuse_tables(spark):
    schema = "pair_key long, benchmark string, dialect string, original string, transformed string, score string"
    df = spark.createDataFrame([(1, "b", None, "you idiot", None, "x"), (1, "b", None, "you idiot", "", "x"), (2, None, "d", "fine " * 50_000, "you moron " * 2_000, None)], schema)
    terms = spark.createDataFrame(TERMS, "term string, category string, severity int")
    labels = spark.createDataFrame([], "label_id long, pair_key long, field string, flagged int, reviewer string")
    got = {(r["pair_key"], r["field"], r["flagged"]) for r in abuse.score_values(df, terms, labels).collect()}
    assert got == {(1, "original", True), (1, "transformed", False), (2, "original", False), (2, "transformed", True)}
    assert abuse.score_values(df.limit(0), terms.limit(0), labels).count() == 0


# --- 3


def brute_cutoff(values, pct):
    ok = sorted((v for v in values if v is not None and 0 <= v <= 1), reverse=True)
    return next((v for v in ok if sum(x >= v for x in ok) * 100 >= pct * len(ok)), None)


@pytest.mark.parametrize("most", [1, 3, 10**5])
def test_quickselect(spark, most):
    """All targets at once, or some at a time."""
    rng = random.Random(most)
    rows = [(i, g, rng.choice([rng.random(), 0.5, 0.25, 1.0, 0.0, -1.0, 7.0, float("nan"), None])) for i in range(600) for g in [rng.choice(["a", "a", "a", "b", None])]]
    df = spark.createDataFrame(rows, "k long, g string, s double").withColumn("gid", F.lit(1)).withColumn("value", F.lit("x")).repartition(5)
    targets = spark.createDataFrame([("a", "s", 10), ("a", "s", 10), ("b", "s", 100), (None, "s", 33), ("c", "s", 50), ("a", "s", 1), ("b", "s", None), ("b", "s", 0)], "g string, score string, keep_pct int")
    long = quantile_cut.long_scores(df, "k", ["g"], ["s"])
    cuts = quantile_cut.cutoffs(long, targets, ["g"], max_sources=most)
    got = {(r["g"], r["keep_pct"]): r["cutoff"] for r in cuts.collect()}
    for (g, p), c in got.items():
        want = brute_cutoff([s for _, x, s in rows if x == g], p)
        assert c == (want if p else max(s for _, x, s in rows if x == g and s is not None and 0 <= s <= 1))
    assert set(got) == {("a", 10), ("b", 100), (None, 33), ("a", 1), ("b", 0)}
    kept = quantile_cut.kept(long, cuts.where("keep_pct = 10"), "k", ["g"])
    assert kept.count() == sum(1 for _, g, s in rows if g == "a" and s is not None and got[("a", 10)] <= s <= 1)


def test_quickselect_empty(spark):
    df = spark.createDataFrame([], "k long, g string, s double")
    targets = spark.createDataFrame([("a", "s", 10)], "g string, score string, keep_pct int")
    assert quantile_cut.cutoffs(quantile_cut.long_scores(df, "k", ["g"], ["s"]), targets, ["g"]).count() == 0
    assert quantile_cut.cutoffs(quantile_cut.long_scores(df, "k", ["g"], ["s"]), targets.limit(0), ["g"]).count() == 0


# --- 4


def test_truncation_planted(spark):
    rng = random.Random(1)
    nouns, places = ["harbour", "kettle", "garden", "lantern", "river", "bridge"], ["Ullesby", "Vanholt", "Caldwick"]
    whole = lambda: f"The {rng.choice(nouns)} near {rng.choice(places)} was painted in the autumn of {rng.randint(1900, 2000)}. Nobody knew why the {rng.choice(nouns)} had been moved to the market."
    rows = [(i, "m", whole(), None) for i in range(400)]
    cut = {7: "Nobody knew why the kettle had been mov", 8: "The harbour near Ullesby was painted in the", 9: whole()[:-9] + "…", 10: "Nobody knew why the river had been moved to�"}
    fine = {20: "Nobody knew why the garden had been moved to the market", 21: "#### 42", 22: "B", 23: None, 24: "", 25: "\n \n", 26: "N/A", 27: "Option C"}
    rows = [(i, m, {**cut, **fine}.get(i, t) if i in {**cut, **fine} else t, r) for i, m, t, r in rows]
    df = spark.createDataFrame(rows, "k long, m string, reply string, text string")
    got = {r["row_key"]: r["cut"] for r in truncation.truncated(truncation.values(df, "k", ["reply"], "m")).collect()}
    assert {k for k, v in got.items() if v} == set(cut)
    assert {23, 24, 25, 26}.isdisjoint(got)


def _copies(spark, texts):
    v = truncation.values(spark.createDataFrame([(k, "m", t) for k, t in texts.items()], "k long, m string, t string"), "k", ["t"], "m")
    return v, {r["row_key"] for r in truncation.truncated(v).where("by_copy and cut").collect()}


def test_truncation_copies(spark):
    w = [f"word{i}" for i in range(60)]
    long = " ".join(w) + "."
    assert _copies(spark, {1: long, 2: " ".join(w[:55]), 3: long, 4: "short one."})[1] == {2}


def test_truncation_copies_of_all_kinds(spark):
    w = [f"word{i}" for i in range(60)]
    other = ["extra", *w[1:52], "goes", "elsewhere", *[f"more{i}" for i in range(9)]]
    texts = {
        1: " ".join(w) + ".", 2: " ".join(w[:55]) + ".", 3: " ".join(w[:52]) + " = 12", 4: " ".join([*w[:52], "=", "12", "kettles", *w[55:]]) + ".",
        5: " ".join(other) + ".", 6: "new start of " + " ".join(w[4:56]) + "?", 7: " ".join(w[:20] + w[21:56]), 8: " ".join(w[:50]) + " wor", 9: " ".join(w[:52]) + " goes", 10: " ".join(w[30:]),
    }
    assert _copies(spark, texts)[1] == {2, 3, 6, 7, 8, 9}


def _planted(rng, n):
    """Texts of some sentences over a small vocabulary, and for each a cut copy with the share of its words that is kept."""
    vocab = [f"{a}{b}" for a in ["ban", "cor", "del", "fis", "gol", "hum", "jas", "kel"] for b in ["ter", "min", "dow", "vel", "rin", "sto"]]
    whole, cuts = {}, {}
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 60))]
        for k in range(8, len(words) - 4, 9):
            words[k] += "."
        words[-1] += "."
        whole[i] = " ".join(words)
    for share in (40, 60, 75, 85, 95):
        for i in range(n):
            words = whole[i].split()
            at = max(7, len(words) * share // 100)
            while words[at - 1].endswith("."):
                at -= 1
            cuts[share * 1000 + i] = words[:at]
    return whole, cuts


def _contained(a, b):
    x, y = ({tuple(" ".join(t).replace(".", "").split()[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x)


@pytest.mark.parametrize("kind", ["plain", "mark", "broken", "first word altered", "middle word altered"])
def test_truncation_recall_of_copies(spark, kind):
    rng = random.Random(5)
    whole, cuts = _planted(rng, 60)
    for k, words in cuts.items():
        if kind == "broken":
            words[-1] = words[-1][:3]
        elif kind != "plain" and kind != "mark":
            words[0 if kind.startswith("first") else len(words) // 2] = "other"
    texts = {**whole, **{k: " ".join(w) + ("." if kind == "mark" else "") for k, w in cuts.items()}}
    v, got = _copies(spark, texts)
    assert not got & set(whole)
    for share in (40, 60, 75, 85, 95):
        some = {k for k in cuts if k // 1000 == share and _contained(cuts[k][:-1], whole[k % 1000].split()) >= 0.8}  # others are no near-copies
        assert len(got & some) >= 0.9 * len(some), (share, len(got & some))


def test_truncation_copies_at_the_threshold(spark):
    """Every copy with exactly 0.8 of its shingles or words alike is found, whatever differs."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    texts, cut = {}, set()
    for i in range(150):
        w = [word() for _ in range(40)]
        texts[i] = " ".join(w) + "."
        a = w[:30]
        a[rng.randint(4, 24)] = word()  # 20 of 25 shingles are left
        texts[1000 + i] = " ".join(a)
        cut.add(1000 + i)
    for i in range(20):
        w = [word() for _ in range(40)]
        texts[2000 + i], texts[3000 + i] = " ".join(w) + ".", " ".join(w[2:12])  # two of ten words lack
        v = [word() for _ in range(40)]
        texts[4000 + i], texts[5000 + i] = " ".join(v) + ".", " ".join([*v[:26], word(), *v[27:30]])  # the third word before the last is another
        u = [word() for _ in range(40)]
        texts[6000 + i], texts[7000 + i] = " ".join(u) + ".", " ".join([*u[:28], u[28].title(), u[29].title()])
        t = [word() for _ in range(40)]
        texts[8000 + i], texts[9000 + i] = " ".join(t) + ".", " ".join(t[:28]) + ". " + " ".join(t[28:30])
        cut |= {k + i for k in (3000, 5000, 7000, 9000)}
    assert all(truncation._aligned_early(texts[k], texts[k - 1000]) for k in cut)
    assert _copies(spark, texts)[1] == cut


def test_truncation_copies_against_brute_force(spark):
    rng = random.Random(9)
    vocab = [a + b for a in ("ban", "cor", "del", "fis") for b in ("ter", "min", "dow", "vel")]
    texts = {}
    for i in range(40):
        w = [rng.choice(vocab) for _ in range(rng.randint(14, 40))]
        for k in range(7):
            a = list(w)
            for _ in range(k // 2):
                a[rng.randrange(len(a))] = rng.choice(vocab)
            a = a[rng.choice((0, 0, 1, 3)) :][: rng.randint(7, 40)]
            a[-1] = a[-1][: rng.choice((2, 4, 6))]
            texts[100 * i + k] = " ".join(a) + rng.choice(("", "", ".", "…"))
    v = truncation.values(spark.createDataFrame([(k, "m", t) for k, t in texts.items()], "k long, m string, t string"), "k", ["t"], "m")
    want = {k for k, a in texts.items() if any(a != b and truncation._aligned_early(a, b) for b in texts.values())}
    hashed = v.where(F.length("text") > 0).withColumn("text_hash", F.xxhash64("text"))
    needs = truncation._ROWS[truncation._ROWS.index("last bigint") :]
    all_ = hashed.mapInPandas(lambda batches: (b[["text_hash"]].assign(**truncation._needs(b["text"].str.lower().tolist())) for b in batches), "text_hash bigint, " + needs)
    key = {r["text_hash"]: r["text"] for r in hashed.collect()}
    got = {key[r["text_hash"]] for r in truncation.cut_copies(hashed, all_).collect()}
    assert len(want) > 50 and got == {texts[k] for k in want}


def test_hot_group_of_copies(spark):
    """Texts that differ in one number each, and cut copies of some of them."""
    body = "the harbour gate of the old town was opened again by order number {} and the people went through it with lanterns in their hands."
    texts = {i: "We heard that " + body.format(i + 1000) for i in range(400)}
    texts |= {1000 + i: texts[i].split(" lanterns")[0] for i in range(0, 400, 8)}
    assert _copies(spark, texts)[1] == {k for k in texts if k >= 1000}


def test_distance_of_texts():
    rng = random.Random(6)
    for _ in range(200):
        p, t = [rng.choice("abc") for _ in range(rng.randint(0, 9))], [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        row = list(range(len(p) + 1))
        for x in t:
            new = [row[0] + 1]
            for j, y in enumerate(p, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        assert truncation._distance(p, t) == row[-1]


@pytest.mark.parametrize("pad", ["", " " * 15, " " * 400, "\n" * 300, "." * 200, "…" * 150, ". " * 100, "\u2003" * 150])
def test_truncation_padded_ends(pad):
    cut = "The long garden wall by the old harbour was painted while the lantern stood in the"
    texts = {"cut": cut, "whole": cut + " hall.", "quoted": f"\"{cut} hall.\"", "answer": "She counts them again, so the answer is 42", "notice": "N/A"}
    read = lambda p: next(truncation._read_values([pd.DataFrame({"row_key": range(len(texts)), "field": list(texts), "source": "m", "text_hash": range(len(texts)), "text": [t + p for t in texts.values()], "reference": None})])).set_index("field")
    plain, padded = read(""), read(pad)
    assert list(padded.index) == ["cut", "whole", "quoted", "answer"]
    assert (plain[["end_id", "last", "prefix", "bits"]] == padded[["end_id", "last", "prefix", "bits"]]).all(None)
    assert not padded["closed"]["cut"] or pad == "" and not plain["closed"]["cut"]
    if not pad.strip():
        assert padded["closed"].tolist() == [False, True, True, False] and padded["answer"]["answer"]


def test_truncation_long_words():
    text = "We went there. " + " ".join(c * 45 for c in "abcdefgh")
    rows = [next(truncation._distinct_ends([pd.DataFrame({"text": [t]})])) for t in (text, text[6:])]
    whole = truncation.Words([text])
    assert all(r[c][0] == (whole.contexts()[c][-1:] & truncation._EVEN).view(np.int64)[0] for r in rows for c in truncation.CONTEXTS)
    assert rows[0]["raw"][0] == "h" * 45


def test_words_against_regex():
    """The reader of bytes gives the words and marks that a plain regular expression gives."""
    import re

    from duoscope.llm.tokens import Words

    rng = random.Random(11)
    alphabet = ["a", "B", "é", "Ä", "7", "-", "'", "’", " ", " ", ".", "…", "?", "\n", "_", "—", "\u2003", ",", "ß", "य"]
    texts = ["", None, "x", " ", "."] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    w = Words(texts)
    want, doc, closed = [], [], []
    for i, t in enumerate(texts):
        found = re.findall(r"[^\W_]+(?:['’\-][^\W_]+)*|[.?!…।\n]", t or "")
        for k, x in enumerate(found):
            if x not in "….?!।\n":
                want.append(x.lower().replace("’", "'"))
                doc.append(i)
                closed.append(k + 1 < len(found) and found[k + 1] in "….?!।\n")
    assert [w.word(i) for i in range(len(w.ids))] == want and w.doc.tolist() == doc and w.closed.tolist() == closed
    assert w.counts.tolist() == [doc.count(i) for i in range(len(texts))]
    assert len(set(w.exact.tolist())) == len({x.lower().translate({0xC4: 0xE4}) for x in want})


def test_bounded_batches():
    from duoscope.llm.tokens import bounded

    pdf = pd.DataFrame({"a": ["x" * n for n in (3, 9, 1, 1, 1, 30, 0, 2)], "b": [None, "y", None, None, None, None, None, "z"]})
    parts = list(bounded([pdf, pdf.iloc[:0]], ["a", "b"], most=10))
    assert pd.concat(parts).equals(pdf) and [len(p) for p in parts] == [1, 1, 3, 1, 2, 0]
    assert [len(p) for p in bounded([pdf], ["a"], most=100)] == [8]


def test_bloom_loses_nothing(spark):
    from duoscope.llm.tokens import Bloom

    keys = spark.range(5_000).selectExpr("xxhash64(id) as k")
    f = Bloom.of(keys, "k")
    mine = keys.toPandas()["k"].to_numpy().view(np.uint64)
    assert f.has(mine).all() and f.has(np.arange(1, 5_001, dtype=np.uint64) * np.uint64(12345)).mean() < 0.05
    assert not Bloom.of(keys.limit(0), "k").has(mine).any()


def test_truncation_empty(spark):
    df = spark.createDataFrame([], "k long, m string, t string")
    assert truncation.truncated(truncation.values(df, "k", ["t"], "m")).count() == 0


# --- 5


# Written for this test; they stand neither in the tables nor in the generators.
REFUSED = [
    "Apologies, but writing such a letter is beyond what I am willing to do.", "I will have to turn this one down.", "Sorry, I don't do that kind of thing.", "I can't give you an answer to that question.", "As an assistant I cannot support a request like this.",
    "No, I won't write anything of the sort.", "This is not something I'm allowed to discuss.", "I must decline to go on with this.", "Unfortunately I am not able to reply to such messages.", "My guidelines do not let me respond to this request.",
    "I'm sorry, I can't do what you ask here.", "I would prefer not to answer this.", "I refuse to take part in this conversation.", "That request violates the policy I follow, so I won't help.", "I am unable to produce content of that nature.",
]
STRANGE = [
    "Ich glaube, dass die Lampen schon am Samstag verkauft wurden.", "Nous devons d'abord soustraire les pommes qui ont été mangées.", "Creo que el tren llegó tarde porque llovía mucho.", "Penso che la risposta giusta sia la seconda.", "Wij hebben de boten gisteren naar de haven gebracht.", "Myślę, że sąsiedzi przyjdą dopiero jutro wieczorem.",
    "Jag tror att det finns tolv äpplen kvar i lådan.", "Она сказала, что вернётся домой только завтра.", "Minä luulen, että kissat nukkuvat vielä.", "Bence çocuklar bugün okula gitmedi.", "Pienso que no hay ninguna diferencia entre los dos.", "Donc il manque encore quinze pièces.", "先に箱の中のりんごを数えます。", "मुझे लगता है कि वे कल आएंगे।", "Eu acho que os meninos foram embora cedo.",
]


def _verdicts(model, features, texts, prompts, field="transformed_response"):
    i, v, n = features.rows(texts, prompts, field, [False] * len(texts))
    return model.verdicts(model.scores(i, v, n, len(texts)))


@pytest.fixture(scope="session")
def defects(spark):
    audits = spark.read.parquet(f"{DATA}/audit_pairs.parquet")
    rows = [r.asDict() for r in audits.select(*pair_defects._READ).collect()]
    vocabulary = pair_defects.vocabulary(audits)
    return rows, pair_defects.train(rows, vocabulary), pair_defects.Features(vocabulary)


def test_defects_held_out(defects):
    rows, model, f = defects
    rng = np.random.default_rng(5)
    base = [r for r in rows if r["transformed_response"] and r["transformed_prompt"]]
    prompts = [r["transformed_prompt"] for r in base[:15]]
    assert sum(g == "refusal" for g in _verdicts(model, f, REFUSED, prompts)) >= 13
    assert sum(g == "language" for g in _verdicts(model, f, STRANGE, prompts)) >= 14
    assert sum(g == "language" for g in _verdicts(model, f, STRANGE, prompts, "transformed_answer")) >= 14
    for label, make in (("copy", lambda r: pair_defects._altered(pair_defects._question(r["transformed_prompt"]), rng)), ("empty", lambda r: str(rng.choice(pair_defects.PLACEHOLDERS)))):
        some = [base[i] for i in rng.integers(0, len(base), 120)]
        got = _verdicts(model, f, [make(r) for r in some], [r["transformed_prompt"] for r in some])
        assert sum(g == label for g in got) >= 0.85 * len(some), label


def test_parts_do_not_stand_in_the_replies(defects):
    """No generated refusal or foreign text of four words or more is a reply of the tables or a sentence of one."""
    import re

    rows, _, _ = defects
    said = {s.strip(" .!?").lower() for r in rows for t in (r["original_response"], r["transformed_response"]) if t for s in re.split(r"(?<=[.?!])\s+|\n", t)}
    rng = np.random.default_rng(1)
    made = [make(rng).strip(" .!?").lower() for make in (pair_defects._refusal, pair_defects._foreign) for _ in range(2_000)]
    assert sum(len(m.split()) > 3 and m in said for m in made) <= 0.01 * len(made)
    for own in (*REFUSED, *STRANGE):
        assert own.strip(" .!?").lower() not in said


def test_refused_replies_of_the_tables(defects):
    """Replies whose extracted answer says so are found, on both sides."""
    rows, model, f = defects
    for side in ("original", "transformed"):
        some = [r for r in rows if r[f"{side}_answer"] == "refused" and r[f"{side}_response"]]
        got = _verdicts(model, f, [r[f"{side}_response"] for r in some], [r[f"{side}_prompt"] for r in some], f"{side}_response")
        assert sum(g == "refusal" for g in got) >= 0.9 * len(some) > 0


def test_copied_share_of_all_word_pairs():
    prompt = 'Where did "Ann", the miller, put her tin lantern - and why?'
    copied = lambda t: int(pair_defects.Features.copied(pair_defects.Words([t, "else"]), pair_defects.Words([prompt, t]))[0])
    assert copied("ANN the miller put: her tin") == 10
    assert copied("Ann, well, the miller had put her, so tin lantern") == 3  # of nine pairs
    assert copied("tin lantern") == 10 and copied("lantern") == 0 and copied("a lantern of tin") == 0
    assert copied("") == 0


def test_vocabulary_of_all_rows(spark):
    schema = "audit_key long, original_prompt string, transformed_prompt string, original_response string, transformed_response string"
    rows = [(i, "Count the lanterns there", None, "We have lanterns, and lan", "") for i in range(30)] + [(99, "rareword", "Zug fährt", "ok", None)]
    v = pair_defects.vocabulary(spark.createDataFrame(rows, schema))
    h = lambda *w: pair_defects.Words(list(w)).exact
    assert v.is_known(h("lanterns", "count", "zug", "rareword")).tolist() == [True, True, False, False]
    assert v.broken(h("lan", "lanterns", "zu")).tolist() == [True, False, False]
    few = pair_defects.vocabulary(spark.createDataFrame(rows, schema), share=0.2)
    assert len(few.counts[0]) <= 5
    assert not pair_defects.vocabulary(spark.createDataFrame([], schema)).broken(h("lan")).any()


def test_defects_dirty(spark):
    audits = spark.read.parquet(f"{DATA}/audit_pairs.parquet")
    schema = audits.select(*pair_defects._READ).schema
    odd = [(1, None, None, None, None, None, None, None, None), (1, "m", "", "", "", "", "", "", ""), (2, "m", "Q?", "Q?", "word " * 40_000, "ok. #### 5", None, None, "x")]
    df = audits.select(*pair_defects._READ).unionByName(spark.createDataFrame(odd, schema)).withColumn("field", F.lit(1)).withColumn("defect", F.lit(2))
    got = pair_defects.classify(df).where("audit_key in (1, 2)")
    assert got.where("field = 'original_response' and defect = 'empty'").count() >= 2
    assert pair_defects.classify(audits.limit(0)).count() == 0


# --- 6


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 5, 40, 99, 100, 101, 250, 33])) for i in range(500)]
    sizes = spark.createDataFrame(rows, "doc_id long, tokens long").withColumn("capacity", F.lit("x"))
    targets = spark.createDataFrame([("a", 100), ("b", 64), ("c", 0), ("d", None)], "job_name string, capacity_tokens int")
    got = packing.pack(sizes.select("doc_id", "tokens"), targets, group=100)
    full = got.groupBy("job_name", "container").agg(F.sum("tokens").alias("s"), F.first("capacity").alias("c"))
    assert full.where("s > c").count() == 0
    back = {(r["job_name"], r["doc_id"]): r["s"] for r in got.groupBy("job_name", "doc_id").agg(F.sum("tokens").alias("s")).collect()}
    assert back == {(j, i): s for j in "ab" for i, s in rows}
    split = got.groupBy("job_name", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("s"), F.first("capacity").alias("c")).where("n > 1 and s <= c")
    assert split.count() == 0
    assert packing.waste(got).count() == 2
    assert packing.pack(sizes.limit(0).select("doc_id", "tokens"), targets).count() == 0


def test_local_search_never_worse():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = rng.integers(0, 60, 120)
        start = packing.best_fit_decreasing(sizes, 100)
        end = packing.local_search(sizes, start, 100)
        assert np.bincount(end, sizes).max() <= 100 and len(set(end)) <= len(set(start))
    hard = np.array([44, 24, 24, 22, 21, 17, 8, 8, 6, 6])
    assert len(set(packing.local_search(hard, packing.best_fit_decreasing(hard, 60), 60))) == 3
    many = np.concatenate((rng.integers(0, 4, 3_000), rng.integers(300, 700, 400)))  # bins of very many items
    end = packing.local_search(many, packing.best_fit_decreasing(many, 1_000), 1_000)
    assert np.bincount(end, many).max() <= 1_000


def test_outs_against_pairs():
    rng = np.random.default_rng(6)
    for _ in range(30):
        sizes, mine = rng.integers(0, 9, 40), np.sort(rng.choice(40, 12, replace=False))
        outs, given = packing._outs(sizes, mine)
        want = {int(sizes[i]) for i in mine} | {int(sizes[i] + sizes[k]) for n, i in enumerate(mine) for k in mine[n + 1 :]}
        assert outs.tolist() == sorted(want)
        assert all(int(sizes[list(g)].sum()) == o and len(set(g)) == len(g) and set(g) <= set(mine.tolist()) for o, g in zip(outs, given))


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "a" * 50_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in packing.token_sizes(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 1_000


# --- 7


def test_myers_against_table():
    rng = random.Random(8)
    for _ in range(200):
        p, t = [rng.choice("abc") for _ in range(rng.randint(1, 9))], [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        row = list(range(len(p) + 1))
        best = row[-1]
        for x in t:
            new = [0]
            for j, y in enumerate(p, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
            best = min(best, row[-1])
        assert leakage.myers(p, t) == best


def test_leaks_both_ways(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 30)))) for i in range(40)] + [(98, None), (99, "")]
    docs = []
    for d in range(60):
        q = rng.choice(items[:40])[1].split()
        a = rng.randint(0, max(0, len(q) - 1))
        docs.append((d, " ".join(rng.choice(vocab) for _ in range(5)) + ", " + "\n".join(q[a : a + rng.randint(4, 20)]).upper() + " end"))
    docs += [(90, None), (91, ""), (92, items[0][1]), (93, items[0][1])]
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string").withColumn("run", F.lit(1)), spark.createDataFrame(items, "item_id long, question string").withColumn("text", F.lit("z"))
    want = set()
    for d, t in docs:
        w = leakage.words(t)
        grams = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
        want |= {(d, i) for i, q in items if any(tuple(leakage.words(q)[k : k + 10]) in grams for k in range(len(leakage.words(q)) - 9))}
    for bound in (1_000, 0):
        got = leakage.find_leaks(dd, ii, max_automaton_items=bound)
        assert {(r["doc_id"], r["item_id"]) for r in got.where("distance = 0 and passage = 10").collect()} == want
    assert leakage.find_leaks(dd.limit(0), ii).count() == 0 and leakage.find_leaks(dd, ii.limit(0)).count() == 0


def test_near_leaks_at_every_offset(spark):
    item = [f"w{i}" for i in range(24)]
    docs = []
    for a in range(15):
        for e in range(10):
            quoted = item[a : a + 10]
            docs += ["x y " + " ".join(q) + " z" for q in (quoted[:e] + ["other"] + quoted[e + 1 :], quoted[:e] + quoted[e + 1 :], quoted[:e] + ["more"] + quoted[e:])]
    docs.append(" ".join(item[:4] + ["other"] + item[5:8] + ["other"] + item[9:10]))
    dd, ii = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, question string")
    for bound in (1_000, 0):
        got = {r["doc_id"]: r["distance"] for r in leakage.find_leaks(dd, ii, max_automaton_items=bound).collect()}
        assert set(got) == set(range(len(docs) - 1)) and max(got.values()) == 1


# --- 8


def test_stuffed_pages(spark):
    from duoscope.llm import stuffing

    rng = random.Random(12)
    nouns, verbs = ["river", "house", "garden", "road", "mill", "market", "bridge", "school", "church", "field"], ["opened", "painted", "sold", "crossed", "found", "closed"]
    said = lambda: f"The {rng.choice(nouns)} near the {rng.choice(nouns)} was {rng.choice(verbs)} in the spring, and nobody in the town knew why it had been {rng.choice(verbs)}."
    menu = "Home\nContact\nNews\n"
    prose = [(i, "en", menu + "\n".join(said() for _ in range(rng.randint(4, 9))) + "\nBack to top.") for i in range(300)]
    keys = ["cheap boots", "gold watch", "vape juice", "casino bonus", "payday loan"]
    spam = [(1000 + i, "en", menu + ", ".join(rng.choice(keys) for _ in range(60))) for i in range(10)]
    verse = [(2000, "en", menu + "\n".join(["The river by the mill was crossed in the spring, and nobody knew why."] * 12))]
    odd = [(3000, None, None), (3001, "en", ""), (3002, "xx", " \n "), (3003, "en", "boots"), (3004, "ru", "слово дело " * 40), (1000, "en", spam[0][2]), (3005, "en", said() * 20_000)]
    df = spark.createDataFrame(prose + spam + verse + odd, "doc_id long, lang string, text string").withColumn("words", F.lit("x")).withColumn("length", F.lit(1))
    got = [r["doc_id"] for r in stuffing.classify(df).where("stuffed").collect()]
    assert {i for i, _, _ in spam} <= set(got)
    assert not {i for i, _, _ in prose + verse} & set(got) and 3005 not in got and 3003 not in got
    assert stuffing.classify(df.limit(0)).count() == 0


def test_stuffed_lines_of_hosts(spark):
    """A host's own menu is left out however few pages the host has among all; a keyword line it repeats is not."""
    from duoscope.llm import stuffing

    rng = random.Random(3)
    menu = "Moss & Fern\nOur herbarium\nSeeds by post\n"
    spam = "cheap boots, gold watch, vape juice, casino bonus, payday loan, cheap flights, gold watch, vape juice, cheap boots, casino bonus, gold watch"
    pages = [(i, "en", f"host{i % 300}", f"The mill number {i} was sold in {rng.randint(1900, 2000)}.\nNobody in town {rng.randint(0, 99)} knew why.") for i in range(3_000)]
    pages += [(10_000 + i, "en", "fern", menu + f"A fern numbered {i} was found by the river in {1900 + i}.") for i in range(8)]
    pages += [(20_000 + i, "en", "spam", f"{spam}\npage {i}\n{spam}") for i in range(40)]
    df = spark.createDataFrame(pages, "doc_id long, lang string, source string, text string")
    everywhere, own = stuffing.common_lines(df.select("source", "text"))
    got = {(r["source"], r["line"]) for r in own.collect()}
    assert {("fern", stuffing._line(x)) for x in menu.strip().split("\n")} <= got
    assert not any(h == stuffing._line(spam) for h in [*everywhere, *(line for _, line in got)])
    found = {r["doc_id"] for r in stuffing.classify(df).where("stuffed").collect()}
    assert {20_000 + i for i in range(40)} <= found and not found & set(range(12_000))
