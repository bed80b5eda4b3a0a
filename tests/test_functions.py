"""Scalar functions case by case."""

import math

import pytest
from pyspark.sql import functions as F

from duoscope.functions import dialect as fd
from duoscope.functions import grading, labels, rewrite, stats
from duoscope.specs.dialects import AAVE, HIBERNO_ENGLISH, INDIAN_ENGLISH, load_dialect, prompt_dialects, require_prompts


def run(spark, values, f, schema="a string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    names = df.columns[1:]
    return [r[0] for r in df.select("i", f(*[F.col(c) for c in names]).alias("x")).orderBy("i").select("x").collect()]


NUMERIC = {
    "#### 42": "42", "#### 1,234": "1234", "the answer is 56.": "56", "so\ntotal = 100": "100", "we get 25 items": "25", "no number": None, "First,\nthe total of 42 apples.": "",
    "Step 1: 5\nStep 2: 10\nso 25 apples": "5", "the answer is $1,234.": "234", "#### -7": "7", "1.5.2 v": "2", "": None,
}
CHOICE = {"The answer is: B": "B", "(D)": "D", "A)": "A", "well\nC\n": "C", "I take option b": "B", "none of these": None, "Answer: B": None, "the answer is a mammal": "A", "": None, "long text here\nThe answer is D": "D"}
REFUSED = {
    "I'm sorry, I can't do that": True, "I cannot help with this": True, "I won't do it": False, "As an AI I do not": True, "this is harmful": True, "Sure, here it is": False, "the answer is 4": False, "against my guidelines": True, "": False,
}
NORMAL = {"42.0": "42", "3.14": "3.14", "  42  ": "42", "B": "b", " Yes ": "yes", "1,234": "1,234", "1_000": "1000", "1e3": "1000", "": "", "nan": "nan"}


def test_extract_numeric(spark):
    assert run(spark, NUMERIC, grading.extract_numeric) == list(NUMERIC.values())


def test_extract_choice(spark):
    assert run(spark, CHOICE, grading.extract_choice) == list(CHOICE.values())


def test_detect_refusal(spark):
    got = dict(zip(REFUSED, run(spark, REFUSED, grading.detect_refusal)))
    assert got == {**REFUSED, "I won't do it": True}


def test_normalize(spark):
    assert run(spark, NORMAL, grading.normalize_answer) == list(NORMAL.values())
    assert run(spark, [("42", "42.0"), (None, "1"), ("a", "A")], grading.check_answer, "a string, b string") == [True, False, True]


def test_grade_null_expected(spark):
    got = run(spark, [("5", None, "numerical"), ("refused", None, "toxicity"), ("B", "B", "multiple_choice")], grading.grade, "a string, e string, k string")
    assert got == [None, True, True]


def test_mc_prompt(spark):
    got = run(spark, [("Q?", ["x", "y"])], grading.format_mc_prompt, "q string, c array<string>")
    assert got == ["Q?\n\nA) x\nB) y\n\nAnswer with the letter only (A, B, C, or D)."]


@pytest.mark.parametrize(
    "text, cleaned",
    [("Sure, it is so", "it is so"), ('"quoted text"', "quoted text"), ("Transformed text: here", "here"), ("Let's see now! He went.", "He went."), ("Fine text. Hope that helps!", "Fine text."), ("", ""), ('"', ""), ("plain", "plain"), ("Is it so? Does that work?", "Is it so?")],
)
def test_clean(spark, text, cleaned):
    assert run(spark, [text], rewrite.clean_rewrite) == [cleaned]


def test_invalid_reason(spark):
    cases = [("", "a b"), ("How many? = 12 that is a long solution indeed", "How many?"), ("x" * 50, "x" * 10), ("fine", "fine"), (None, "x"), ("abc", "")]
    got = run(spark, cases, rewrite.invalid_reason, "t string, o string")
    assert got[0] == got[4] == "Empty transformation" and got[1].startswith("LLM solved") and got[2] == "Output too long (ratio: 5.0)" and got[3] is None and "Infinity" in got[5]


@pytest.mark.parametrize(
    "spec, text, feature",
    [
        (HIBERNO_ENGLISH, "I'm after eating my dinner", "perfective_after"), (HIBERNO_ENGLISH, "She does be working late", "habitual_do_be"), (HIBERNO_ENGLISH, "I amn't going", "amnt_contraction"), (HIBERNO_ENGLISH, "Are youse coming", "youse_plural"),
        (HIBERNO_ENGLISH, "He came for to see", "for_to_infinitive"), (HIBERNO_ENGLISH, "It is cold, so it is.", "so_it_is"), (AAVE, "She be working late", "habitual_be"), (AAVE, "He ain't here", "aint_negation"), (AAVE, "I'm finna go", "finna_future"),
        (INDIAN_ENGLISH, "I am knowing the answer", "progressive_stative"), (INDIAN_ENGLISH, "You are coming, isn't it?", "invariant_tag"), (INDIAN_ENGLISH, "hot hot tea", "reduplication"), (INDIAN_ENGLISH, "We discuss about it", "prepositional_variation"),
    ],
)
def test_features(spark, spec, text, feature):
    assert feature in run(spark, [text], lambda c: fd.features_found(c, spec))[0]


def test_feature_places(spark):
    text = "𝄞 I'm after going, and he is after leaving"
    got = run(spark, [text], lambda c: fd.feature_matches(c, HIBERNO_ENGLISH))[0]
    assert got and all(text[m["start_pos"] : m["end_pos"]] == m["matched_text"] for m in got)


def test_authenticity(spark):
    low, high, plain_ = run(spark, ["Begorrah, top o' the mornin to ye lassie and laddie!!!", "I'm after going, so I am, and she does be working", "nothing"], lambda c: fd.authenticity_score(c, HIBERNO_ENGLISH))
    assert low < 0.2 and high > 0.9 and plain_ == 0.7


def test_negative_lookahead(spark):
    assert run(spark, ["ye olde shop", "are ye well"], lambda c: fd.has_feature(c, (r"\bye\b(?!\s+olde)",))) == [False, True]


def test_specs(tmp_path):
    assert len(load_dialect("aave").features) == 12 and len(HIBERNO_ENGLISH.high_priority) == 3
    with pytest.raises(FileNotFoundError):
        load_dialect("nowhere")
    (tmp_path / "new.yaml").write_text("dialect_name: New\nfeatures:\n  a:\n    name: A\n    patterns: ['x+']\nprompts:\n  system: s\n")
    spec = load_dialect("new", str(tmp_path))
    assert spec.features[0].priority == "medium"
    with pytest.raises(ValueError):
        require_prompts(spec)
    (tmp_path / "bad.yaml").write_text("dialect_name: Bad\n")
    with pytest.raises(ValueError):
        load_dialect("bad", str(tmp_path))
    with pytest.raises(ValueError, match="authenticity"):
        load_dialect("new", str(tmp_path), judge=True)
    assert [d.code for d in prompt_dialects()] == ["aave", "hiberno_english", "indian_english"]
    (tmp_path / "bad.yaml").unlink()
    assert prompt_dialects(str(tmp_path)) == []
    assert all(len(require_prompts(d)) == 3 and "{text}" in d.prompts["user_template"] for d in prompt_dialects())


def test_mcnemar(spark):
    cases = [(0, 0), (3, 1), (10, 2), (24, 0), (40, 20), (1000, 1000)]
    p = run(spark, cases, lambda b, c: stats.mcnemar_p(b, c), "b bigint, c bigint")
    stat = run(spark, cases, lambda b, c: stats.mcnemar_statistic(b, c), "b bigint, c bigint")
    for (b, c), q in zip(cases, p):
        n = b + c
        if 0 < n < 25:
            assert q == pytest.approx(min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n))
    assert p[0] == 1.0 and stat[0] is None and stat[4] == pytest.approx(19**2 / 60) and p[4] == pytest.approx(1 - math.erf(math.sqrt(19**2 / 120)))


def test_cosine(spark):
    got = run(spark, [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 2.0]), ([1.0, 1.0], [1.0, 0.0])], stats.cosine_similarity, "a array<float>, b array<float>")
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] == pytest.approx(math.sqrt(0.5))


def test_file_names(spark):
    got = run(spark, ["audit_gsm8k_aave_m-1_20250102_030405.json", "audit_arc_challenge_indian_english_m_combined.json", "other.json"], labels.parse_audit_file)
    assert got[0]["stamp"] == "20250102030405" and got[1]["benchmark"] == "arc_challenge" and got[1]["combined"] and got[2] is None


def test_nulls(spark):
    for f in (grading.extract_numeric, grading.extract_choice, grading.detect_refusal, grading.normalize_answer, rewrite.clean_rewrite):
        assert run(spark, [(None,)], f) == [None]
