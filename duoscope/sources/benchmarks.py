"""Benchmark records of ten public datasets in one shape.

Each reader takes the dataset's raw rows with a column ``idx`` (the row's
position in the source) and gives id, question, answer, choices,
correct_choice, subject and metadata as JSON.  Limits follow the dataset: some
count source rows, some the rows that come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duoscope.functions import labels, regex
from duoscope.operators.positions import with_index  # noqa: F401

COLUMNS = ["idx", "id", "question", "answer", "choices", "correct_choice", "subject", "metadata"]

# Subjects, safety categories and areas of risk.
MMLU_SUBJECTS = [
    "abstract_algebra", "anatomy", "astronomy", "business_ethics", "clinical_knowledge", "college_biology", "college_chemistry", "college_computer_science", "college_mathematics", "college_medicine",
    "college_physics", "computer_security", "conceptual_physics", "econometrics", "electrical_engineering", "elementary_mathematics", "formal_logic", "global_facts", "high_school_biology",
    "high_school_chemistry", "high_school_computer_science", "high_school_european_history", "high_school_geography", "high_school_government_and_politics", "high_school_macroeconomics",
    "high_school_mathematics", "high_school_microeconomics", "high_school_physics", "high_school_psychology", "high_school_statistics", "high_school_us_history", "high_school_world_history",
    "human_aging", "human_sexuality", "international_law", "jurisprudence", "logical_fallacies", "machine_learning", "management", "marketing", "medical_genetics", "miscellaneous", "moral_disputes",
    "moral_scenarios", "nutrition", "philosophy", "prehistory", "professional_accounting", "professional_law", "professional_medicine", "professional_psychology", "public_relations",
    "security_studies", "sociology", "us_foreign_policy", "virology", "world_religions",
]
SORRY_CATEGORIES = [
    "hate_speech_generation", "harassment_bullying", "threats_intimidation", "discrimination", "violence_incitement", "self_harm_promotion", "illegal_activities", "fraud_scams", "malware_hacking",
    "weapons_dangerous_materials", "drug_abuse", "adult_content", "privacy_violations", "misinformation", "conspiracy_theories",
]
RISK_AREAS = ["Information Hazards", "Malicious Uses", "Discrimination, Exclusion, Toxicity, Hateful, Offensive", "Misinformation Harms", "Human-Chatbot Interaction Harms"]


def _shape(df: DataFrame, prefix: Column | str, **values: Column) -> DataFrame:
    """The common columns, missing ones null."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    types = {"question": "string", "answer": "string", "choices": "array<string>", "correct_choice": "int", "subject": "string", "metadata": "string"}
    cols = [values[c].cast(t).alias(c) if c in values else F.lit(None).cast(t).alias(c) for c, t in types.items()]
    return df.select(F.col("idx").cast("bigint").alias("idx"), F.concat(head, F.lit("_"), F.col("idx").cast("string")).alias("id"), *cols)


def _json(**values: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})


def _emitted(df: DataFrame, limit: int | None) -> DataFrame:
    """The first rows that come out, in source order."""
    return df if limit is None else df.orderBy("idx").limit(limit)


def _source(df: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of the source."""
    return df if limit is None else df.where(F.col("idx") < limit)


def gsm8k_answer(answer: Column) -> Column:
    """What stands behind the last ####, stripped, or null."""
    return F.when(F.contains(answer, F.lit("####")), regex.strip(F.substring_index(answer, "####", -1)))


def gsm8k(raw: DataFrame, split: str = "test", max_samples: int | None = None) -> DataFrame:
    """question, answer."""
    return _shape(_source(raw, max_samples), f"gsm8k_{split}", question=F.col("question"), answer=gsm8k_answer(F.col("answer")), metadata=_json(split=F.lit(split), full_answer=F.col("answer")))


def mmlu(raw: DataFrame, split: str = "test", subjects: list[str] | None = None, max_samples: int | None = None) -> DataFrame:
    """question, choices, answer (0-based), subject; the limit holds per subject, ids keep the source position."""
    df = raw if subjects is None else raw.where(F.col("subject").isin(subjects))
    if max_samples is not None:
        df = df.withColumn("_rank", F.row_number().over(Window.partitionBy("subject").orderBy("idx"))).where(F.col("_rank") <= max_samples).drop("_rank")
    return _shape(df, f"mmlu_{split}", question=F.col("question"), choices=F.col("choices"), correct_choice=F.col("answer"), subject=F.col("subject"), metadata=_json(split=F.lit(split)))


def sorry_bench(raw: DataFrame, split: str = "train", category: str | None = None, max_samples: int | None = None) -> DataFrame:
    """category, turns, question; the limit counts source rows before the category is looked at."""
    of = F.coalesce(F.col("category").cast("string"), F.lit("unknown"))
    df = _source(raw, max_samples).withColumn("_category", of)
    df = df if category is None else df.where(F.col("_category") == category)
    question = F.coalesce(F.try_element_at("turns", F.lit(1)), "question", F.lit(""))
    return _shape(df, f"sorry_bench_{split}", question=question, subject=F.col("_category"), metadata=_json(split=F.lit(split), category=F.col("_category")))


def arc(raw: DataFrame, split: str = "test", difficulty: str = "challenge", max_samples: int | None = None) -> DataFrame:
    """question, choices (text, label), answerKey: a label, else a number from 1 to 4, else the first choice."""
    at = F.array_position("choices.label", F.col("answerKey")) - 1
    numbered = F.try_element_at(F.create_map(*[F.lit(x) for i in range(4) for x in (str(i + 1), i)]), F.col("answerKey"))
    correct = F.when(at >= 0, at).otherwise(F.coalesce(numbered, F.lit(0)))
    meta = _json(difficulty=F.lit(difficulty), split=F.lit(split), answer_key=F.col("answerKey"))
    return _shape(_source(raw, max_samples), f"arc_{difficulty}_{split}", question=F.col("question"), choices=F.col("choices.text"), correct_choice=correct, subject=F.lit("science"), metadata=meta)


def hellaswag(raw: DataFrame, split: str = "validation", max_samples: int | None = None) -> DataFrame:
    """ctx, activity_label, endings, label (a number as text; anything else is null)."""
    label = F.when(F.col("label").rlike(r"^\s*[+-]?\d+\s*$"), F.trim("label").cast("int"))
    subject = F.coalesce("activity_label", F.lit("general"))
    meta = _json(split=F.lit(split), activity_label=subject)
    return _shape(_source(raw, max_samples), f"hellaswag_{split}", question=F.col("ctx"), choices=F.col("endings"), correct_choice=label, subject=subject, metadata=meta)


def realtoxicityprompts(raw: DataFrame, split: str = "train", max_samples: int | None = None, min_toxicity: float = 0.0, max_toxicity: float = 1.0) -> DataFrame:
    """prompt (text, toxicity), continuation; blank prompts are left out, unknown toxicity passes."""
    tox = F.col("prompt.toxicity")
    keep = ~labels.blank(F.col("prompt.text")) & (tox.isNull() | tox.between(min_toxicity, max_toxicity))
    df = _emitted(raw.where(keep), max_samples)
    meta = _json(split=F.lit(split), toxicity=tox, continuation=F.col("continuation.text"))
    return _shape(df, f"rtp_{split}", question=F.col("prompt.text"), subject=F.lit("toxicity"), metadata=meta)


def boolq(raw: DataFrame, split: str = "validation", max_samples: int | None = None) -> DataFrame:
    """passage, question, answer (boolean)."""
    question = F.concat("passage", F.lit("\n\nQuestion: "), "question")
    return _shape(
        _source(raw, max_samples), f"boolq_{split}", question=question, answer=F.when(F.col("answer"), "Yes").otherwise("No"), choices=F.array(F.lit("Yes"), F.lit("No")), correct_choice=F.when(F.col("answer"), 0).otherwise(1),
        subject=F.lit("reading_comprehension"), metadata=_json(split=F.lit(split)),
    )


def donotanswer(raw: DataFrame, split: str = "train", risk_area: str | None = None, max_samples: int | None = None) -> DataFrame:
    """risk_area, question, types_of_harm, specific_harms; blank questions are left out."""
    area = F.coalesce("risk_area", F.lit("unknown"))
    df = raw.withColumn("_area", area)
    df = df if risk_area is None else df.where(F.col("_area") == risk_area)
    df = _emitted(df.where(~labels.blank(F.col("question"))), max_samples)
    return _shape(df, f"donotanswer_{split}", question=F.col("question"), subject=F.col("_area"), metadata=_json(split=F.lit(split), types_of_harm=F.col("types_of_harm"), specific_harms=F.col("specific_harms")))


def toxigen(raw: DataFrame, split: str = "train", max_samples: int | None = None, min_toxicity: float = 0.0) -> DataFrame:
    """text, toxicity_human, target_group; blank texts are left out, unknown toxicity passes."""
    tox = F.col("toxicity_human")
    df = _emitted(raw.where(~labels.blank(F.col("text")) & (tox.isNull() | (tox >= min_toxicity))), max_samples)
    return _shape(df, f"toxigen_{split}", question=F.col("text"), subject=F.coalesce("target_group", F.lit("unknown")), metadata=_json(split=F.lit(split), toxicity_human=tox))


def truthfulqa(raw: DataFrame, split: str = "validation", max_samples: int | None = None) -> DataFrame:
    """question, mc1_targets (choices, labels), category; rows without a true choice are left out.

    Of more than four choices the true one and the first three others stay, in
    their order.
    """
    df = _source(raw, max_samples).withColumn("_true", (F.array_position("mc1_targets.labels", F.lit(1)) - 1).cast("int")).where("_true >= 0")
    others = F.slice(F.filter(F.sequence(F.lit(0), F.size("mc1_targets.choices") - 1), lambda i: i != F.col("_true")), 1, 3)
    picked = F.array_sort(F.concat(others, F.array("_true")))
    many = F.size("mc1_targets.choices") > 4
    choices = F.when(many, F.transform(picked, lambda i: F.element_at("mc1_targets.choices", i + 1))).otherwise(F.col("mc1_targets.choices"))
    correct = F.when(many, F.array_position(picked, F.col("_true")) - 1).otherwise(F.col("_true"))
    return _shape(df, f"truthfulqa_{split}", question=F.col("question"), choices=choices, correct_choice=correct, subject=F.lit("truthfulness"), metadata=_json(split=F.lit(split), category=F.coalesce("category", F.lit(""))))


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "gsm8k": gsm8k, "mmlu": mmlu, "sorry_bench": sorry_bench, "arc": arc, "hellaswag": hellaswag, "realtoxicityprompts": realtoxicityprompts, "boolq": boolq, "donotanswer": donotanswer, "toxigen": toxigen, "truthfulqa": truthfulqa,
}


def load(name: str, raw: DataFrame, **options: object) -> DataFrame:
    """A dataset by name, in any case; ValueError lists the names."""
    if name.lower() not in REGISTRY:
        raise ValueError(f"unknown benchmark {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name.lower()](raw, **options)


def is_multiple_choice(df: DataFrame) -> DataFrame:
    """Adds whether a record has choices."""
    return df.withColumn("is_multiple_choice", F.coalesce(F.size("choices") > 0, F.lit(False)))


def filter_by_subject(df: DataFrame, subject: str) -> DataFrame:
    """Records of one subject; a null subject is none."""
    return df.where(F.col("subject") == subject)


def subset(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """n records without replacement, the same ones for the same seed: the smallest keyed hashes."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def dimension(spark: SparkSession, names: list[str], column: str) -> DataFrame:
    """A fixed list as a table with positions from 0."""
    return spark.createDataFrame(list(enumerate(names)), f"position int, {column} string")
