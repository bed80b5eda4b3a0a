"""Names for people, names of files, and shades of table cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duoscope.functions import regex

# Display names and orders.
BENCHMARK_LABELS = {
    "gsm8k": "GSM8K", "arc_challenge": "ARC Challenge", "hellaswag": "HellaSwag", "mmlu": "MMLU", "boolq": "BoolQ", "truthfulqa": "TruthfulQA",
    "realtoxicityprompts": "RealToxicity", "donotanswer": "DoNotAnswer", "toxigen": "ToxiGen",
}
MODEL_LABELS = {"qwen2.5:14b": "Qwen 2.5 14B", "qwen2.5:7b": "Qwen 2.5 7B", "llama3.1:8b": "Llama 3.1 8B", "gemma2:9b": "Gemma 2 9B", "mistral:7b": "Mistral 7B"}
#: Folders of models that tables over all models read, in their order.
MODEL_FOLDERS = ["qwen2.5_14b", "qwen2.5_7b", "gemma2_9b", "llama3.1_8b", "mistral_7b"]
DIALECT_LABELS = {"hiberno_english": "Hiberno-English", "aave": "AAVE", "indian_english": "Indian English"}
ACCURACY_BENCHMARKS = ["gsm8k", "arc_challenge", "hellaswag", "mmlu", "boolq", "truthfulqa"]
TOXICITY_BENCHMARKS = ["realtoxicityprompts", "donotanswer", "toxigen"]
DIALECT_ORDER = ["hiberno_english", "indian_english", "aave"]
#: Names of result files: of one run, and of combined shards.
AUDIT_FILE = r"^audit_(.+?)_(hiberno_english|indian_english|aave)_(.+)_(\d{8})_(\d{6})\.json$"
COMBINED_FILE = r"^audit_(.+?)_(hiberno_english|indian_english|aave)_(.+)_combined\.json$"
#: A stamp later than any other, for combined files.
COMBINED_STAMP = "99999999999999"


def label(value: Column, names: dict[str, str]) -> Column:
    """The display name, or the value itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value), value)


def title_case(value: Column) -> Column:
    """Underscores as blanks, words capitalised."""
    return F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))


def model_safe(model: Column) -> Column:
    """A model's name as part of a file name."""
    return F.translate(model, ":/", "__")


def audit_file_name(benchmark: Column, dialect: Column, model: Column, stamp: Column) -> Column:
    """audit_{benchmark}_{dialect}_{model}_{stamp}.json"""
    return F.concat(F.lit("audit_"), benchmark, F.lit("_"), dialect, F.lit("_"), model_safe(model), F.lit("_"), stamp, F.lit(".json"))


def parse_audit_file(name: Column) -> Column:
    """struct(benchmark, dialect, model, stamp, combined) of a file name, or null."""
    part = lambda p, i: F.regexp_extract(name, p, i)
    combined = name.rlike(COMBINED_FILE)
    struct = lambda p, stamp, c: F.struct(part(p, 1).alias("benchmark"), part(p, 2).alias("dialect"), part(p, 3).alias("model"), stamp.alias("stamp"), F.lit(c).alias("combined"))
    return F.when(combined, struct(COMBINED_FILE, F.lit(COMBINED_STAMP), True)).when(
        name.rlike(AUDIT_FILE), struct(AUDIT_FILE, F.concat(part(AUDIT_FILE, 4), part(AUDIT_FILE, 5)), False)
    )


def order_of(value: Column, order: list[str]) -> Column:
    """Position in a fixed order, unknown values last."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), value)
    return F.when(at > 0, at).otherwise(F.lit(len(order) + 1))


def cell_shade(value: Column, reference: Column) -> Column:
    """How far a value is from its reference, as a share of it, half of it counting as full: 0 to 1; 0 without reference."""
    return F.when(reference == 0, 0.0).otherwise(F.least(F.abs(value - reference) / reference, F.lit(0.5)) / 0.5)


def cell_hue(value: Column, reference: Column) -> Column:
    """blue above the reference, orange otherwise, grey without one."""
    return F.when(reference == 0, "grey").when(value > reference, "blue").otherwise("orange")


def norm_shade(value: Column, low: Column, high: Column) -> Column:
    """Position of a value between two others; one half if they are equal."""
    return F.when(high == low, 0.5).otherwise((value - low) / (high - low))


def ramp(shade: Column, low: tuple[float, float, float], high: tuple[float, float, float]) -> list[Column]:
    """Red, green and blue, 0 to 1, of a shade between two colours."""
    return [F.lit(a) + (F.lit(b) - F.lit(a)) * shade for a, b in zip(low, high)]


def text_contrast(red: Column, green: Column, blue: Column) -> Column:
    """The colour of text on a cell: dark on cells whose luminance is above 0.45, white on others."""
    # Weights of luminance, its bound and the two colours.
    luminance = 0.299 * red + 0.587 * green + 0.114 * blue
    return F.when(luminance > 0.45, "#1a1a1a").otherwise("#FFFFFF")


def percent(value: Column) -> Column:
    """A share as a signless percentage with one decimal."""
    return F.format_string("%.1f%%", value * 100)


def blank(text: Column) -> Column:
    """Whether a text is null or white space only."""
    return F.coalesce(F.length(regex.strip(text)) == 0, F.lit(True))
