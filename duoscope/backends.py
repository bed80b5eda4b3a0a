"""Language models behind two small protocols, and the runs that use them.

A client is made once per worker.  Model calls happen in one ``mapInPandas``
stage whose result is checkpointed before anything branches off it, so that no
action asks a model twice.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.functions import rewrite
from duoscope.operators import audit, generation, validation
from duoscope.runtime import materialize
from duoscope.specs.dialects import DIALECTS, Dialect, require_prompts


class Client(Protocol):
    """Answers a prompt, with an optional system message."""

    def ask(self, prompt: str, system: str | None = None) -> str: ...


class Echo:
    """Deterministic stand-in: marks rewrites, and answers the first choice or the last number."""

    def ask(self, prompt: str, system: str | None = None) -> str:
        import re

        if system:
            return "Sure, " + prompt.rsplit("\n", 1)[-1]
        if "Answer with the letter" in prompt:
            return "The answer is A"
        numbers = re.findall(r"\d+", prompt)
        return f"#### {numbers[-1]}" if numbers else "I cannot say."


class HttpChat:
    """A chat endpoint with the usual JSON: {model, messages, temperature} to choices[0].message.content."""

    def __init__(self, url: str, model: str, key: str = "", temperature: float = 0.0, max_tokens: int = 1024, timeout: float = 120.0):
        self.url, self.model, self.key, self.temperature, self.max_tokens, self.timeout = url, model, key, temperature, max_tokens, timeout

    def ask(self, prompt: str, system: str | None = None) -> str:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        body = json.dumps({"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]


@dataclass
class HttpCompletion:
    """A local server that completes a prompt: POST of model, system, prompt and options, answer under ``response``."""

    url: str
    model: str
    temperature: float = 0.3
    max_tokens: int = 1024
    timeout: float = 120.0

    def ask(self, prompt: str, system: str | None = None) -> str:
        body = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": self.temperature, "num_predict": self.max_tokens}} | ({"system": system} if system else {})
        request = urllib.request.Request(f"{self.url.rstrip('/')}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["response"]


def list_models(url: str, timeout: float = 10.0) -> list[str]:
    """Names of the models of a completion server; empty if it can't be reached."""
    try:
        with urllib.request.urlopen(f"{url.rstrip('/')}/api/tags", timeout=timeout) as reply:
            return sorted(m["name"] for m in json.load(reply).get("models", []))
    except (OSError, ValueError, KeyError):
        return []


BACKENDS: dict[str, Callable[..., Client]] = {"echo": Echo, "http": HttpChat, "completion": HttpCompletion}


def make_client(backend: str, **options: object) -> Callable[[], Client]:
    """A factory for workers; ValueError for an unknown backend."""
    if backend not in BACKENDS:
        raise ValueError(f"unsupported backend {backend}; there are {', '.join(sorted(BACKENDS))}")
    return lambda: BACKENDS[backend](**options)


def health(client: Callable[[], Client]) -> bool:
    """Whether a model answers at all."""
    try:
        return bool(client().ask("Say yes.") is not None)
    except Exception:
        return False


def rewrite_all(samples: DataFrame, dialect: Dialect, client: Callable[[], Client], attempts: int = 3, parallel: int | None = None, rounds: int = 3) -> DataFrame:
    """(id, original) with the model's rewrite or the error after the last attempt; ``parallel`` bounds concurrent calls.

    A rewrite that is cleaned and found invalid is asked for again, up to
    ``rounds`` times; each round reads only the rows that are still without one.
    """
    done, left = None, samples
    for turn in range(rounds):
        got = materialize(_rewrite_once(left, dialect, client, attempts, parallel))
        last = turn == rounds - 1
        part = got if last else got.where("error is null")
        done = part if done is None else done.unionByName(part)
        left = got.where("error is not null").select(*samples.columns)
        if last or left.isEmpty():
            break
    return done


def _rewrite_once(samples: DataFrame, dialect: Dialect, client: Callable[[], Client], attempts: int, parallel: int | None) -> DataFrame:
    prompts = require_prompts(dialect)
    system, template = prompts["system"], prompts["user_template"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for pdf in batches:
            out, errors = [], []
            for text in pdf["original"]:
                got, error = None, None
                for _ in range(attempts):
                    try:
                        got, error = model.ask(template.replace("{text}", text or ""), system), None
                    except Exception as e:  # the call is an effect outside: every failure is data
                        error = f"{type(e).__name__}: {e}"
                    if got:
                        break
                out.append(got)
                errors.append(error)
            yield pdf.assign(raw=out, error=errors)

    df = samples if parallel is None else samples.repartition(parallel)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema.fields], "raw string", "error string"])
    asked = materialize(df.mapInPandas(run, schema))
    cleaned = asked.withColumn("transformed", rewrite.clean_rewrite(F.col("raw")))
    reason = rewrite.invalid_reason(F.col("transformed"), F.col("original"))
    return cleaned.withColumn("error", F.coalesce("error", reason)).withColumn("transformed", F.when(F.col("error").isNull(), F.col("transformed"))).drop("raw")


def generate(samples: DataFrame, dialect: Dialect, client: Callable[[], Client], thresholds: validation.Thresholds = validation.Thresholds(), parallel: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rewrites a benchmark: (valid pairs, failed pairs, counts)."""
    made = rewrite_all(samples.withColumnRenamed("question", "original") if "original" not in samples.columns else samples, dialect, client, parallel=parallel).withColumn("dialect", F.lit(dialect.code))
    checked = materialize(validation.validate_pairs(made.where("error is null"), thresholds, dialects={**DIALECTS, dialect.code: dialect}))
    every = checked.select("id", "dialect", "status").unionByName(made.where("error is not null").select("id", "dialect", F.lit(None).cast("string").alias("status")))
    return checked.where("status = 'passed'"), checked.where("status <> 'passed'"), generation.counts(every, ["dialect"])


def run_audit(pairs: DataFrame, model_name: str, client: Callable[[], Client], parallel: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Asks both prompts of every pair: (graded rows, summary per benchmark and dialect)."""
    prepared = audit.prepare(pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for pdf in batches:
            rows = []
            for o, t in zip(pdf["original_prompt"], pdf["transformed_prompt"]):
                try:
                    rows.append((model.ask(o), model.ask(t), None))
                except Exception as e:
                    rows.append(("", "", f"{type(e).__name__}: {e}"))
            yield pdf.assign(original_response=[r[0] for r in rows], transformed_response=[r[1] for r in rows], error=[r[2] for r in rows])

    df = prepared if parallel is None else prepared.repartition(parallel)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in prepared.schema.fields], "original_response string", "transformed_response string", "error string"])
    asked = materialize(df.mapInPandas(run, schema)).withColumn("model", F.lit(model_name))
    graded = audit.grade(asked)
    return graded, audit.confusion(graded, ["model", "benchmark", "dialect"])
