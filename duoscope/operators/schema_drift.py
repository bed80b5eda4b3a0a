"""Schemas that drift between files (problem 2).

The header of every file (its fields and their types, not its values) is read
in parallel.  Types are folded through a promotion lattice into the union
schema, undeclared fields are matched with missing declared ones, files are
cast to the union schema, and the differences are logged per file in order.

A field that isn't declared stands in for a missing one if three kinds of
evidence agree: the names share word stems, the values fit the declared
content, and over all files the one is there when the other isn't.  The last
is counted over the whole corpus, so that ``judge_model`` isn't taken for a
missing ``model`` only because their values look alike.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from duoscope.runtime import materialize

#: Share of the files with an undeclared field in which the declared one must be missing.
EXCLUSIVE = 0.7
#: The same where at least half of the stems agree.
EXCLUSIVE_ALIKE = 0.4
#: Least mean fit of the values, and least combined score, of a stand-in.
LEAST_FIT, LEAST_SCORE = 0.3, 0.42

#: Names that stand in for others, over all kinds, that the driver will hold.
MAX_NAMES = 100_000

_HEADER = "file_id bigint, doc_kind string, unit int, container string, role string, name string, other string, otype string, fits boolean, fit double"

# Stems of field names that mean the same.
_STEMS = {
    "acc": "accuracy", "auth": "authenticity", "authentic": "authenticity", "avg": "mean", "bench": "benchmark", "cnt": "count", "created": "time",
    "date": "time", "datetime": "time", "description": "name", "diff": "gap", "difference": "gap", "delta": "gap", "err": "error", "eval": "benchmark", "exception": "error",
    "fail": "failed", "failing": "failed", "failure": "failed", "feat": "feature", "fraction": "rate", "gen": "generation", "generated": "generation",
    "identifier": "id", "invalid": "failed", "item": "pair", "key": "id", "kind": "type", "merged": "combined", "n": "count", "num": "count", "number": "count",
    "at": "time", "orig": "original", "pct": "rate", "percent": "rate", "ratio": "rate", "record": "pair", "rejected": "failed", "row": "pair", "sample": "pair",
    "sem": "semantic", "share": "rate", "similarity": "score", "stamp": "time", "success": "successful", "succeeded": "successful", "task": "benchmark", "timestamp": "time", "total": "count",
    "trans": "transformed", "transform": "transformed", "ts": "time", "uid": "id", "uuid": "id", "val": "valid", "validation": "valid", "validator": "valid", "passed": "valid", "pass": "valid",
    "audited": "audit", "sae": "original", "variety": "dialect", "llm": "model", "engine": "model", "when": "time", "of": "", "from": "", "the": "", "in": "",
}
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def stems(name: str) -> set[str]:
    """Word stems of a field name in any of the usual spellings."""
    out = set()
    for w in _PART.findall(name):
        w = w.lower()
        w = _STEMS.get(w) if w in _STEMS else w
        if w and w.endswith("s") and len(w) > 3:
            w = _STEMS.get(w[:-1], w[:-1])
        if w:
            out.add(w)
    return out


def name_similarity(a: str, b: str) -> float:
    """1 for spellings of the same name, else the share of stems in common."""
    if re.sub(r"[^a-z0-9]", "", a.lower()) == re.sub(r"[^a-z0-9]", "", b.lower()):
        return 1.0
    x, y = stems(a), stems(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def type_of(v: object) -> str:
    """Type of a JSON value, in the catalogue's terms."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "long"
    if isinstance(v, float):
        return "double"
    if isinstance(v, str):
        return "string"
    if isinstance(v, list):
        inner = {type_of(x) for x in v} - {"null"}
        return f"array<{_fold(inner) or 'null'}>"
    inner = {type_of(x) for x in v.values()} - {"null"}
    return "map<string,long>" if inner <= {"long"} else "struct"


#: The lattice above the scalar types: what two types are promoted to; everything else meets in string (its JSON text).
PROMOTION = {
    frozenset({"long", "double"}): "double", frozenset({"boolean", "long"}): "string", frozenset({"map<string,long>", "struct"}): "struct",
    frozenset({"array<null>", "array<string>"}): "array<string>", frozenset({"array<null>", "array<struct>"}): "array<struct>", frozenset({"array<null>", "array<long>"}): "array<long>",
    frozenset({"array<map<string,long>>", "array<struct>"}): "array<struct>",
}


def promote(a: str, b: str) -> str:
    """Least upper bound of two types."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    return PROMOTION.get(frozenset({a, b}), "string")


def _fold(types: set[str]) -> str:
    out = "null"
    for t in sorted(types):
        out = promote(out, "struct" if t == "map<string,long>" else t)
    return "" if out == "null" else out


def fits(v: object, declared: str) -> bool:
    """Whether a value that isn't null is of the declared type; whole numbers fit double, no fraction fits long."""
    if declared == "string":
        return isinstance(v, str)
    if declared == "long":
        return isinstance(v, int) and not isinstance(v, bool)
    if declared == "double":
        return isinstance(v, int | float) and not isinstance(v, bool)
    if declared == "array<string>":
        return isinstance(v, list) and all(x is None or isinstance(x, str) for x in v)
    if declared == "array<struct>":
        return isinstance(v, list) and all(x is None or isinstance(x, dict) for x in v)
    if declared == "map<string,long>":
        return isinstance(v, dict) and all(x is None or fits(x, "long") for x in v.values())
    return False


def _parse(payload: str | None) -> object:
    def no(_: str) -> None:
        raise ValueError("not JSON")

    return json.loads(payload, parse_constant=no)


_TIME = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d")


def _plain(v: object) -> object:
    """The scalar inside a wrapping of one: [x], {"value": x}, "12", "95.6%"."""
    if isinstance(v, list) and len(v) == 1:
        return _plain(v[0])
    if isinstance(v, dict) and len(v) <= 2 and v:
        return _plain(next(iter(v.values())))
    if isinstance(v, str):
        t = v.strip()
        try:
            return float(t[:-1]) / 100 if t.endswith("%") else int(t)
        except ValueError:
            try:
                return float(t)
            except ValueError:
                return v
    return v


def content_fit(v: object, declared: str, name: str, below: list[str]) -> float:
    """How well a value, in whatever type, could be the content of a declared field: 0 to 1."""
    if v is None:
        return 0.5
    if declared == "array<struct>":
        if isinstance(v, int) and not isinstance(v, bool):
            return 0.4
        text = v if isinstance(v, str) else json.dumps(v)
        hit = sum(re.sub(r"[^a-z]", "", b) in re.sub(r"[^a-z]", "", text.lower()) for b in below)
        return 1.0 if hit >= 2 or v == [] else 0.6 if isinstance(v, list | str) and re.search(r"_\d+", text) else 0.2
    if declared == "map<string,long>":
        x = v
        if isinstance(v, str):
            try:
                x = json.loads(v)
            except ValueError:
                return 0.1
        if isinstance(x, dict):
            return 1.0 if all(fits(y, "long") for y in x.values()) else 0.2
        return 0.7 if isinstance(x, list) and x and all(isinstance(y, list | dict) for y in x) else 0.2
    if declared == "array<string>":
        return 1.0 if fits(v, declared) else 0.6 if isinstance(v, str | int) and not isinstance(v, bool) else 0.2
    x = _plain(v)
    if isinstance(x, bool):
        return 0.1
    number = isinstance(x, int | float)
    if declared in ("long", "double"):
        if not number:
            # a list of what was counted before
            return 0.5 if isinstance(v, list) and declared == "long" else 0.0
        if declared == "long":
            return 1.0 if float(x).is_integer() else 0.1
        return 1.0 if -1.0 <= x <= 1.0 else 0.4 if -100 <= x <= 100 else 0.1
    if stems(name) & {"time"}:
        if isinstance(x, str):
            return 1.0 if _TIME.match(x) else 0.0
        return 0.9 if number and x > 1e9 else 0.0
    if number:
        return 0.3
    return 0.8 if isinstance(x, str) and len(x) < 200 else 0.2


def _declared(catalog: DataFrame) -> list[dict]:
    """The declared fields, in order of their paths: the catalogue is written by hand and short."""
    fields = catalog.select("doc_kind", "field_path", "field_type", "is_optional").distinct().limit(MAX_NAMES + 1).collect()
    if len(fields) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} declared fields")
    return sorted((r.asDict() for r in fields), key=lambda c: (c["doc_kind"], c["field_path"]))


def headers(files: DataFrame, catalog: list[dict]) -> DataFrame:
    """One row per file, object and field: present, missing or undeclared, with each possible stand-in.

    ``unit`` is -1 for the document and the element's position below
    failed_pairs, whose name as written is ``container``.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top: dict[str, dict[str, str]] = {}
        sub: dict[str, dict[str, dict[str, str]]] = {}
        for c in catalog:
            path, _, leaf = c["field_path"].partition(".")
            if leaf:
                sub.setdefault(c["doc_kind"], {}).setdefault(path, {})[leaf] = c["field_type"]
            else:
                top.setdefault(c["doc_kind"], {})[path] = c["field_type"]

        def unit_rows(head: tuple, declared: dict[str, str], obj: dict, below: dict[str, dict[str, str]]) -> list[tuple]:
            rows = []
            missing = [d for d in declared if d not in obj]
            extra = [u for u in obj if u not in declared]
            for d in declared:
                if d in obj:
                    v = obj[d]
                    rows.append((*head, "key", d, None, type_of(v), v is None or fits(v, declared[d]), 1.0))
                else:
                    rows.append((*head, "missing", d, None, None, None, None))
            for u in extra:
                rows.append((*head, "extra", u, None, type_of(obj[u]), None, None))
            for u, d in product(extra, missing):
                v = obj[u]
                rows.append((*head, "pair", u, d, type_of(v), v is None or fits(v, declared[d]), content_fit(v, declared[d], d, list(below.get(d, {})))))
            return rows

        columns = [c.split()[0] for c in _HEADER.split(", ")]
        for pdf in batches:
            rows: list[tuple] = []
            for file_id, kind, payload in zip(pdf["file_id"], pdf["doc_kind"], pdf["payload"]):
                if kind not in top or payload is None:
                    continue
                try:
                    doc = _parse(payload)
                except (ValueError, RecursionError):
                    continue
                doc = doc if isinstance(doc, dict) else {}
                below = sub.get(kind, {})
                rows += unit_rows((file_id, kind, -1, None), top[kind], doc, below)
                for path, declared in below.items():
                    for name in [path] if path in doc else [u for u in doc if u not in top[kind]]:
                        v = doc[name]
                        if isinstance(v, list) and v and all(x is None or isinstance(x, dict) for x in v):
                            for i, x in enumerate(v):
                                if x is not None:
                                    rows += unit_rows((file_id, kind, i, name), declared, x, {})
            yield pd.DataFrame(rows, columns=columns)

    return files.select("file_id", "doc_kind", "payload").mapInPandas(read, _HEADER)


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([name_similarity(x, y) for x, y in zip(a, b)])


def _level() -> Column:
    return (F.col("unit") >= 0).alias("nested")


def stand_ins(head: DataFrame) -> DataFrame:
    """Scores of (doc_kind, nested, name, other): how likely the undeclared name stands in for the declared one."""
    h = head.withColumn("nested", _level())
    units = h.groupBy("doc_kind", "nested").agg(F.count_distinct("file_id", F.coalesce("container", F.lit("")), "unit").alias("units"))
    with_u = h.where("role = 'extra'").groupBy("doc_kind", "nested", "name").agg(F.count("*").alias("n_u"))
    without_d = h.where("role = 'missing'").groupBy("doc_kind", "nested", F.col("name").alias("other")).agg(F.count("*").alias("n_d"))
    pairs = h.where("role = 'pair'").groupBy("doc_kind", "nested", "name", "other").agg(F.count("*").alias("n_both"), F.avg("fit").alias("fit"))
    joined = pairs.join(with_u, ["doc_kind", "nested", "name"]).join(without_d, ["doc_kind", "nested", "other"]).join(units, ["doc_kind", "nested"])
    base = F.greatest((F.col("n_d") - F.col("n_both")) / F.greatest(F.col("units") - F.col("n_u"), F.lit(1)), F.lit(0.01))
    return (
        joined.withColumn("alike", _similarity("name", "other"))
        .withColumn("exclusive", F.col("n_both") / F.col("n_u"))
        .withColumn("evidence", F.least(F.lit(1.0), -F.log(F.least(base, F.lit(1.0))) * F.col("n_both") / 10) * (F.col("exclusive") >= EXCLUSIVE).cast("double"))
        .withColumn("score", 0.45 * F.col("alike") + 0.3 * F.col("fit") + 0.25 * F.col("evidence"))
        .withColumn(
            "stands_in",
            (F.col("score") >= LEAST_SCORE)
            & (F.col("fit") >= LEAST_FIT)
            & ((F.col("alike") >= 0.99) | ((F.col("exclusive") >= F.when(F.col("alike") >= 0.5, EXCLUSIVE_ALIKE).otherwise(EXCLUSIVE)) & ((F.col("alike") >= 0.3) | ((F.col("evidence") >= 1.0) & (F.col("exclusive") >= 0.95) & (F.col("fit") >= 0.8))))),
        )
    )


def changes(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every file's differences from the catalogue: file_id, doc_kind, field, change, written_as, observed_type.

    ``change`` is added, renamed, removed or type_changed.  Payloads that
    aren't JSON, null payloads and kinds without declared fields give no row; a
    payload that is JSON but no object lacks every field.  Null values are no
    change.  Repeated files give their rows each.
    """
    listed = _declared(catalog)
    head = materialize(headers(files, listed))
    score = stand_ins(head).where("stands_in").select("doc_kind", "nested", "name", "other", "score")
    in_unit = ["file_id", "doc_kind", "unit", "container"]
    pairs = head.where("role = 'pair'").withColumn("nested", _level()).join(score, ["doc_kind", "nested", "name", "other"])
    spot = [F.col("file_id"), F.col("unit"), F.coalesce("container", F.lit(""))]
    best = (
        pairs.withColumn("by_u", F.row_number().over(Window.partitionBy(*spot, "name").orderBy(F.desc("score"), F.desc("fit"), "other")))
        .withColumn("by_d", F.row_number().over(Window.partitionBy(*spot, "other").orderBy(F.desc("score"), F.desc("fit"), "name")))
        .where("by_u = 1 and by_d = 1")
        .select(*in_unit, "name", F.col("other").alias("declared"), "otype", "fits")
    )
    best = materialize(best)
    declared = catalog.sparkSession.createDataFrame(
        [(c["doc_kind"], c["field_path"], c["is_optional"]) for c in listed], "doc_kind string, path string, is_optional boolean"
    )
    nests = {c["field_path"].partition(".")[0] for c in listed if "." in c["field_path"]}
    nest = F.lit(next(iter(nests), ""))
    path = lambda c: F.when(F.col("unit") >= 0, F.concat(nest, F.lit("."), F.col(c))).otherwise(F.col(c))

    same_spot = lambda a, b: [F.col(f"{a}.file_id") == F.col(f"{b}.file_id"), F.col(f"{a}.unit") == F.col(f"{b}.unit"), F.col(f"{a}.container").eqNullSafe(F.col(f"{b}.container"))]
    renamed = best.select(*in_unit, path("declared").alias("field"), F.lit("renamed").alias("change"), path("name").alias("written_as"), "otype")
    retyped = best.where("not fits").select(*in_unit, path("declared").alias("field"), F.lit("type_changed").alias("change"), path("name").alias("written_as"), "otype")
    wrong = head.where("role = 'key' and not fits").select(*in_unit, path("name").alias("field"), F.lit("type_changed").alias("change"), path("name").alias("written_as"), "otype")
    added = (
        head.where("role = 'extra'").alias("h").join(best.alias("b"), [*same_spot("h", "b"), F.col("h.name") == F.col("b.name")], "left_anti")
        .select(*in_unit, path("name").alias("field"), F.lit("added").alias("change"), path("name").alias("written_as"), "otype")
    )
    removed = (
        head.where("role = 'missing'").alias("h").join(best.alias("b"), [*same_spot("h", "b"), F.col("h.name") == F.col("b.declared")], "left_anti")
        .select(*in_unit, path("name").alias("field"), F.lit("removed").alias("change"), F.lit(None).cast("string").alias("written_as"), F.lit(None).cast("string").alias("otype"))
        .join(F.broadcast(declared.where("not is_optional").withColumnRenamed("path", "field").select("doc_kind", "field")), ["doc_kind", "field"])
        .select(*in_unit, "field", "change", "written_as", "otype")
    )
    every = renamed.unionByName(retyped).unionByName(wrong).unionByName(added).unionByName(removed)
    # elements count only in the list that is failed_pairs, by its own or another name, and has its type
    lists = (
        head.where("role = 'key' and unit = -1 and fits").select("file_id", F.col("name").alias("container"), F.col("name").alias("declared"))
        .unionByName(best.where("unit = -1 and fits").select("file_id", F.col("name").alias("container"), "declared"))
        .where(F.col("declared") == nest).select("file_id", "container")
    )
    nested = every.where("unit >= 0").join(lists, ["file_id", "container"], "left_semi")
    out = every.where("unit = -1").unionByName(nested)
    return out.groupBy("file_id", "doc_kind", "field", "change").agg(F.min("written_as").alias("written_as"), F.min("otype").alias("observed_type"))


def found(files: DataFrame, catalog: DataFrame) -> DataFrame:
    return changes(files, catalog).select("file_id", "field", "change")


def change_log(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """All changes with the file's name and landing time and its position in its kind's history."""
    log = materialize(changes(files, catalog).join(files.select("file_id", "file_name", "landed_at"), "file_id"))
    same = ["doc_kind", "field", "change", "written_as", "observed_type"]
    first = log.groupBy(*same).agg(F.min("landed_at").alias("first_landed_at")).select(*[F.col(c).alias(f"_{c}") for c in same], "first_landed_at")  # a row per spelling and type
    return log.join(first, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]).drop(*[f"_{c}" for c in same])


@F.pandas_udf(StringType())
def _promoted(types: pd.Series) -> pd.Series:
    return pd.Series([_fold(set(t)) or "null" for t in types])


def union_schema(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """The lattice's fold per kind and field as written: types seen, promoted type, files that have it."""
    listed = _declared(catalog)
    head = headers(files, listed).where("role in ('key', 'extra')")
    field = F.when(F.col("unit") >= 0, F.concat_ws(".", "container", "name")).otherwise(F.col("name")).alias("field")
    seen = head.groupBy("doc_kind", field).agg(
        F.array_sort(F.collect_set("otype")).alias("types"), F.count_distinct("file_id").alias("files"), F.bool_or(F.col("role") == "key").alias("declared")
    )
    return seen.withColumn("promoted", _promoted("types"))


def _cast(v: object, declared: str) -> object:
    """A value cast to the declared type, or None if it has no such content."""
    if v is None:
        return None
    if fits(v, declared):
        return float(v) if declared == "double" else v
    if declared == "string":
        x = _plain(v)
        if isinstance(x, bool) or isinstance(v, list) and len(v) != 1:
            return json.dumps(v)
        return x if isinstance(x, str) else json.dumps(x)
    if declared in ("long", "double"):
        x = _plain(v)
        if isinstance(x, int | float) and not isinstance(x, bool):
            return float(x) if declared == "double" else int(x) if float(x).is_integer() else None
        return len(v) if isinstance(v, list) and declared == "long" else None
    if isinstance(v, str):
        try:
            return _cast(json.loads(v), declared)
        except ValueError:
            return [x.strip() for x in v.split(",")] if declared == "array<string>" else None
    if declared == "array<struct>":
        if isinstance(v, dict):
            return [{"id": k, **x} for k, x in v.items() if isinstance(x, dict)] or _cast(v.get("items"), declared)
        return [x if isinstance(x, dict) else {"id": x} for x in v] if isinstance(v, list) else None
    if declared == "map<string,long>" and isinstance(v, list):
        pairs = [list(x.values()) if isinstance(x, dict) else x for x in v]
        try:
            return {str(k): int(n) for k, n in pairs}
        except (TypeError, ValueError):
            return None
    return None


def unify(files: DataFrame, catalog: DataFrame, kind: str) -> DataFrame:
    """All files of a kind as one table in the declared schema.

    Values under other names are put back, values of other types are cast where
    they hold such a value (``"12"``, ``[12]``, ``{"value": 12}``, ``"96.3%"``,
    a list that was counted before) and are null otherwise; undeclared fields
    are kept as JSON text in ``extras``.  A payload that can't be read gives a
    row with ``readable`` false.
    """
    listed = _declared(catalog.where(F.col("doc_kind") == kind))
    names = stand_ins(headers(files.where(F.col("doc_kind") == kind), listed)).where("stands_in").select("nested", "name", "other", "score").limit(MAX_NAMES + 1).collect()
    if len(names) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} field names stand in for declared ones")
    alias = {nested: [(r["score"], r["name"], r["other"]) for r in names if r["nested"] == nested] for nested in (False, True)}
    top = {c["field_path"]: c["field_type"] for c in listed if "." not in c["field_path"]}
    sub = {c["field_path"].partition(".")[2]: c["field_type"] for c in listed if "." in c["field_path"]}
    element = ", ".join(f"{n}: {t.replace('long', 'bigint')}" for n, t in sub.items())
    ddl = lambda t: f"array<struct<{element}>>" if t == "array<struct>" else t.replace("long", "bigint")
    schema = "file_id bigint, file_name string, landed_at timestamp, readable boolean, " + ", ".join(f"{n} {ddl(t)}" for n, t in top.items()) + ", extras map<string,string>"

    def take(doc: dict, declared: dict[str, str], nested: bool) -> tuple[dict, set[str]]:
        # as in changes: a name and a field that are each other's best, so that no name fills two fields
        rank = lambda pair: (-pair[0], -fits(doc[pair[1]], declared[pair[2]]))
        open_ = [p for p in alias[nested] if p[1] in doc and doc[p[1]] is not None and p[1] not in declared and p[2] in declared and p[2] not in doc]
        by_name, by_field = {}, {}
        for pair in open_:
            by_name[pair[1]] = min(by_name.get(pair[1], pair), pair, key=lambda x: (*rank(x), x[2]))
            by_field[pair[2]] = min(by_field.get(pair[2], pair), pair, key=lambda x: (*rank(x), x[1]))
        written = {d: p[1] for d, p in by_field.items() if by_name[p[1]] == p} | {d: d for d in declared if d in doc}
        return {d: _cast(doc[written[d]], t) if d in written else None for d, t in declared.items()}, set(written.values())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file_id, file_name, landed_at, payload in zip(pdf["file_id"], pdf["file_name"], pdf["landed_at"], pdf["payload"]):
                try:
                    doc = _parse(payload)
                    ok = isinstance(doc, dict)
                except (TypeError, ValueError, RecursionError):
                    doc, ok = {}, False
                doc = doc if ok else {}
                row, used = take(doc, top, False)
                for n, t in top.items():
                    if t == "array<struct>" and row[n] is not None:
                        row[n] = [take(x, sub, True)[0] for x in row[n] if isinstance(x, dict)]
                extras = {u: json.dumps(v) for u, v in doc.items() if u not in used}
                rows.append({"file_id": file_id, "file_name": file_name, "landed_at": landed_at, "readable": ok, **row, "extras": extras})
            yield pd.DataFrame(rows, columns=["file_id", "file_name", "landed_at", "readable", *top, "extras"])

    return files.where(F.col("doc_kind") == kind).select("file_id", "file_name", F.col("landed_at").cast("timestamp").alias("landed_at"), "payload").mapInPandas(read, schema)
