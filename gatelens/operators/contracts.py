"""Behaviour contracts: rule files → rule table → long verdict table.

Contract files are driver-side configuration. They become a table of rules by
app (``rules.py``); responses meet their app's rules by one join and each rule
kind is one kernel over them, so the plan does not grow with apps or rules.
Verdict struct fields: contract_id, contract_type, action (NULL when
passed), tier, passed, compliance, message, evidence, location.
"""

from __future__ import annotations

import glob
import json
import os
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.functions import jsonschema as js
from gatelens.functions import text as tx
from gatelens.functions.lexicon import strict_parse_json
from gatelens.functions.numeric import half_up
from gatelens.operators import rules as rules_as_data
from gatelens.session import spread

RESOURCES = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "resources")
CONTRACT_DIR = os.path.join(RESOURCES, "contracts")
INVALID_CONTRACT_DIR = os.path.join(RESOURCES, "contracts_invalid")

# Rule kinds with their default tier, tier order, report settings.
KIND_TIER = {"keyword": "deterministic", "regex": "deterministic", "length_limit": "deterministic",
             "language_match": "deterministic", "schema": "deterministic", "sentiment": "classifier",
             "topic_boundary": "classifier", "llm_judge": "llm_judge", "composite": "deterministic"}
TIER_ORDER = {"deterministic": 0, "classifier": 1, "llm_judge": 2}
WARNING_BELOW = 0.8
CONTENT_LOCATION = "choices[0].message.content"
REGEX_FLAG_NAMES = {"I": "i", "IGNORECASE": "i", "M": "m", "MULTILINE": "m", "S": "s", "DOTALL": "s",
                    "X": "x", "VERBOSE": "x"}


@dataclass
class Contract:
    id: str
    name: str
    type: str
    action: str = "block"
    enabled: bool = True
    tier: str = "deterministic"
    p: dict = field(default_factory=dict)
    members: list = field(default_factory=list)


def parse_contract(d: dict) -> Contract:
    kind = d.get("type")
    members = [parse_contract(m) for m in d.get("contracts", [])] if kind == "composite" else []
    p = {k: v for k, v in d.items() if k not in ("id", "name", "type", "action", "enabled", "contracts")}
    return Contract(id=d["id"], name=d.get("name", d["id"]), type=kind, action=d.get("action", "block"),
                    enabled=bool(d.get("enabled", True)), tier=d.get("evaluation_tier", KIND_TIER.get(kind, "deterministic")),
                    p=p, members=members)


# ------------------------------------------------------------------ lint (validation rules)
def lint_contract(d: dict, spark: SparkSession | None = None) -> list[str]:
    """Reasons a rule definition is invalid or ill-advised (empty list when clean)."""
    out = []
    kind = d.get("type")
    if kind not in KIND_TIER:
        return [f"unknown contract type {kind!r}"]
    if not d.get("id") or not d.get("name"):
        out.append("missing id or name")
    if d.get("action", "block") not in ("block", "flag", "log"):
        out.append("invalid action")
    if kind == "keyword" and not d.get("keywords"):
        out.append("keywords must not be empty")
    if kind == "regex":
        err = regex_error(d.get("pattern", ""), spark)
        if err:
            out.append(f"invalid regex {d.get('pattern', '')!r}")
    if kind == "schema" and schema_error(d.get("json_schema", {})):
        out.append(f"invalid schema: {schema_error(d['json_schema'])}")
    elif kind == "schema" and js.needs_rows(d.get("json_schema", {})):
        out.append("schema needs a check outside the JVM, row by row")
    if kind == "length_limit":
        lims = [d.get(k) for k in ("max_words", "max_characters", "max_sentences")]
        if all(v is None for v in lims):
            out.append("at least one limit required")
        if any(v is not None and v < 1 for v in lims):
            out.append("limits must be >= 1")
    if kind == "language_match" and not (0.0 <= float(d.get("min_confidence", 0.5)) <= 1.0):
        out.append("min_confidence out of range")
    if kind == "sentiment" and not (-1.0 <= float(d.get("min_score", 0.0)) <= 1.0):
        out.append("min_score out of range [-1, 1]")
    if kind == "topic_boundary":
        if not d.get("allowed_topics"):
            out.append("allowed_topics must not be empty")
        if not (0.0 <= float(d.get("threshold", 0.5)) <= 1.0):
            out.append("threshold out of range [0, 1]")
    if kind == "llm_judge":
        if len(d.get("assertion", "")) < 5:
            out.append("assertion shorter than 5 characters")
        if not (0.0 <= float(d.get("threshold", 0.7)) <= 1.0):
            out.append("threshold out of range [0, 1]")
        if d.get("action", "block") == "block":
            out.append("llm_judge with block action adds judge latency to every response")
    if kind == "composite":
        if not d.get("contracts"):
            out.append("empty composite")
        for m in d.get("contracts", []):
            out += [f"member {m.get('id')}: {r}" for r in lint_contract(m, spark)]
    return out


def regex_error(pattern: str, spark: SparkSession | None = None) -> str | None:
    """Compile check with the JVM's regex engine (what rlike will run); Python's only where there is no session."""
    jvm = None
    pattern = java_pattern(pattern)
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        try:
            jvm = spark.sparkContext._jvm
        except Exception:  # noqa: BLE001 - no JVM handle (Connect): fall back to Python's engine
            jvm = None
    if jvm is not None:
        try:
            jvm.java.util.regex.Pattern.compile(pattern)
            return None
        except Exception as e:  # noqa: BLE001
            return str(e).splitlines()[0][:120]
    try:
        re.compile(pattern)
        return None
    except re.error as e:
        return str(e)


# ------------------------------------------------------------------ loading
def load_definitions(directory: str = CONTRACT_DIR, spark: SparkSession | None = None):
    """All ``*.json`` in name order; malformed/invalid files skipped; later file wins per app.

    Returns ({app_id: [Contract]}, [(file, reason)]). Missing directory → empty. A rule whose JSON schema is invalid is
    listed with its file, but only that rule is out of force: it passes, and the file's other rules hold.
    """
    defs, rejected = {}, []
    for path in sorted(glob.glob(os.path.join(directory, "*.json"))):
        name = os.path.basename(path)
        try:
            with open(path, encoding="utf-8") as fh:
                doc = json.load(fh)
        except (OSError, ValueError) as e:
            rejected.append((name, f"malformed: {e}"))
            continue
        problems = [f"{c.get('id')}: {r}" for c in doc.get("contracts", []) for r in lint_contract(_without_schemas(c), spark)
                    if not r.startswith("llm_judge with block")]
        if not doc.get("app_id") or problems:
            rejected.append((name, "; ".join(problems) or "missing app_id"))
            continue
        defs[doc["app_id"]] = [parse_contract(c) for c in doc.get("contracts", [])]
        rejected += [(name, r) for c in doc.get("contracts", []) for r in _schema_problems(c)]
    return defs, rejected


def _without_schemas(c: dict) -> dict:
    """The rule with JSON schemas that allow everything, so that lint sees the rest of it."""
    c = dict(c, json_schema={}) if c.get("type") == "schema" and isinstance(c.get("json_schema"), dict) else dict(c)
    return dict(c, contracts=[_without_schemas(m) for m in c["contracts"]]) if c.get("contracts") else c


def _schema_problems(c: dict) -> list[str]:
    own = schema_error(c.get("json_schema", {})) if c.get("type") == "schema" else None
    return ([f"{c.get('id')}: invalid schema: {own}"] if own else []) + [r for m in c.get("contracts", []) for r in _schema_problems(m)]


def read_contracts(spark: SparkSession, directory: str = CONTRACT_DIR):
    """Spark reader: whole files → (rules DF one row per top-level rule, rejected DF).

    Later file (by name) wins per app_id; files that do not parse go to ``rejected``.
    """
    schema = ("app_id string, version string, contracts array<struct<id:string,name:string,type:string,"
              "action:string,enabled:boolean>>")
    raw = (spark.read.text(os.path.join(directory, "*.json"), wholetext=True)
           .select(F.col("_metadata.file_name").alias("file_name"), F.col("value")))
    parsed = raw.select("file_name", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("d"),
                        strict_parse_json(F.col("value")).isNull().alias("bad"))
    rejected = parsed.filter(F.col("bad") | F.col("d.app_id").isNull()).select("file_name")
    good = parsed.filter(~F.col("bad") & F.col("d.app_id").isNotNull())
    latest = good.groupBy(F.col("d.app_id").alias("app_id")).agg(F.max_by("d", "file_name").alias("d"),
                                                                  F.max("file_name").alias("file_name"))
    rules = latest.select("app_id", "file_name", F.col("d.version").alias("version"),
                          F.posexplode("d.contracts").alias("pos", "c")).select(
        "app_id", "file_name", "version", "pos", "c.id", "c.name", "c.type",
        F.coalesce("c.action", F.lit("block")).alias("action"), F.coalesce("c.enabled", F.lit(True)).alias("enabled"))
    return rules, rejected


# ------------------------------------------------------------------ per-kind compilation
def _verdict(c: Contract, failed: Column, compliance: Column, message: Column, evidence: Column,
             location: Column, tier: str | Column | None = None) -> Column:
    failed = F.coalesce(failed, F.lit(False))
    t = F.lit(tier or c.tier) if not isinstance(tier, Column) else tier
    return F.struct(
        F.lit(c.id).alias("contract_id"), F.lit(c.type).alias("contract_type"),
        F.when(failed, F.lit(c.action)).alias("action"), t.alias("tier"), (~failed).alias("passed"),
        compliance.cast("double").alias("compliance"),
        F.when(failed, message).alias("message"), F.when(failed, evidence).alias("evidence"),
        F.when(failed, location).alias("location"))


def _quote(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def regex_flags(c: Contract) -> str:
    """Inline flags from Python flag names; unknown names are ignored."""
    return "".join(sorted({REGEX_FLAG_NAMES[f.upper()] for f in c.p.get("flags", []) if f.upper() in REGEX_FLAG_NAMES}))


def java_pattern(pattern: str) -> str:
    """Python's named groups and references as Java writes them."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<", "(?<", pattern))


def regex_java(c: Contract) -> str:
    # d: only \n ends a line; U: Unicode classes and case folding — both as Python's re on str
    flags = regex_flags(c) + "dU"
    return f"(?{flags})" + java_pattern(c.p["pattern"])


# Fixed value: characters of a match, a value or a reasoning that a verdict shows (the whole text is evaluated).
SHOWN_CHARS = 200


# ---------------------------------------------------------------- judge replies
_FENCE = r"(?s)```(?:json)?" + tx.WS + r"*(\{.*?\})" + tx.WS + r"*```"


def _py_str(v: Column) -> Column:
    """str() of a JSON value as Python would print it after json.loads (strings as-is)."""
    t = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit(""))
            .when(t == "STRING", F.try_variant_get(v, "$", "string"))
            .when(t == "VOID", F.lit("None"))
            .when(t == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "True").otherwise("False"))
            .otherwise(F.to_json(v)))


def _score_from(v: Column):
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    s = F.try_variant_get(v, "$.score", "variant")
    st = F.schema_of_variant(s)
    str_val = F.try_variant_get(s, "$", "string").try_cast("double")
    err = is_obj & s.isNotNull() & (st.isin("VOID") | st.startswith("OBJECT") | st.startswith("ARRAY"))
    bad_str = s.isNotNull() & (st == "STRING") & str_val.isNull()
    ok = is_obj & ~err & ~F.coalesce(bad_str, F.lit(False))
    score = (F.when(s.isNull(), F.lit(0.5))
             .when(st == "BOOLEAN", F.when(F.try_variant_get(s, "$", "boolean"), 1.0).otherwise(0.0))
             .when(st == "STRING", str_val)
             .otherwise(F.try_variant_get(s, "$", "double")))
    reason = _py_str(F.try_variant_get(v, "$.reasoning", "variant"))
    return ok, err, score, reason


def judge_score_parse(content: Column) -> Column:
    """struct(score, reasoning, path) for a single Column (see ``judge_score_frame`` for table use)."""
    c = F.regexp_replace(content, "^" + tx.WS + "+|" + tx.WS + "+$", "")
    ok1, err1, s1, r1 = _score_from(strict_parse_json(c))
    fenced = F.regexp_extract(c, _FENCE, 1)
    ok2, err2, s2, r2 = _score_from(F.when(fenced != "", strict_parse_json(fenced)))
    num = F.regexp_extract(c, r"([0-9]+\.?[0-9]*)", 1)
    return _judge_pick(c, ok1, err1, s1, r1, ok2, err2, s2, r2, num)


def _judge_pick(c, ok1, err1, s1, r1, ok2, err2, s2, r2, num) -> Column:
    n = num.try_cast("double")
    s3 = F.when(n > 1.0, n / 100.0).otherwise(n)
    path = (F.when(ok1, "json").when(err1, "error").when(ok2, "fenced").when(err2, "error")
            .when(num != "", "number").otherwise("default"))
    raw_score = F.coalesce(F.when(ok1, s1), F.when(err1, F.lit(None)).otherwise(
        F.coalesce(F.when(ok2, s2), F.when(err2, F.lit(None)).otherwise(
            F.when(num != "", s3).otherwise(F.lit(0.5))))))
    reasoning = (F.when(ok1, r1).when(err1, F.lit(None)).when(ok2, r2).when(err2, F.lit(None))
                 .when(num != "", F.substring(c, 1, 200))
                 .otherwise(F.concat(F.lit("Could not parse judge response: "), F.substring(c, 1, 200))))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw_score))
    return F.struct(F.round(score, 6).alias("score"), reasoning.alias("reasoning"), path.alias("path"))


def judge_score_frame(df: DataFrame, raw: str, prefix: str = "_j") -> DataFrame:
    """Adds ``{prefix}_score``, ``{prefix}_reason``, ``{prefix}_path`` via staged projections (small plans)."""
    a = df.withColumn(f"{prefix}c", F.regexp_replace(F.col(raw), "^" + tx.WS + "+|" + tx.WS + "+$", ""))
    a = (a.withColumn(f"{prefix}fen", F.regexp_extract(F.col(f"{prefix}c"), _FENCE, 1))
          .withColumn(f"{prefix}num", F.regexp_extract(F.col(f"{prefix}c"), r"([0-9]+\.?[0-9]*)", 1))
          .withColumn(f"{prefix}v1", strict_parse_json(F.col(f"{prefix}c"))))
    a = a.withColumn(f"{prefix}v2", F.when(F.col(f"{prefix}fen") != "", strict_parse_json(F.col(f"{prefix}fen"))))
    names = []
    for i in (1, 2):
        ok, err, sc, rs = _score_from(F.col(f"{prefix}v{i}"))
        a = a.withColumn(f"{prefix}ok{i}", ok).withColumn(f"{prefix}err{i}", err) \
             .withColumn(f"{prefix}s{i}", sc).withColumn(f"{prefix}r{i}", rs)
        names += [f"{prefix}ok{i}", f"{prefix}err{i}", f"{prefix}s{i}", f"{prefix}r{i}"]
    j = _judge_pick(F.col(f"{prefix}c"), *[F.col(n) for n in names], F.col(f"{prefix}num"))
    a = a.withColumn(f"{prefix}_t", j)
    a = (a.withColumn(f"{prefix}_score", F.col(f"{prefix}_t.score")).withColumn(f"{prefix}_reason", F.col(f"{prefix}_t.reasoning"))
          .withColumn(f"{prefix}_path", F.col(f"{prefix}_t.path")))
    return a.drop(f"{prefix}c", f"{prefix}fen", f"{prefix}num", f"{prefix}v1", f"{prefix}v2", f"{prefix}_t", *names)


# ---------------------------------------------------------------- schema (compiled; the rest row by row)
SCHEMA_TYPES = {"object", "array", "string", "boolean", "null", "integer", "number"}
_NUMERIC = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL")


def _is_type(v: Column, t: str) -> Column:
    st = F.schema_of_variant(v)
    if t == "object":
        return st.startswith("OBJECT")
    if t == "array":
        return st.startswith("ARRAY")
    if t == "string":
        return st == "STRING"
    if t == "boolean":
        return st == "BOOLEAN"
    if t == "null":
        return st == "VOID"
    if t == "integer":
        return st.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | (
            st.startswith("DECIMAL") & (F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double"))))
    if t == "number":
        return st.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | st.startswith("DECIMAL")
    return F.lit(False)


_COUNTS = ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties", "minContains", "maxContains")
_BOUNDS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")


def _strings(x) -> bool:
    return isinstance(x, list) and all(isinstance(i, str) for i in x)


def schema_error(schema, old: bool | None = None) -> str | None:
    """Why a schema is invalid (lint reports it; a rule with such a schema passes, as in the gateway). Keywords that
    JSON Schema does not know are none of its business."""
    if isinstance(schema, bool):
        return None
    if not isinstance(schema, dict):
        return "a schema must be an object"
    old = js.old_draft(schema) if old is None else old
    types = schema.get("type", [])
    for t in types if isinstance(types, list) else [types]:
        if t not in SCHEMA_TYPES:
            return f"unknown type {t!r}"
    for kw in _BOUNDS + _COUNTS:
        flag = old and kw.startswith("exclusive") and isinstance(schema.get(kw), bool)
        if kw in schema and not flag and not js.is_type(schema[kw], "integer" if kw in _COUNTS else "number"):
            return f"{kw} must be a number"
        if kw in schema and (kw in _COUNTS and schema[kw] < 0 or kw == "multipleOf" and schema[kw] <= 0):
            return f"{kw} is out of range"
    if not _strings(schema.get("required", [])) or not isinstance(schema.get("enum", []), list) \
            or not isinstance(schema.get("uniqueItems", False), bool) or not isinstance(schema.get("$ref", ""), str):
        return "required, enum, uniqueItems or $ref has a wrong form"
    for k in (*js.SCHEMA_MAP, "dependentRequired", "dependencies"):
        if not isinstance(schema.get(k, {}), dict):
            return f"{k} must be an object"
    if not all(map(_strings, schema.get("dependentRequired", {}).values())):
        return "dependentRequired must hold lists of names"
    for p in [schema.get("pattern"), *schema.get("patternProperties", {})]:
        if p is not None and (not isinstance(p, str) or regex_error(p)):
            return f"invalid pattern {p!r}"
    for k in js.SCHEMA_LIST:
        if k in schema and (not isinstance(schema[k], list) or not schema[k]):
            return f"{k} must be a list of schemas"
    if any(isinstance(schema.get(k), list) for k in js.SCHEMA_VALUE if k != "items" or not old):
        return "a schema must be an object"
    return next((e for e in (schema_error(sub, old) for sub in js.subschemas(schema)) if e), None)


def _member(v: Column, key: str) -> Column:
    """The member of an object VARIANT, whatever characters the key has."""
    quote = "'" if "'" not in key else '"'
    return F.try_variant_get(v, f"$[{quote}{key}{quote}]", "variant")


def _row_check(schema, v: Column) -> Column:
    run = js.checker(schema)

    def check(texts: pd.Series) -> pd.Series:
        return texts.map(run, na_action="ignore").astype(object)
    return F.pandas_udf(check, "string")(F.to_json(v))


def schema_check(schema, v: Column, root: dict | None = None) -> Column:
    """Column that is a failure message (NULL when the value satisfies the schema, or the schema is not one). Schemas
    that refer to themselves or hold conditional or counting keywords are checked row by row, exactly."""
    if isinstance(schema, bool):
        return F.lit(None).cast("string") if schema else F.lit("is not allowed")
    if root is None:
        if schema_error(schema):
            return F.lit(None).cast("string")
        if js.needs_rows(schema):
            return _row_check(schema, v)
        root = schema
    checks: list[Column] = []

    def check(sub, x: Column) -> Column:
        return schema_check(sub, x, root)
    if "$ref" in schema:
        target = js.referred(root, schema["$ref"])
        if target is not None:
            checks.append(check(target, v))
    if "type" in schema:
        ts = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        ok = F.lit(False)
        for t in ts:
            ok = ok | _is_type(v, t)
        checks.append(F.when(~ok, F.lit(f"is not of type {' or '.join(ts)}")))
    is_obj = _is_type(v, "object")
    for k in schema.get("required", []):
        present = _member(v, k).isNotNull()
        checks.append(F.when(is_obj & ~present, F.lit(f"'{k}' is a required property")))
    for k, sub in schema.get("properties", {}).items():
        child = _member(v, k)
        checks.append(F.when(is_obj & child.isNotNull(), check(sub, child)))
    members = F.try_variant_get(v, "$", "map<string,variant>")
    for p, sub in schema.get("patternProperties", {}).items():
        def wrong_entry(e: Column, p=java_pattern(p), sub=sub) -> Column:
            return e["key"].rlike(p) & check(sub, e["value"]).isNotNull()
        checks.append(F.when(is_obj & F.exists(F.map_entries(members), lambda e: wrong_entry(e)), F.lit(f"a property like {p!r} is invalid")))
    if schema.get("additionalProperties", True) is not True:
        keys = F.map_keys(members)
        if schema.get("patternProperties"):
            known = "|".join(f"(?:{java_pattern(p)})" for p in schema["patternProperties"])
            keys = F.filter(keys, lambda k: ~k.rlike(known))
        allowed = F.array(*[F.lit(k) for k in schema.get("properties", {})]) if schema.get("properties") else F.array().cast("array<string>")
        extra = F.array_except(keys, allowed)
        if schema["additionalProperties"] is False:
            checks.append(F.when(is_obj & (F.size(extra) > 0), F.lit("additional properties are not allowed")))
        else:
            rest = F.map_filter(members, lambda k, _: F.array_contains(extra, k))
            wrong = F.exists(F.map_values(rest), lambda x: check(schema["additionalProperties"], x).isNotNull())
            checks.append(F.when(is_obj & wrong, F.lit("an additional property is invalid")))
    num = _is_type(v, "number")
    d, exact = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "decimal(38,18)")
    for kw, op in (("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b),
                   ("exclusiveMinimum", lambda a, b: a <= b), ("exclusiveMaximum", lambda a, b: a >= b)):
        if kw in schema:      # as decimals where both fit, so that large integers compare exactly
            wrong = F.coalesce(op(exact, F.lit(repr(schema[kw])).try_cast("decimal(38,18)")), op(d, F.lit(float(schema[kw]))))
            checks.append(F.when(num & wrong, F.lit(f"violates {kw} {schema[kw]}")))
    if "multipleOf" in schema:
        step = F.lit(repr(schema["multipleOf"])).try_cast("decimal(38,18)")
        ratio = d / F.lit(float(schema["multipleOf"]))
        wrong = F.coalesce(exact % F.nullif(step, F.lit(0).cast("decimal(38,18)")) != 0, ratio != F.round(ratio))
        checks.append(F.when(num & wrong, F.lit(f"is not a multiple of {schema['multipleOf']}")))
    is_str = _is_type(v, "string")
    s = F.try_variant_get(v, "$", "string")
    if "minLength" in schema:
        checks.append(F.when(is_str & (F.length(s) < schema["minLength"]), F.lit(f"is shorter than {schema['minLength']}")))
    if "maxLength" in schema:
        checks.append(F.when(is_str & (F.length(s) > schema["maxLength"]), F.lit(f"is longer than {schema['maxLength']}")))
    if "pattern" in schema:
        checks.append(F.when(is_str & ~s.rlike(java_pattern(schema["pattern"])), F.lit(f"does not match {schema['pattern']!r}")))
    for vals in ([schema["enum"]] if "enum" in schema else []) + ([[schema["const"]]] if "const" in schema else []):
        ok = F.lit(False)
        for val in vals:
            if isinstance(val, bool):
                ok = ok | (_is_type(v, "boolean") & (F.try_variant_get(v, "$", "boolean") == F.lit(val)))
            elif isinstance(val, (int, float)):
                ok = ok | (num & (d == F.lit(float(val))))
            elif isinstance(val, str):
                ok = ok | (is_str & (s == F.lit(val)))
            elif val is None:
                ok = ok | _is_type(v, "null")
            else:      # an object or array: equal as JSON with sorted keys
                ok = ok | (F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(val)))))
        checks.append(F.when(~ok, F.lit("is not one of the allowed values")))
    is_arr = _is_type(v, "array")
    arr = F.try_variant_get(v, "$", "array<variant>")
    if "minItems" in schema:
        checks.append(F.when(is_arr & (F.size(arr) < schema["minItems"]), F.lit(f"has fewer than {schema['minItems']} items")))
    if "maxItems" in schema:
        checks.append(F.when(is_arr & (F.size(arr) > schema["maxItems"]), F.lit(f"has more than {schema['maxItems']} items")))
    if isinstance(schema.get("items"), (dict, bool)):
        item = schema["items"]
        checks.append(F.when(is_arr & F.exists(arr, lambda e: check(item, e).isNotNull()), F.lit("an item is invalid")))
    if schema.get("uniqueItems"):
        texts = F.transform(arr, lambda e: F.to_json(e))
        checks.append(F.when(is_arr & (F.size(F.array_distinct(texts)) < F.size(texts)), F.lit("has equal items")))
    for sub in schema.get("allOf", []):
        checks.append(check(sub, v))
    if "anyOf" in schema:
        ok = F.lit(False)
        for sub in schema["anyOf"]:
            ok = ok | check(sub, v).isNull()
        checks.append(F.when(~ok, F.lit("matches none of anyOf")))
    if "oneOf" in schema:
        n = tx.sum_cols([check(sub, v).isNull().cast("int") for sub in schema["oneOf"]])
        checks.append(F.when(n == 0, F.lit("matches none of oneOf")).when(n > 1, F.lit("matches several of oneOf")))
    if "not" in schema:
        checks.append(F.when(check(schema["not"], v).isNull(), F.lit("matches a forbidden schema")))
    return F.coalesce(*checks) if checks else F.lit(None).cast("string")


def resolve_path(v: Column, path: str | None) -> Column:
    """Dotted path into a VARIANT; an integer part is a key of an object and an index of an array; NULL when
    unresolvable."""
    for p in path.split(".") if path else []:
        by_key = _member(v, p)
        v = F.coalesce(by_key, F.try_variant_get(v, f"$[{int(p)}]", "variant")) if p.isdigit() else by_key
    return v


def static_tier(c: Contract) -> str:
    """Tier of a rule; a composite takes its costliest member's tier."""
    if c.type != "composite" or not c.members:
        return c.tier if c.type != "composite" else "deterministic"
    return max((static_tier(m) for m in c.members), key=lambda t: TIER_ORDER[t])


PLUG_INS: dict = {}


def register_contract_type(kind: str, compiler, tier: str = "deterministic") -> None:
    """Plug-in point: ``compiler(contract, ctx) -> verdict struct Column``, called once for all rules of the kind: the
    contract's attributes (id, type, action, tier, params as JSON text) are Columns."""
    PLUG_INS[kind] = compiler
    KIND_TIER[kind] = tier


def register_batch_type(kind: str, check, tier: str = "llm_judge") -> None:
    """Plug-in point for checks outside the JVM: ``check`` gets a pandas frame (response, request, document, extracted,
    params as JSON text), one row per response and rule of the kind that is evaluated, and returns a frame of failed,
    compliance, message, evidence and location."""
    rules_as_data.BATCHES[kind] = check
    KIND_TIER[kind] = tier


# ------------------------------------------------------------------ table-level operators
def _judged(df: DataFrame, raw: str) -> DataFrame:
    return judge_score_frame(df, raw)


def _evaluator(pairs: DataFrame, defs: dict, response: str, request: str | None, judge_raw: str | None, payload: str | None):
    """The pairs with texts as ``_resp`` and ``_req``, and a function that adds the verdicts of some rules."""
    df = spread(pairs).withColumn("_resp", F.coalesce(F.col(response).cast("string"), F.lit("")))
    df = df.withColumn("_req", F.coalesce(F.col(request), F.lit("")) if request else F.lit(""))
    ctx = {"response": F.col("_resp"), "request": F.col("_req"), "judge_raw": F.col(judge_raw) if judge_raw else None,
           "payload": payload is not None, "payload_value": F.col(payload) if payload else None, "content_name": CONTENT_LOCATION, "shown_chars": SHOWN_CHARS}

    def evaluate(frame: DataFrame, keep, key: str, rules: str, out: str) -> DataFrame:
        kept = {app: [r for r in rs if keep(r)] for app, rs in defs.items()}
        table = rules_as_data.rule_table(pairs.sparkSession, kept, static_tier, regex_java, _quote)
        return rules_as_data.evaluate(frame, table, key, rules, out, ctx, _judged, PLUG_INS)
    return df, evaluate


def contract_verdicts(pairs: DataFrame, defs: dict, keys: list[str], response: str = "response",
                      request: str | None = "request", app_col: str = "app_id", judge_raw: str | None = None,
                      payload: str | None = None) -> DataFrame:
    """Every enabled rule of the pair's app on each pair; unknown app → no rows."""
    df, evaluate = _evaluator(pairs, defs, response, request, judge_raw, payload)
    return evaluate(df, lambda r: True, app_col, "_rules", "_v").select(*keys, app_col, F.inline("_v"))


def contract_tiered(pairs: DataFrame, defs: dict, keys: list[str], response: str = "response",
                    request: str | None = "request", app_col: str = "app_id", judge_raw: str | None = None) -> DataFrame:
    """BLOCK rules on every pair, then FLAG/LOG rules where no BLOCK rule failed: a blocked response meets no rule in the
    second join, so no measure is taken of it and no plug-in gets it."""
    df, evaluate = _evaluator(pairs, defs, response, request, judge_raw, None)
    df = evaluate(df, lambda r: r.action == "block", app_col, "_block", "_b").drop("_block")
    df = df.withColumn("_open", F.when(~F.exists("_b", lambda v: ~v["passed"]), F.col(app_col)))
    return evaluate(df, lambda r: r.action != "block", "_open", "_flag", "_r").select(*keys, app_col, F.inline(F.concat("_b", "_r")))


def contract_report(pairs: DataFrame, defs: dict, keys: list[str], response: str = "response",
                    request: str | None = "request", app_col: str = "app_id", judge_raw: str | None = None) -> DataFrame:
    """Per pair: blocked, failed BLOCK rule ids, warnings (passed, compliance < 0.8), rule counts."""
    df, evaluate = _evaluator(pairs, defs, response, request, judge_raw, None)
    s = evaluate(df, lambda r: r.action == "block", app_col, "_block", "_b")
    # counts of rules are rows of their own table
    counts = [(app, sum(r.enabled and r.action == "block" for r in rs), sum(r.enabled and r.action != "block" for r in rs))
              for app, rs in sorted(defs.items())]
    counted = pairs.sparkSession.createDataFrame(counts, "_app string, _n_block int, _n_flag int")
    s = s.join(counted, F.col(app_col) == F.col("_app"), "left")
    n_block, n_flag = F.coalesce("_n_block", F.lit(0)), F.coalesce("_n_flag", F.lit(0))
    return s.select(
        *keys, app_col,
        F.exists("_b", lambda v: ~v["passed"]).alias("blocked"),
        F.array_join(F.transform(F.filter("_b", lambda v: ~v["passed"]), lambda v: v["contract_id"]), ",").alias("violations"),
        F.array_join(F.transform(F.filter("_b", lambda v: v["passed"] & (v["compliance"] < WARNING_BELOW)),
                                 lambda v: v["contract_id"]), ",").alias("warnings"),
        n_block.alias("block_count"), n_flag.alias("flag_count"), (n_block + n_flag).alias("total_contracts"))


def contract_rollup(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("app_id", "contract_id", "contract_type", "tier").agg(
        F.count("*").alias("evaluations"), F.count_if(~F.col("passed")).alias("violations"),
        # exact mean of 6-dp compliance units: identical for any partitioning or engine
        half_up(F.sum(F.round(F.col("compliance") * 1e6).cast("long")) / F.count("*") / 1e6, 6).alias("mean_compliance"))


def judge_requests(pairs: DataFrame, defs: dict, keys: list[str], response: str = "response",
                   app_col: str = "app_id") -> DataFrame:
    """Rows to send to an external judge: one per (pair, enabled llm_judge rule)."""
    branches = []
    for app in sorted(defs):
        js = [r for r in defs[app] if r.enabled and r.type == "llm_judge"]
        if js:
            branches.append(F.when(F.col(app_col) == app, F.array(*[
                F.struct(F.lit(r.id).alias("contract_id"), F.lit(r.p["assertion"]).alias("assertion")) for r in js])))
    arr = F.coalesce(*branches) if branches else F.lit(None).cast("array<struct<contract_id:string,assertion:string>>")
    return pairs.select(*keys, app_col, F.inline(arr), F.col(response).alias("response"))
