"""Contract rules as data: a table of rules by app, and one kernel per rule kind.

A rule set becomes rows (app_id, rules), ``rules`` an array of nodes with their parameters; members of composites are
nodes of their own that name their parent. Responses meet the rules of their app by one join, and each kernel is a
function over the nodes of its kind, so a plan grows with the kinds in use and with how deep composites nest, not with
apps or rules. Kinds whose check is Python (JSON schemas, plug-ins) run over Arrow batches that hold only the pairs of
response and rule to be checked.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.functions import jsonschema as js
from gatelens.functions import text as tx
from gatelens.functions.lexicon import strict_parse_json

CHECKED_ROWS = 1_000             # rows (pairs of response and rule) that a check in Arrow batches gets at a time
BROADCAST_CHARS = 4_000_000      # a rule table is broadcast while its parameters are this short; beyond, a shuffled join

NODE = ("struct<idx:int,parent:int,height:int,block:boolean,id:string,type:string,action:string,tier:string,params:string,"
        "needles:array<struct<shown:string,needle:string,rx:string>>,case_sensitive:boolean,whole:boolean,rx:string,shown:string,"
        "max_words:long,max_characters:long,max_sentences:long,expected:string,low:double,"
        "allowed:array<string>,off:string,all_of:boolean,n:int>")
_FIELDS = [f.split(":")[0] for f in
           NODE.removeprefix("struct<").removesuffix(">").replace("struct<shown:string,needle:string,rx:string>", "x").split(",")]

VERDICT = ("struct<contract_id:string,contract_type:string,action:string,tier:string,passed:boolean,compliance:double,message:string,"
           "evidence:string,location:string>")
# what a kernel returns beside the rule's own fields
OUTCOME = "struct<failed:boolean,compliance:double,message:string,evidence:string,location:string>"


@dataclass
class RuleRef:
    """A rule inside a kernel: its attributes are Columns; ``params`` is the JSON text of its other settings."""

    id: Column
    type: Column
    action: Column
    tier: Column
    params: Column


def nodes(rules: list, static_tier: Callable, regex: Callable, quote: Callable) -> list[tuple]:
    """The enabled rules of one app and their members, depth first, as rows of NODE."""
    out: list[dict] = []

    def height(r) -> int:
        return 0 if r.type != "composite" else 1 + max((height(m) for m in r.members), default=0)

    def add(r, parent: int, block: bool) -> None:
        p, k = r.p, len(out)
        row = {"idx": k, "parent": parent, "height": height(r), "block": block, "id": r.id, "type": r.type, "action": r.action,
               "tier": static_tier(r), "params": json.dumps(p)}
        out.append(row)
        if r.type == "keyword":
            cs = bool(p.get("case_sensitive", False))
            needles = [(w, w if cs else w.lower()) for w in p.get("keywords", [])]
            row |= {"case_sensitive": cs, "whole": bool(p.get("match_whole_word", False)),
                    "needles": [(w, n, "(?<![\\p{L}\\p{N}_])" + quote(n) + "(?![\\p{L}\\p{N}_])") for w, n in needles]}
        elif r.type == "regex":
            row |= {"rx": regex(r), "shown": repr(p["pattern"])}
        elif r.type == "length_limit":
            row |= {c: p.get(c) for c in ("max_words", "max_characters", "max_sentences")}
        elif r.type == "language_match":
            row["expected"] = p.get("expected_language") or None
        elif r.type == "sentiment":
            row["low"] = float(p.get("min_score", 0.0))
            row["shown"] = f"{row['low']:.3f}"
        elif r.type == "topic_boundary":
            row |= {"allowed": list(p.get("allowed_topics", [])), "off": p.get("off_topic_label", "off_topic"),
                    "low": float(p.get("threshold", 0.5)), "shown": str(list(p.get("allowed_topics", [])))}
        elif r.type == "llm_judge":
            row["low"] = float(p.get("threshold", 0.7))
            row["shown"] = f"{row['low']:.3f}"
        elif r.type == "composite":
            row |= {"all_of": p.get("operator", "OR") != "OR", "n": len(r.members)}
        for m in r.members:
            add(m, k, block)
    for r in rules:
        if r.enabled:
            add(r, -1, r.action == "block")
    return [tuple(row.get(f) for f in _FIELDS) for row in out]


@dataclass
class RuleTable:
    """Rules by app as a DataFrame (app, rules), with what a plan must know of them: kinds, nesting and size."""

    frame: DataFrame
    kinds: set[str]
    height: int
    small: bool

    def attach(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with the nodes of the app named by ``key`` as ``name``; empty where there are none. A large table is joined
        by a shuffle, whose hot apps AQE splits."""
        table = F.broadcast(self.frame) if self.small else self.frame
        joined = df.join(table, F.col(key) == F.col("_app"), "left").drop("_app").withColumnRenamed("_nodes", name)
        return joined.withColumn(name, F.coalesce(name, F.array().cast(f"array<{NODE}>")))


def rule_table(spark: SparkSession, defs: dict, static_tier: Callable, regex: Callable, quote: Callable) -> RuleTable:
    rows = [(app, nodes(rules, static_tier, regex, quote)) for app, rules in sorted(defs.items())]
    kind, height, params = _FIELDS.index("type"), _FIELDS.index("height"), _FIELDS.index("params")
    every = [n for _, ns in rows for n in ns]
    frame = spark.createDataFrame(rows, f"_app string, _nodes array<{NODE}>")
    return RuleTable(frame, {n[kind] for n in every}, max((n[height] for n in every), default=0),
                     sum(len(n[params]) + 200 for n in every) <= BROADCAST_CHARS)


# ------------------------------------------------------------------ kernels: SQL over a node r and the response's columns
# (one parsed text per kernel: building them call by call would cost the driver thousands of round trips)
def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once (lambdas share no subexpressions)."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _outcome(failed: str, message: str, evidence: str, location: str, compliance: str = "if(f, 0.0D, 1.0D)") -> str:
    return _let("f", f"coalesce({failed}, false)", f"named_struct('failed', f, 'compliance', cast({compliance} as double), "
                f"'message', if(f, {message}, null), 'evidence', if(f, {evidence}, null), 'location', if(f, {location}, null))")


def _three(x: str) -> str:
    return f"format_string('%.3f', bround({x}, 3))"


def _kernels(c: dict) -> dict[str, str]:
    content, most = _q(c["content_name"]), c["shown_chars"]
    quoted = """if(contains(w, "'") and not contains(w, '"'), concat('"', w, '"'), concat("'", replace(w, "'", "\\\\'"), "'"))"""
    text = "if(r.case_sensitive, _resp, _lower)"
    out = {"keyword": _let("w", f"get(filter(r.needles, n -> if(r.whole, regexp_like({text}, n.rx), contains({text}, n.needle))), 0).shown",
                           _outcome("w is not null", f"concat('Response contains forbidden keyword: ', {quoted})", "w", content))}
    match = "regexp_extract(_resp, r.rx, 0)"      # no group around the pattern: references keep their numbers
    at = _let("s", "length(element_at(split(_resp, r.rx, 2), 1))", f"concat({_q(c['content_name'] + '[')}, s, ':', s + length({match}), ']')")
    out["regex"] = _outcome("regexp_like(_resp, r.rx)", "concat('Response matches forbidden pattern: ', r.shown)",
                            f"substring({match}, 1, {most})", at)

    def over(what: str, n: str, limit: str) -> str:
        return f"if({n} > r.{limit}, concat('{what} count ', {n}, ' exceeds limit ', r.{limit}), null)"
    limits = ", ".join((over("Word", "_words", "max_words"), over("Character", "length(_resp)", "max_characters"),
                        over("Sentence", "_sents", "max_sentences")))
    out["length_limit"] = _let("m", f"concat_ws('; ', {limits})", _outcome("m <> ''", "m", "concat('text_length=', length(_resp))", content))
    skip = "_resp_blank or (r.expected is null and _req_blank) or x is null or _resp_lang is null"
    out["language_match"] = _let("x", "coalesce(r.expected, _req_lang)", _outcome(
        f"not ({skip}) and _resp_lang <> x", "concat('Language mismatch: expected \\'', x, '\\', detected \\'', _resp_lang, '\\'')",
        "concat('detected=', _resp_lang, ', expected=', x)", content))
    out["sentiment"] = _outcome(
        "_resp <> '' and not _sent >= r.low",
        f"concat('Response sentiment score ', {_three('_sent')}, ' is below minimum threshold ', r.shown)",
        f"concat('sentiment_score=', {_three('_sent')})", content,
        "case when _resp = '' then 1.0D when r.low >= 0 then greatest(0.0D, least(1.0D, (_sent - r.low + 1.0D) / 2.0D)) "
        "when _sent >= r.low then 1.0D else 0.0D end")
    # candidates by score, then by their order (stable like a zero-shot ranking)
    scored = ("named_struct('allowed', x.allowed, 'sum', aggregate(x.hits, 0, (s, h) -> s + h), 'off', x.off, "
              "'top', array_min(transform(concat(x.hits, array(x.off)), (h, i) -> named_struct('k', -h, 'i', i))))")
    verdict = _let("t", "named_struct('label', get(concat(r.allowed, array(r.off)), y.top.i), 'all', nullif(cast(y.sum + y.off as double), 0.0D), "
                   "'score', cast(-y.top.k as double) / nullif(cast(y.sum + y.off as double), 0.0D))", _outcome(
                       "not (_resp_blank or t.all is null) and not (array_contains(y.allowed, lower(t.label)) and t.score >= r.low)",
                       f"concat('Response classified as \\'', t.label, '\\' (', {_three('t.score')}, ') which is outside allowed topics: ', r.shown)",
                       f"concat('top_label=', t.label, ', score=', {_three('t.score')})", content,
                       "if(_resp_blank or t.all is null, 1.0D, round(cast(y.sum as double) / t.all, 6))"))
    out["topic_boundary"] = _let("a", "transform(r.allowed, t -> lower(t))", _let(
        "x", "named_struct('allowed', a, 'hits', transform(a, t -> coalesce(try_element_at(_topics, t), 0)), 'off', "
        "aggregate(map_values(map_filter(_topics, (t, n) -> not array_contains(a, t))), 0, (s, n) -> s + n))", _let("y", scored, verdict)))
    if c["judge_raw"] is None:   # no verdict table supplied: fail open
        out["llm_judge"] = _outcome("false", *["cast(null as string)"] * 3)
    else:
        unusable, reason = "(_judge_raw is null or _j_path = 'error')", "coalesce(_j_reason, '')"
        out["llm_judge"] = _outcome(
            f"not {unusable} and _j_score < r.low",
            f"concat('LLM judge scored ', {_three('_j_score')}, ' (threshold ', r.shown, '): ', {reason})",
            f"concat('score=', {_three('_j_score')}, ', reasoning=', substring({reason}, 1, {most}))", content, f"if({unusable}, 1.0D, _j_score)")
    return out


_VERDICT = ("named_struct('idx', r.idx, 'parent', r.parent, 'contract_id', r.id, 'contract_type', r.type, 'action', if(o.failed, r.action, null), "
            "'tier', r.tier, 'passed', not o.failed, 'compliance', o.compliance, 'message', o.message, 'evidence', o.evidence, 'location', o.location)")


def _composites(done: str, rules: str, height: int) -> str:
    """Verdicts of the composites of one height over the verdicts of their members."""
    members = f"array_sort(filter({done}, v -> v.parent = r.idx))"
    message = ("if(r.all_of, concat('Composite (AND) violated: all ', r.n, ' sub-contracts failed'), "
               "concat('Composite (OR) violated: ', size(bad), '/', r.n, ' sub-contracts failed'))")
    outcome = _outcome("case when r.n = 0 then r.all_of when r.all_of then size(bad) = r.n else size(bad) > 0 end", message,
                       "if(r.all_of, null, get(filter(bad, v -> v.message is not null), 0).message)", "cast(null as string)",
                       "coalesce(aggregate(ms, 0.0D, (s, v) -> s + v.compliance) / nullif(cast(r.n as double), 0.0D), 1.0D)")
    body = _let("ms", members, _let("bad", "filter(ms, v -> not v.passed)", _let("o", outcome, _VERDICT)))
    return f"concat({done}, transform(filter({rules}, r -> r.type = 'composite' and r.height = {height}), r -> {body}))"


BUILT_IN = {"keyword", "regex", "length_limit", "language_match", "sentiment", "topic_boundary", "llm_judge"}


# ------------------------------------------------------------------ kinds checked in Arrow batches
_MISSING = object()


def _resolve(value, path: str | None):
    """Dotted path into a parsed value; a part of digits is a key of an object or an index of an array."""
    for part in path.split(".") if path else []:
        if isinstance(value, dict) and part in value:
            value = value[part]
        elif isinstance(value, list) and part.isdecimal() and int(part) < len(value):
            value = value[int(part)]
        else:
            return _MISSING
    return value


def _schema_batch(frame: pd.DataFrame) -> pd.DataFrame:
    """JSON schemas: every distinct schema is prepared once a batch, every value parsed once a row."""
    checkers: dict[str, tuple] = {}
    out, last = [], (None, None)
    for text, extracted, params in zip(frame["document"], frame["extracted"], frame["params"]):
        if params not in checkers:
            p = json.loads(params)
            checkers[params] = (p.get("target_field"), js.value_checker(p.get("json_schema", {})))
        target, check = checkers[params]
        if text is not None and last[0] is not text:
            last = (text, json.loads(text))
        on_text = not extracted or (target or "").startswith("choices")
        if text is None or target and not target.startswith("choices") and not extracted:
            value = _MISSING
        else:
            value = last[1] if on_text else _resolve(last[1], target)
        message = (f"Could not extract target field {target!r}" if check else None) if value is _MISSING else check and check(value)
        shown = None if value is _MISSING else value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)
        out.append((message is not None, 0.0 if message is not None else 1.0, message and f"JSON Schema validation failed: {message}",
                    shown, target or "response"))
    return pd.DataFrame(out, columns=["failed", "compliance", "message", "evidence", "location"])


BATCHES: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {"schema": _schema_batch}


def _in_batches(check: Callable[[pd.DataFrame], pd.DataFrame], rules: Column, c: dict) -> Column:
    """Array of outcomes of ``rules``; ``check`` sees one row per response and rule, and no row of a response without.

    It is marked as not deterministic: else the optimizer repeats it in filters that it infers from what reads the array
    (``inline``), and every task runs the check twice, in two Python processes."""
    most = c["shown_chars"]

    def run(params: pd.Series, response: pd.Series, request: pd.Series, document: pd.Series, extracted: pd.Series) -> pd.Series:
        sizes = [0 if p is None else len(p) for p in params]
        rows = [k for k, n in enumerate(sizes) for _ in range(n)]
        texts = [x for p in params if p is not None for x in p]
        out: list[list] = [[] for _ in sizes]
        for at in range(0, len(rows), CHECKED_ROWS):
            some = rows[at:at + CHECKED_ROWS]
            frame = pd.DataFrame({n: s.iloc[some].tolist() for n, s in (("response", response), ("request", request), ("document", document),
                                                                        ("extracted", extracted))}, dtype=object)
            frame["params"] = texts[at:at + CHECKED_ROWS]
            for k, r in zip(some, check(frame).to_dict("records")):
                shown = {n: r[n] if r["failed"] and isinstance(r[n], str) else None for n in ("message", "evidence", "location")}
                shown["evidence"] = shown["evidence"] and shown["evidence"][:most]
                out[k].append({"failed": bool(r["failed"]), "compliance": float(r["compliance"]), **shown})
        return pd.Series(out)
    needed, unread = F.size(rules) > 0, F.lit(None).cast("string")
    texts = [unread if check is _schema_batch else F.when(needed, c[n]) for n in ("response", "request")]      # schemas read the document alone
    return F.pandas_udf(run, f"array<{OUTCOME}>").asNondeterministic()(
        F.transform(rules, lambda r: r["params"]), *texts, F.when(needed, c["document"]), F.lit(c["payload"]))


# ------------------------------------------------------------------ evaluation
def _features(df: DataFrame, kinds: set[str], key: str, c: dict, judge: Callable) -> DataFrame:
    """What kernels share, once per response that has an app. They come before the rules are joined: were they projected
    just below the kernels, the optimizer would move them into the lambdas and repeat them for every rule."""
    def here(x: Column) -> Column:
        return F.when(F.col(key).isNotNull(), x)

    def hits(tokens: str, words: list[str]) -> str:
        return f"size(filter({tokens}, t -> t in ({', '.join(map(_q, words))})))"

    def language(tokens: str) -> Column:      # most stop words (ties: smaller code)
        found = ", ".join(f"named_struct('k', -{hits(tokens, words)}, 'code', '{code}')" for code, words in sorted(tx.STOP_WORDS.items()))
        return F.expr(_let("b", f"array_min(array({found}))", "if(b.k < 0, b.code, null)"))
    if "keyword" in kinds:
        df = df.withColumn("_lower", here(F.lower(c["response"])))
    if kinds & {"language_match", "sentiment", "topic_boundary"}:
        df = df.withColumns({"_toks": here(tx.tokens(c["response"])), "_resp_blank": here(tx.is_blank(c["response"])),
                             "_req_blank": here(tx.is_blank(c["request"]))})
    shared = {}
    if "language_match" in kinds:
        df = df.withColumn("_req_toks", here(tx.tokens(c["request"])))
        shared |= {"_resp_lang": language("_toks"), "_req_lang": language("_req_toks")}
    if "sentiment" in kinds:
        up, down = hits("_toks", tx.POSITIVE_WORDS), hits("_toks", tx.NEGATIVE_WORDS)
        shared["_sent"] = F.expr(_let("x", f"named_struct('p', cast({up} as double), 'n', cast({down} as double))",
                                      "if(x.p + x.n = 0, 0.0D, (x.p - x.n) / (x.p + x.n))"))
    if "topic_boundary" in kinds:
        shared["_topics"] = F.expr("map(" + ", ".join(f"{_q(t)}, {hits('_toks', ws)}" for t, ws in tx.TOPIC_WORDS.items()) + ")")
    if "length_limit" in kinds:
        shared |= {"_words": here(tx.word_count(c["response"])), "_sents": here(tx.sentence_count(c["response"]))}
    df = df.withColumns(shared) if shared else df
    if "llm_judge" in kinds and c["judge_raw"] is not None:
        df = judge(df.withColumn("_judge_raw", here(c["judge_raw"])), "_judge_raw")
    if "schema" in kinds and c["payload_value"] is None:      # text that is one JSON value is that value, other text a string
        text = c["response"]
        value = F.coalesce(strict_parse_json(text), F.try_variant_get(F.parse_json(F.to_json(F.array(text))), "$[0]", "variant"))
        df = df.withColumn("_document", here(F.to_json(value)))
    elif "schema" in kinds:
        df = df.withColumn("_document", here(F.to_json(c["payload_value"])))
    return df.drop("_toks", "_req_toks")


_TEMPORARY = ("_lower", "_resp_blank", "_req_blank", "_resp_lang", "_req_lang", "_sent", "_topics", "_words", "_sents",
              "_judge_raw", "_j_score", "_j_reason", "_j_path", "_document")


def evaluate(df: DataFrame, table: RuleTable, key: str, rules: str, out: str, c: dict, judge: Callable, plug_ins: dict) -> DataFrame:
    """``df`` with the rules of the app in ``key`` as ``rules``, and as ``out`` the verdicts of their top-level nodes, in order."""
    df = table.attach(_features(df, table.kinds, key, c, judge), key, rules)
    c = dict(c, document=F.col("_document") if "_document" in df.columns else F.lit(None).cast("string"))
    built_in, parts = _kernels(c), {}
    for kind in sorted(table.kinds - {"composite"}):
        of_kind = f"filter({rules}, r -> r.type = {_q(kind)})"
        name = f"_of_{kind}"
        if kind in BATCHES:
            df = df.withColumn("_of", F.expr(of_kind))
            df = df.withColumn("_batch", _in_batches(BATCHES[kind], F.col("_of"), c)) \
                .withColumn(name, F.expr(f"zip_with(_of, _batch, (r, o) -> {_VERDICT})")).drop("_of", "_batch")
        elif kind in plug_ins:
            df = df.withColumn("_of", F.expr(of_kind)).withColumn("_own", F.transform("_of", _plugged(plug_ins[kind], c)))
            outcome = "named_struct('failed', not v.passed, 'compliance', v.compliance, 'message', v.message, 'evidence', v.evidence, 'location', v.location)"
            df = df.withColumn(name, F.expr(f"zip_with(_of, _own, (r, v) -> {_let('o', outcome, _VERDICT)})")).drop("_of", "_own")
        else:
            parts[name] = F.expr(f"transform({of_kind}, r -> {_let('o', built_in[kind], _VERDICT)})")
    names = [f"_of_{k}" for k in sorted(table.kinds - {"composite"})]
    df = df.withColumns(parts) if parts else df
    empty = ("cast(array() as array<struct<idx:int,parent:int,contract_id:string,contract_type:string,action:string,tier:string,"
             "passed:boolean,compliance:double,message:string,evidence:string,location:string>>)")
    df = df.withColumn(out, F.expr(f"concat({', '.join([empty, *names])})")).drop(*_TEMPORARY, *names)
    for height in range(1, table.height + 1):
        df = df.withColumn(out, F.expr(_composites(out, rules, height)))
    fields = ("contract_id", "contract_type", "action", "tier", "passed", "compliance", "message", "evidence", "location")
    return df.withColumn(out, F.expr(f"transform(array_sort(filter({out}, v -> v.parent = -1)), v -> named_struct("
                                     + ", ".join(f"'{f}', v.{f}" for f in fields) + "))"))


def _plugged(compiler: Callable, c: dict) -> Callable[[Column], Column]:
    return lambda r: compiler(RuleRef(r["id"], r["type"], r["action"], r["tier"], r["params"]), c).cast(VERDICT)
