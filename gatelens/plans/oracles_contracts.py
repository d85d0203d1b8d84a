"""SQL twins for the contract family (DuckDB), rendered from the same rule files."""

from __future__ import annotations

import glob
import json
import os

from gatelens.functions import text as tx
from gatelens.functions.lexicon import TOKEN_SPLIT
from gatelens.operators import contracts as ct
from gatelens.plans import fixtures as fx
from gatelens.plans.oracles import ORACLES, lst, q, with_

NON_WS = tx.NON_WS


def tok(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), {q(TOKEN_SPLIT)}), lambda t: t <> '')"


def count_in(x: str, words) -> str:
    return f"len(list_filter({tok(x)}, lambda u: list_contains({lst(words)}, u)))"


def words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, {q(tx.WS + '+')}), lambda w: w <> ''))"


def sentences(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, {q(tx.SENTENCE_END)}), lambda s: regexp_matches(s, {q(NON_WS)})))"


def blank(x: str) -> str:
    return f"(NOT regexp_matches(coalesce({x}, ''), {q(NON_WS)}))"


def detect(x: str) -> str:
    codes = sorted(tx.STOP_WORDS)
    cnt = {c: count_in(x, tx.STOP_WORDS[c]) for c in codes}
    g = "greatest(" + ", ".join(cnt[c] for c in codes) + ")"
    return "(CASE WHEN " + g + " = 0 THEN NULL " + " ".join(f"WHEN {cnt[c]} = {g} THEN {q(c)}" for c in codes) + " END)"


def pyrepr(s: str) -> str:
    return repr(s)


# ------------------------------------------------------------------ per-kind SQL
def rule_sql(c: ct.Contract) -> dict:
    kind = c.type
    R = "response"
    if kind == "keyword":
        cs = bool(c.p.get("case_sensitive", False))
        whole = bool(c.p.get("match_whole_word", False))
        st = R if cs else f"lower({R})"
        ev, msg = [], []
        for k in c.p.get("keywords", []):
            needle = k if cs else k.lower()
            found = (f"regexp_matches({st}, {q('(^|[^\\p{L}\\p{N}_])' + ct._quote(needle) + '([^\\p{L}\\p{N}_]|$)')})"
                     if whole else f"contains({st}, {q(needle)})")
            ev.append(f"WHEN {found} THEN {q(k)}")
            msg.append(f"WHEN {found} THEN {q('Response contains forbidden keyword: ' + pyrepr(k))}")
        e = "(CASE " + " ".join(ev) + " END)" if ev else "NULL"
        return dict(failed=f"({e} IS NOT NULL)", compliance=f"CASE WHEN ({e}) IS NOT NULL THEN 0.0 ELSE 1.0 END",
                    message="(CASE " + " ".join(msg) + " END)" if msg else "NULL", evidence=e,
                    location=q(ct.CONTENT_LOCATION))
    if kind == "regex":
        flags = ct.regex_flags(c)
        pre = f"(?{flags})" if flags else ""
        rx = pre + c.p["pattern"]
        lead = pre + "\\A((?s:.*?))(?:" + c.p["pattern"] + ")"
        m = f"regexp_extract({R}, {q(rx)}, 0)"
        start = f"length(regexp_extract({R}, {q(lead)}, 1))"
        return dict(failed=f"regexp_matches({R}, {q(rx)})",
                    compliance=f"CASE WHEN regexp_matches({R}, {q(rx)}) THEN 0.0 ELSE 1.0 END",
                    message=q("Response matches forbidden pattern: " + repr(c.p["pattern"])),
                    evidence=f"substring({m}, 1, 200)",
                    location=f"'{ct.CONTENT_LOCATION}[' || CAST({start} AS VARCHAR) || ':' || CAST({start} + length({m}) AS VARCHAR) || ']'")
    if kind == "length_limit":
        parts = []
        if c.p.get("max_words") is not None:
            n = words(R)
            parts.append(f"CASE WHEN {n} > {c.p['max_words']} THEN 'Word count ' || CAST({n} AS VARCHAR) || ' exceeds limit {c.p['max_words']}' END")
        if c.p.get("max_characters") is not None:
            n = f"length({R})"
            parts.append(f"CASE WHEN {n} > {c.p['max_characters']} THEN 'Character count ' || CAST({n} AS VARCHAR) || ' exceeds limit {c.p['max_characters']}' END")
        if c.p.get("max_sentences") is not None:
            n = sentences(R)
            parts.append(f"CASE WHEN {n} > {c.p['max_sentences']} THEN 'Sentence count ' || CAST({n} AS VARCHAR) || ' exceeds limit {c.p['max_sentences']}' END")
        msg = "concat_ws('; ', " + ", ".join(parts) + ")"
        return dict(failed=f"({msg} <> '')", compliance=f"CASE WHEN {msg} <> '' THEN 0.0 ELSE 1.0 END", message=msg,
                    evidence=f"'text_length=' || CAST(length({R}) AS VARCHAR)", location=q(ct.CONTENT_LOCATION))
    if kind == "language_match":
        code = c.p.get("expected_language")
        exp = q(code) if code else detect("request")
        det = detect(R)
        skip = f"({blank(R)} OR {'false' if code else blank('request')} OR {exp} IS NULL OR {det} IS NULL)"
        failed = f"(NOT {skip} AND {det} <> {exp})"
        return dict(failed=failed, compliance=f"CASE WHEN coalesce({failed}, false) THEN 0.0 ELSE 1.0 END",
                    message=f"'Language mismatch: expected ''' || {exp} || ''', detected ''' || {det} || ''''",
                    evidence=f"'detected=' || {det} || ', expected=' || {exp}", location=q(ct.CONTENT_LOCATION))
    if kind == "sentiment":
        mn = float(c.p.get("min_score", 0.0))
        p = f"CAST({count_in(R, tx.POSITIVE_WORDS)} AS DOUBLE)"
        n = f"CAST({count_in(R, tx.NEGATIVE_WORDS)} AS DOUBLE)"
        comp = f"(CASE WHEN {p} + {n} = 0 THEN 0.0 ELSE ({p} - {n}) / ({p} + {n}) END)"
        empty = f"({R} = '')"
        if mn >= 0:
            compliance = f"greatest(0.0, least(1.0, ({comp} - CAST({mn} AS DOUBLE) + 1.0) / 2.0))"
        else:
            compliance = f"CASE WHEN {comp} >= {mn} THEN 1.0 ELSE 0.0 END"
        shown = f"printf('%.3f', {comp})"
        return dict(failed=f"(NOT {empty} AND NOT ({comp} >= {mn}))",
                    compliance=f"CASE WHEN {empty} THEN 1.0 ELSE {compliance} END",
                    message=f"'Response sentiment score ' || {shown} || ' is below minimum threshold {mn:.3f}'",
                    evidence=f"'sentiment_score=' || {shown}", location=q(ct.CONTENT_LOCATION))
    if kind == "topic_boundary":
        allowed = list(c.p.get("allowed_topics", []))
        off = c.p.get("off_topic_label", "off_topic")
        thr = float(c.p.get("threshold", 0.5))
        hits = [count_in(R, tx.TOPIC_WORDS.get(t.lower(), [])) for t in allowed]
        others = [t for t in tx.TOPIC_WORDS if t not in set(a.lower() for a in allowed)]
        off_h = "(" + " + ".join(count_in(R, tx.TOPIC_WORDS[t]) for t in others) + ")" if others else "0"
        hs = hits + [off_h]
        labels = allowed + [off]
        total = "(" + " + ".join(hs) + ")"
        mx = "greatest(" + ", ".join(hs) + ")" if len(hs) > 1 else hs[0]
        top = "(CASE " + " ".join(f"WHEN {h} = {mx} THEN {q(lab)}" for lab, h in zip(labels, hs)) + " END)"
        top_score = f"(CAST({mx} AS DOUBLE) / CAST({total} AS DOUBLE))"
        allowed_sum = "(" + " + ".join(hits) + ")" if hits else "0"
        no_signal = f"({blank(R)} OR {total} = 0)"
        top_allowed = f"({top} IN ({', '.join(q(a) for a in allowed)}))" if allowed else "false"
        return dict(failed=f"(NOT {no_signal} AND NOT ({top_allowed} AND {top_score} >= {thr}))",
                    compliance=f"CASE WHEN {no_signal} THEN 1.0 ELSE round(CAST({allowed_sum} AS DOUBLE) / CAST({total} AS DOUBLE), 6) END",
                    message=(f"'Response classified as ''' || {top} || ''' (' || printf('%.3f', {top_score}) || "
                             + q(f") which is outside allowed topics: {allowed}")),
                    evidence=f"'top_label=' || {top} || ', score=' || printf('%.3f', {top_score})", location=q(ct.CONTENT_LOCATION))
    if kind == "llm_judge":
        thr = float(c.p.get("threshold", 0.7))
        unusable = "(judge_raw IS NULL OR j_path = 'error')"
        return dict(failed=f"(NOT {unusable} AND j_score < {thr})",
                    compliance=f"CASE WHEN {unusable} THEN 1.0 ELSE j_score END",
                    message=f"'LLM judge scored ' || printf('%.3f', j_score) || ' (threshold {thr:.3f}): ' || coalesce(j_reason, '')",
                    evidence="'score=' || printf('%.3f', j_score) || ', reasoning=' || substring(coalesce(j_reason, ''), 1, 200)",
                    location=q(ct.CONTENT_LOCATION))
    if kind == "schema":
        # responses are text: JSON when they parse, else a string value
        target = c.p.get("target_field")
        chk = schema_sql(c.p.get("json_schema", {}), "response", "$", is_text_root=True)
        msg = f"('JSON Schema validation failed: ' || {chk})"
        return dict(failed=f"({chk} IS NOT NULL)", compliance=f"CASE WHEN {chk} IS NOT NULL THEN 0.0 ELSE 1.0 END",
                    message=msg, evidence="CASE WHEN json_valid(response) THEN substring(CAST(json(response) AS VARCHAR), 1, 200) ELSE substring(response, 1, 200) END",
                    location=q(target or "response"))
    if kind == "composite":
        subs = [rule_sql(m) for m in c.members]
        n = len(subs)
        op = c.p.get("operator", "OR")
        if n == 0:
            return dict(failed="true" if op == "AND" else "false", compliance="1.0",
                        message=q("Composite (AND) violated: all 0 sub-contracts failed"), evidence="NULL", location="NULL")
        nfail = "(" + " + ".join(f"CASE WHEN coalesce({s['failed']}, false) THEN 1 ELSE 0 END" for s in subs) + ")"
        comp = "((" + " + ".join(f"CAST({s['compliance']} AS DOUBLE)" for s in subs) + f") / {float(n)})"
        if op == "OR":
            return dict(failed=f"({nfail} > 0)", compliance=comp,
                        message=f"'Composite (OR) violated: ' || CAST({nfail} AS VARCHAR) || '/{n} sub-contracts failed'",
                        evidence="(CASE " + " ".join(f"WHEN coalesce({s['failed']}, false) THEN {s['message']}" for s in subs) + " END)",
                        location="NULL")
        return dict(failed=f"({nfail} = {n})", compliance=comp,
                    message=q(f"Composite (AND) violated: all {n} sub-contracts failed"), evidence="NULL", location="NULL")
    raise ValueError(kind)


def schema_sql(schema: dict, doc: str, path: str, is_text_root: bool = False) -> str:
    """Failure message or NULL for the supported JSON-Schema subset (mirrors the Spark compiler's check order)."""
    if is_text_root:
        jt = f"(CASE WHEN json_valid({doc}) THEN json_type({doc}) ELSE 'VARCHAR' END)"
        present = "true"
        num = f"CAST(json_extract({doc}, '$') AS DOUBLE)"
    else:
        jt = f"json_type({doc}, {q(path)})"
        present = f"(json_extract({doc}, {q(path)}) IS NOT NULL)"
        num = f"CAST(json_extract({doc}, {q(path)}) AS DOUBLE)"
    types = {"object": f"{jt} = 'OBJECT'", "array": f"{jt} = 'ARRAY'", "string": f"{jt} = 'VARCHAR'",
             "boolean": f"{jt} = 'BOOLEAN'", "null": f"{jt} = 'NULL'",
             "integer": f"{jt} IN ('BIGINT', 'UBIGINT')", "number": f"{jt} IN ('BIGINT', 'UBIGINT', 'DOUBLE')"}
    checks = []
    if "type" in schema:
        ts = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        ok = " OR ".join(f"coalesce({types[t]}, false)" for t in ts)
        checks.append(f"CASE WHEN NOT ({ok}) THEN {q('is not of type ' + ' or '.join(ts))} END")
    is_obj = f"coalesce({types['object']}, false)"
    base = "$" if is_text_root else path
    for k in schema.get("required", []):
        checks.append(f"CASE WHEN {is_obj} AND json_extract({doc}, {q(base + '.' + k)}) IS NULL THEN {q(repr(k) + ' is a required property')} END")
    for k, sub in schema.get("properties", {}).items():
        child = base + "." + k
        checks.append(f"CASE WHEN {is_obj} AND json_extract({doc}, {q(child)}) IS NOT NULL THEN {schema_sql(sub, doc, child)} END")
    isnum = f"coalesce({types['number']}, false)"
    for kw, op in (("minimum", "<"), ("maximum", ">"), ("exclusiveMinimum", "<="), ("exclusiveMaximum", ">=")):
        if kw in schema:
            checks.append(f"CASE WHEN {isnum} AND {num} {op} {float(schema[kw])} THEN {q(f'violates {kw} {schema[kw]}')} END")
    _ = present
    return "coalesce(" + ", ".join(checks) + ")" if len(checks) > 1 else (checks[0] if checks else "NULL")


# ------------------------------------------------------------------ CTEs
TURN_PAIRS = """tp0 AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS response,
    coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (
      PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS request
  FROM conversations)"""

JC = f"regexp_replace(judge_raw, {q('^' + tx.WS + '+|' + tx.WS + '+$')}, '', 'g')"


def _score_from(doc: str) -> dict:
    is_obj = f"coalesce(json_type({doc}) = 'OBJECT', false)"
    st = f"json_type({doc}, '$.score')"
    str_val = f"TRY_CAST(json_extract_string({doc}, '$.score') AS DOUBLE)"
    err = f"({is_obj} AND {st} IS NOT NULL AND {st} IN ('NULL', 'OBJECT', 'ARRAY'))"
    bad_str = f"coalesce({st} = 'VARCHAR' AND {str_val} IS NULL, false)"
    ok = f"({is_obj} AND NOT {err} AND NOT {bad_str})"
    score = (f"CASE WHEN {st} IS NULL THEN 0.5 WHEN {st} = 'BOOLEAN' THEN CASE WHEN CAST(json_extract({doc}, '$.score') AS VARCHAR) = 'true' THEN 1.0 ELSE 0.0 END "
             f"WHEN {st} = 'VARCHAR' THEN {str_val} ELSE CAST(json_extract({doc}, '$.score') AS DOUBLE) END")
    rt = f"json_type({doc}, '$.reasoning')"
    reason = (f"CASE WHEN {rt} IS NULL THEN '' WHEN {rt} = 'VARCHAR' THEN json_extract_string({doc}, '$.reasoning') "
              f"WHEN {rt} = 'NULL' THEN 'None' WHEN {rt} = 'BOOLEAN' THEN CASE WHEN CAST(json_extract({doc}, '$.reasoning') AS VARCHAR) = 'true' THEN 'True' ELSE 'False' END "
              f"ELSE CAST(json_extract({doc}, '$.reasoning') AS VARCHAR) END")
    return dict(ok=ok, err=err, score=score, reason=reason)


_s1 = _score_from("j1doc")
_s2 = _score_from("j2doc")
_FENCE = "(?s)```(?:json)?" + tx.WS + "*(\\{.*?\\})" + tx.WS + "*```"

JUDGED = f"""{TURN_PAIRS},
tp AS (
  SELECT conv_id, turn, 'app_' || CAST(conv_id % 3 AS VARCHAR) AS app_id, request, response,
    {lst(fx.JUDGE_SCORE_TEMPLATES)}[(conv_id + turn) % 8 + 1] AS judge_raw
  FROM tp0 WHERE role = 'assistant'),
tj1 AS (SELECT *, {JC} AS jc FROM tp),
tj2 AS (SELECT *, CASE WHEN regexp_extract(jc, {q(_FENCE)}, 1) <> '' THEN regexp_extract(jc, {q(_FENCE)}, 1) END AS fenced,
               regexp_extract(jc, '([0-9]+\\.?[0-9]*)', 1) AS num FROM tj1),
tj2b AS (SELECT *, CASE WHEN json_valid(jc) THEN jc END AS j1doc, CASE WHEN json_valid(fenced) THEN fenced END AS j2doc FROM tj2),
tj3 AS (SELECT *,
    CASE WHEN {_s1['ok']} THEN 'json' WHEN {_s1['err']} THEN 'error' WHEN {_s2['ok']} THEN 'fenced' WHEN {_s2['err']} THEN 'error'
         WHEN num <> '' THEN 'number' ELSE 'default' END AS j_path,
    {_s1['score']} AS s1, {_s1['reason']} AS r1, {_s2['score']} AS s2, {_s2['reason']} AS r2,
    CASE WHEN TRY_CAST(num AS DOUBLE) > 1.0 THEN TRY_CAST(num AS DOUBLE) / 100.0 ELSE TRY_CAST(num AS DOUBLE) END AS s3
  FROM tj2b),
tpj AS (SELECT conv_id, turn, app_id, request, response, judge_raw, j_path,
    round(greatest(0.0, least(1.0, CASE j_path WHEN 'json' THEN s1 WHEN 'fenced' THEN s2 WHEN 'number' THEN s3 WHEN 'default' THEN 0.5 END)), 6) AS j_score,
    CASE j_path WHEN 'json' THEN r1 WHEN 'fenced' THEN r2 WHEN 'number' THEN substring(jc, 1, 200)
      WHEN 'default' THEN 'Could not parse judge response: ' || substring(jc, 1, 200) END AS j_reason
  FROM tj3)"""


def verdict_select(app: str, c: ct.Contract, pos: int, keys="conv_id, turn", src="tpj") -> str:
    r = rule_sql(c)
    f = f"coalesce({r['failed']}, false)"
    return (f"SELECT {keys}, app_id, {q(c.id)} AS contract_id, {q(c.type)} AS contract_type, "
            f"CASE WHEN {f} THEN {q(c.action)} END AS action, {q(ct.static_tier(c))} AS tier, NOT {f} AS passed, "
            f"CAST({r['compliance']} AS DOUBLE) AS compliance, CAST(CASE WHEN {f} THEN {r['message']} END AS VARCHAR) AS message, "
            f"CAST(CASE WHEN {f} THEN {r['evidence']} END AS VARCHAR) AS evidence, "
            f"CAST(CASE WHEN {f} THEN {r['location']} END AS VARCHAR) AS location, "
            f"{pos} AS rule_pos, {str(c.action == 'block').lower()} AS is_block "
            f"FROM {src} WHERE app_id = {q(app)}")


def all_verdicts(defs: dict) -> str:
    sels = [verdict_select(a, c, i) for a in sorted(defs) for i, c in enumerate(defs[a]) if c.enabled]
    return "allv AS (\n" + "\nUNION ALL\n".join(sels) + ")"


def _defs(kinds=None):
    defs, _ = ct.load_definitions(ct.CONTRACT_DIR)
    if kinds:
        defs = {a: [r for r in rs if r.type in kinds] for a, rs in defs.items()}
    return defs


VCOLS = "conv_id, turn, app_id, contract_id, contract_type, action, tier, passed, compliance, message, evidence, location"

for _kind, _key in [("keyword", "contract_keyword"), ("regex", "contract_regex"), ("length_limit", "contract_length"),
                    ("language_match", "contract_language"), ("sentiment", "contract_sentiment"),
                    ("topic_boundary", "contract_topic"), ("llm_judge", "contract_judge"),
                    ("composite", "contract_composite")]:
    ORACLES[_key] = with_(JUDGED, all_verdicts(_defs([_kind]))) + f"SELECT {VCOLS} FROM allv"

ORACLES["contract_verdicts"] = with_(JUDGED, all_verdicts(_defs())) + f"SELECT {VCOLS} FROM allv"

ORACLES["contract_tiered"] = with_(JUDGED, all_verdicts(_defs()), """blocked AS (
  SELECT DISTINCT conv_id, turn FROM allv WHERE is_block AND NOT passed)""") + f"""
SELECT {VCOLS} FROM allv a WHERE is_block OR NOT EXISTS (SELECT 1 FROM blocked b WHERE b.conv_id = a.conv_id AND b.turn = a.turn)"""


def _count_case(defs, pred) -> str:
    arms = " ".join(f"WHEN {q(a)} THEN {sum(1 for r in rs if r.enabled and pred(r))}" for a, rs in sorted(defs.items()))
    return f"CAST(CASE app_id {arms} ELSE 0 END AS INTEGER)"


_D = _defs()
ORACLES["contract_report"] = with_(JUDGED, all_verdicts(_D), """agg AS (
  SELECT conv_id, turn, bool_or(NOT passed) AS blocked,
    coalesce(string_agg(contract_id, ',' ORDER BY rule_pos) FILTER (WHERE NOT passed), '') AS violations,
    coalesce(string_agg(contract_id, ',' ORDER BY rule_pos) FILTER (WHERE passed AND compliance < 0.8), '') AS warnings
  FROM allv WHERE is_block GROUP BY conv_id, turn)""") + f"""
SELECT p.conv_id, p.turn, p.app_id, coalesce(a.blocked, false) AS blocked, coalesce(a.violations, '') AS violations,
  coalesce(a.warnings, '') AS warnings,
  {_count_case(_D, lambda r: r.action == 'block')} AS block_count,
  {_count_case(_D, lambda r: r.action != 'block')} AS flag_count,
  {_count_case(_D, lambda r: True)} AS total_contracts
FROM tp p LEFT JOIN agg a ON p.conv_id = a.conv_id AND p.turn = a.turn"""

ORACLES["contract_rollup"] = with_(JUDGED, all_verdicts(_D)) + """
SELECT app_id, contract_id, contract_type, tier, count(*) AS evaluations, count_if(NOT passed) AS violations,
  (CAST(floor((sum(CAST(round(compliance * 1e6) AS BIGINT)) / count(*) / 1e6) * 1000000.0 + 0.5) AS DOUBLE) / 1000000.0) AS mean_compliance
FROM allv GROUP BY app_id, contract_id, contract_type, tier"""

ORACLES["judge_score_parse"] = with_(JUDGED) + "SELECT conv_id, turn, j_score AS score, j_reason AS reasoning, j_path AS path FROM tpj"

_jr = [f"SELECT conv_id, turn, app_id, {q(r.id)} AS contract_id, {q(r.p['assertion'])} AS assertion, response FROM tp WHERE app_id = {q(a)}"
       for a, rs in sorted(_D.items()) for r in rs if r.enabled and r.type == "llm_judge"]
ORACLES["judge_requests"] = with_(JUDGED) + "\nUNION ALL\n".join(_jr)

ORACLES["resolve_path"] = """
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum,
  count(*) FILTER (WHERE json_extract(props, '$.k') IS NULL) AS k_unresolved,
  round(avg(CASE WHEN json_extract(props, '$.k[0]') IS NULL THEN 1.0 ELSE 0.0 END), 6) AS bad_path_unresolved_rate
FROM events GROUP BY event_type"""


def _event_schema_select(app: str, d: dict) -> str:
    c = ct.parse_contract(d)
    target = c.p.get("target_field")
    jp = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in target.split(".")) if target else "$"
    chk = schema_sql(c.p["json_schema"], "props", jp)
    present = "json_valid(props)" if jp == "$" else f"json_extract(props, {q(jp)}) IS NOT NULL"
    msg = f"CASE WHEN NOT ({present}) THEN {q('Could not extract target field ' + repr(target))} ELSE {chk} END"
    f = f"({msg}) IS NOT NULL"
    return (f"SELECT event_id, 'app_' || CAST(user_id % 3 AS VARCHAR) AS app_id, {q(c.id)} AS contract_id, "
            f"CASE WHEN {f} THEN {q(c.action)} END AS action, NOT ({f}) AS passed, CAST(CASE WHEN {f} THEN 0.0 ELSE 1.0 END AS DOUBLE) AS compliance, "
            f"CASE WHEN {f} THEN 'JSON Schema validation failed: ' || ({msg}) END AS message, "
            f"CASE WHEN {f} THEN {q(target or 'response')} END AS location "
            f"FROM events WHERE user_id % 3 = {int(app.split('_')[1])}")


ORACLES["contract_schema"] = "\nUNION ALL\n".join(
    _event_schema_select(a, d) for a, ds in sorted(fx.EVENT_SCHEMA_RULES.items()) for d in ds)

_cat_values = ", ".join(f"({q(a)}, {q(','.join(sorted(r.id for r in rs if r.enabled)))}, {sum(1 for r in rs if r.enabled)})"
                        for a, rs in sorted(_D.items()))
ORACLES["contract_catalog"] = with_(JUDGED) + f"""
SELECT c.app_id, c.enabled_rules, CAST(c.n_enabled AS INTEGER) AS n_enabled, CAST(coalesce(t.n, 0) AS BIGINT) AS responses
FROM (VALUES {_cat_values}) c(app_id, enabled_rules, n_enabled)
LEFT JOIN (SELECT app_id, count(*) AS n FROM tp GROUP BY app_id) t ON c.app_id = t.app_id"""


def _lint_rows():
    rows = []
    for d in (ct.CONTRACT_DIR, ct.INVALID_CONTRACT_DIR):
        for path in sorted(glob.glob(os.path.join(d, "*.json"))):
            name = os.path.basename(path)
            try:
                doc = json.load(open(path, encoding="utf-8"))
            except ValueError:
                rows.append((name, None, None, "malformed JSON"))
                continue
            for c in doc.get("contracts", []):
                for reason in ct.lint_contract(c):
                    rows.append((name, doc.get("app_id"), c.get("id"), reason))
    return rows


def _v(x):
    return "NULL" if x is None else q(x)


ORACLES["contract_lint"] = with_(JUDGED) + f"""
SELECT l.file_name, l.app_id, l.contract_id, l.reason, CAST(coalesce(t.n, 0) AS BIGINT) AS affected_responses
FROM (VALUES {", ".join(f"({_v(a)}, {_v(b)}, {_v(c)}, {_v(d)})" for a, b, c, d in _lint_rows())}) l(file_name, app_id, contract_id, reason)
LEFT JOIN (SELECT app_id, count(*) AS n FROM tp GROUP BY app_id) t ON l.app_id = t.app_id"""

from gatelens.plans.oracles import SERIES, STATS  # noqa: E402

ORACLES["contract_counts"] = with_(JUDGED, all_verdicts(_D), """blocked AS (
  SELECT DISTINCT conv_id, turn FROM allv WHERE is_block AND NOT passed),
tiered AS (SELECT * FROM allv a WHERE is_block OR NOT EXISTS (
  SELECT 1 FROM blocked b WHERE b.conv_id = a.conv_id AND b.turn = a.turn))""", SERIES, STATS) + """
SELECT (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM tiered WHERE action = 'block' AND NOT passed)) AS blocks,
  count_if(NOT passed AND action = 'flag') AS flags,
  (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM tiered WHERE action = 'block' AND NOT passed)) AS total_violations, count_if(tier = 'deterministic') AS eval_deterministic,
  count_if(tier = 'classifier') AS eval_classifier, count_if(tier = 'llm_judge') AS eval_llm_judge,
  (SELECT count(*) FROM alerts) AS drift_alerts
FROM tiered"""

ORACLES["stream_contracts"] = ORACLES["contract_tiered"]
