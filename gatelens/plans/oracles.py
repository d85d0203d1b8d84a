"""SQL twins of the registered queries, written for DuckDB over the supplied views.

Derived fixtures are rebuilt here as CTEs from the same rules stated in
``gatelens.plans.fixtures`` (fixed values are shared; the logic is SQL).
"""

from __future__ import annotations

from gatelens.functions.lexicon import INJECTION_BIAS, INJECTION_CUES, INSULT_WORDS
from gatelens.functions.patterns import ordered_rules
from gatelens.functions.text import WS
from gatelens.operators.detection import LEET_SIGNALS, ROLEPLAY_SIGNALS
from gatelens.plans import fixtures as fx

ORACLES: dict[str, str] = {}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


NL = "chr(10)"

# ------------------------------------------------------------------ fixture CTEs
FLAT = f"""flat AS (
  SELECT conv_id, coalesce(string_agg(coalesce(role, 'unknown') || ': ' || text, {NL} ORDER BY turn), '') AS prompt
  FROM conversations GROUP BY conv_id)"""

ATTACK = f"""attack_corpus AS (
  SELECT conv_id,
    CASE WHEN conv_id % 5 IN (0, 1) THEN prompt || {NL} || 'user: ' || {lst(fx.ATTACK_PHRASES)}[(conv_id // 5) % 8 + 1]
         WHEN conv_id % 11 = 3 THEN prompt || {NL} || 'user: ' || {q(fx.DECOY_PHRASE)}
         ELSE prompt END AS prompt,
    CAST(CASE WHEN conv_id % 5 IN (0, 1) THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM flat)"""

SCORED = rf"""ld AS (
  SELECT d.doc_id, d.text, d.source, d.lang, l.toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
sc0 AS (
  SELECT doc_id, label, text,
    CAST(len(list_intersect(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> ''),
                            {lst(INSULT_WORDS)})) AS DOUBLE) AS h,
    CAST(5 + doc_id % 97 AS DOUBLE) AS latency_ms,
    CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS noise
  FROM ld),
sc1 AS (SELECT *, h / (h + 3.0) AS a FROM sc0),
scored AS (
  SELECT 'lex-a' AS model, doc_id, label, round(a, 6) AS prob, latency_ms, text FROM sc1
  UNION ALL SELECT 'lex-b', doc_id, label, round(CAST(0.7 AS DOUBLE) * a + CAST(0.3 AS DOUBLE) * noise, 6), latency_ms, text FROM sc1
  UNION ALL SELECT 'lex-c', doc_id, label, round(a * a, 6), latency_ms, text FROM sc1)"""

VERDICT_TEXTS = f"""vt AS (
  SELECT doc_id, replace({lst(fx.JUDGE_TEMPLATES)}[doc_id % 10 + 1], '{{S}}', source) AS raw FROM documents)"""

VERDICTS = r"""vp1 AS (
  SELECT doc_id, raw,
    list_filter(list_transform(list_filter(string_split(raw, '```'), lambda x, i: i % 2 = 0),
                               lambda x: regexp_replace(regexp_replace(x, '^[json]+', ''), {q('^' + WS + '+|' + WS + '+$')}, '', 'g')),
                lambda x: starts_with(x, '{'))[1] AS first_obj
  FROM vt),
vp2 AS (
  SELECT doc_id, raw, CASE WHEN contains(raw, '```') AND first_obj IS NOT NULL THEN first_obj ELSE raw END AS t FROM vp1),
vp3 AS (
  SELECT doc_id, raw, t, strpos(t, '{') AS st, strpos(reverse(t), '}') AS lb, length(t) - strpos(reverse(t), '}') + 1 AS en FROM vp2),
vp4 AS (
  SELECT doc_id, raw,
    CASE WHEN st > 0 AND lb > 0 THEN CASE WHEN en >= st THEN substring(t, st, en - st + 1) ELSE '' END END AS cand FROM vp3),
vp5 AS (
  SELECT doc_id, raw, cand,
    CASE WHEN cand IS NULL THEN 'no_object' WHEN NOT json_valid(cand) OR cand = '' THEN 'bad_json' END AS error FROM vp4),
verdicts AS (
  SELECT doc_id, raw,
    CASE WHEN error IS NOT NULL THEN false
         WHEN json_extract(cand, '$.injection') IS NULL THEN false
         WHEN CAST(json_extract(cand, '$.injection') AS VARCHAR) IN ('false', 'null', '""', '[]', '{}') THEN false
         WHEN regexp_full_match(CAST(json_extract(cand, '$.injection') AS VARCHAR), '-?0+(\.0*)?([eE][+-]?[0-9]+)?') THEN false
         ELSE true END AS is_injection,
    CASE WHEN error IS NOT NULL THEN ''
         WHEN json_type(cand, '$.reason') IS NULL THEN ''
         WHEN json_type(cand, '$.reason') = 'VARCHAR' THEN json_extract_string(cand, '$.reason')
         WHEN json_type(cand, '$.reason') = 'NULL' THEN 'None'
         WHEN json_type(cand, '$.reason') = 'BOOLEAN' THEN CASE WHEN CAST(json_extract(cand, '$.reason') AS VARCHAR) = 'true' THEN 'True' ELSE 'False' END
         ELSE CAST(json_extract(cand, '$.reason') AS VARCHAR) END AS reason,
    error
  FROM vp5)"""
# str.strip(): Unicode whitespace, the same class the Spark side uses
VERDICTS = VERDICTS.replace("{q('^' + WS + '+|' + WS + '+$')}", q("^" + WS + "+|" + WS + "+$"))


def _rule_case(field: str, text: str = "prompt") -> str:
    rs = ordered_rules()
    parts = []
    for r in rs:
        rx = "(?is)" + r.regex
        if field == "pattern_id":
            v = q(r.id)
        elif field == "severity":
            v = q(r.severity)
        elif field == "matched_text":
            v = f"regexp_extract({text}, {q(rx)}, 0)"
        elif field == "match_start":
            v = f"CAST(length(regexp_extract({text}, {q('(?is)^(.*?)(?:' + r.regex + ')')}, 1)) AS INTEGER)"
        elif field == "match_end":
            v = (f"CAST(length(regexp_extract({text}, {q('(?is)^(.*?)(?:' + r.regex + ')')}, 1)) "
                 f"+ length(regexp_extract({text}, {q(rx)}, 0)) AS INTEGER)")
        parts.append(f"WHEN regexp_matches({text}, {q(rx)}) THEN {v}")
    return "CASE " + " ".join(parts) + " END"


def _scan_cols(text: str = "prompt") -> str:
    return ",\n  ".join(f"{_rule_case(c, text)} AS {c}" for c in
                        ["pattern_id", "severity", "matched_text", "match_start", "match_end"])


def _lexical(text: str) -> str:
    z = f"CAST({INJECTION_BIAS} AS DOUBLE)"
    for c, w in INJECTION_CUES:
        z += f" + CASE WHEN contains(lower(coalesce({text}, '')), {q(c)}) THEN CAST({w} AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"
    return f"round(1.0 / (1.0 + exp(-({z}))), 6)"


def _category(text: str) -> str:
    role = " OR ".join(f"contains(lower({text}), {q(s)})" for s in ROLEPLAY_SIGNALS)
    leet = " OR ".join(f"contains(lower({text}), {q(s)})" for s in LEET_SIGNALS)
    non_ascii = rf"length(regexp_replace({text}, '[\x00-\x7F]', '', 'g')) / greatest(length({text}), 1)"
    b64 = (f"len(list_filter(string_split_regex({text}, {q(WS + '+')}), lambda w: length(w) >= 20 AND "
           rf"regexp_full_match(regexp_replace(w, '[+/=]', '', 'g'), '[\p{{L}}\p{{N}}]+'))) > 0")
    return (f"CASE WHEN {role} THEN '[ROLE-PLAY]' WHEN {non_ascii} > 0.15 OR {b64} OR {leet} THEN '[OBFUSCATED]' "
            f"ELSE '[INDIRECT]' END")


SCAN = f"""scan AS (
  SELECT conv_id, label, prompt,
  {_scan_cols()}
  FROM attack_corpus)"""

DECISIONS = f"""dec0 AS (
  SELECT *, coalesce(severity IN ('high', 'critical'), false) AS t1 FROM scan),
dec1 AS (
  SELECT *, CASE WHEN NOT t1 THEN {_lexical('prompt')} END AS ml_prob FROM dec0),
decisions AS (
  SELECT *, t1 OR coalesce(ml_prob >= 0.85, false) AS blocked,
    CAST(CASE WHEN t1 THEN 1 WHEN coalesce(ml_prob >= 0.85, false) THEN 2 END AS INTEGER) AS tier_triggered,
    CASE WHEN t1 THEN 'Prompt injection detected by pattern guard (pattern: ''' || pattern_id || ''', severity: ' || severity || ')'
         WHEN coalesce(ml_prob >= 0.85, false) THEN 'Prompt injection detected by ML classifier' ELSE '' END AS reason
  FROM dec1)"""

# ------------------------------------------------------------------ 2.2
ORACLES["flatten_prompts"] = with_(FLAT) + "SELECT conv_id, prompt FROM flat"

ORACLES["last_user_text"] = """
SELECT conv_id, coalesce(max_by(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END), '') AS user_text
FROM conversations GROUP BY conv_id"""

ORACLES["turn_pairs"] = """
SELECT conv_id, turn, 'app_' || CAST(conv_id % 3 AS VARCHAR) AS app_id, request, response FROM (
  SELECT conv_id, turn, role, coalesce(text, '') AS response,
    coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (
      PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS request
  FROM conversations) WHERE role = 'assistant'"""

ORACLES["split_system"] = f"""
SELECT conv_id,
  string_agg(CASE WHEN role = 'system' THEN text END, {NL} ORDER BY turn) AS system,
  coalesce(string_agg(CASE WHEN role <> 'system' OR role IS NULL THEN coalesce(role, 'unknown') || ': ' || coalesce(text, '') END, {NL} ORDER BY turn), '') AS messages,
  count(CASE WHEN role <> 'system' OR role IS NULL THEN 1 END) AS n_messages
FROM conversations GROUP BY conv_id"""

ORACLES["filter_clean_prompts"] = """
SELECT source, count_if(length(text) BETWEEN 20 AND 512) AS kept, count_if(NOT (length(text) BETWEEN 20 AND 512)) AS dropped
FROM documents GROUP BY source"""

ORACLES["to_injection_prob"] = with_(SCORED, """raw AS (
  SELECT model, doc_id, label,
    CASE WHEN prob >= 0.5 THEN CASE model WHEN 'lex-a' THEN 'INJECTION' WHEN 'lex-b' THEN 'LABEL_1' ELSE 'harmful' END
         ELSE CASE model WHEN 'lex-a' THEN 'SAFE' WHEN 'lex-b' THEN 'LABEL_0' ELSE 'benign' END END AS top_label,
    CASE WHEN prob >= 0.5 THEN prob ELSE round(1.0 - prob, 6) END AS top_score
  FROM scored)""") + """
SELECT model, doc_id, top_label,
  round(CASE WHEN contains(upper(top_label), 'INJECTION') OR contains(upper(top_label), 'MALICIOUS')
              OR contains(upper(top_label), 'LABEL_1') OR contains(upper(top_label), 'HARMFUL')
             THEN top_score ELSE 1.0 - top_score END, 6) AS prob
FROM raw"""

# ------------------------------------------------------------------ 2.3
ORACLES["pattern_scan"] = with_(FLAT, ATTACK, SCAN) + """
SELECT conv_id, label, pattern_id, severity, matched_text, match_start, match_end FROM scan"""

_rules_values = ", ".join(f"({q(r.id)}, {q(r.severity)}, {i})" for i, r in enumerate(ordered_rules()))
ORACLES["pattern_rollup"] = with_(FLAT, ATTACK, SCAN) + f"""
SELECT r.pattern_id, r.severity, CAST(r.scan_order AS INTEGER) AS scan_order, count(s.conv_id) AS hits
FROM (VALUES {_rules_values}) r(pattern_id, severity, scan_order)
LEFT JOIN scan s ON s.pattern_id = r.pattern_id
GROUP BY r.pattern_id, r.severity, r.scan_order"""

ORACLES["scan_documents"] = f"""
SELECT lang, pattern_id, severity, count(*) AS n_docs FROM (
  SELECT lang, {_rule_case('pattern_id', 'text')} AS pattern_id, {_rule_case('severity', 'text')} AS severity FROM documents)
GROUP BY lang, pattern_id, severity"""

ORACLES["scan_pages"] = f"""
SELECT tld, pattern_id, severity, count(*) AS n_docs FROM (
  SELECT coalesce(regexp_extract(regexp_extract(url, '^https?://([^/]+)', 1), '\\.([a-z]+)$', 1), '') AS tld,
    {_rule_case('pattern_id', 'html')} AS pattern_id, {_rule_case('severity', 'html')} AS severity FROM pages)
GROUP BY tld, pattern_id, severity"""

ORACLES["tier2_scores"] = with_(FLAT, ATTACK) + f"""
SELECT conv_id, label, {_lexical('prompt')} AS ml_prob,
  CASE WHEN {_lexical('prompt')} >= 0.85 THEN 'INJECTION' ELSE 'BENIGN' END AS ml_label
FROM attack_corpus"""

ORACLES["guard_decisions"] = with_(FLAT, ATTACK, SCAN, DECISIONS) + """
SELECT conv_id, label, pattern_id, severity, ml_prob, blocked, tier_triggered, reason FROM decisions"""

ORACLES["guard_dry_run"] = with_(FLAT, ATTACK, SCAN, DECISIONS) + """
SELECT label, count(*) AS n, CAST(0 AS BIGINT) AS blocked, count_if(blocked) AS would_block,
  count_if(blocked) AS dry_run_marked
FROM decisions GROUP BY label"""

ORACLES["judge_queue"] = with_(FLAT, ATTACK, SCAN, DECISIONS) + """
SELECT conv_id, label, ml_prob FROM decisions WHERE NOT blocked AND ml_prob IS NOT NULL AND ml_prob BETWEEN 0.05 AND 0.40"""

ORACLES["judge_verdicts"] = with_(VERDICT_TEXTS, VERDICTS) + """
SELECT doc_id, is_injection, CASE WHEN is_injection THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, reason, error FROM verdicts"""

ORACLES["tier_disagreements"] = with_(SCORED, VERDICT_TEXTS, VERDICTS) + """
SELECT s.model, s.doc_id, s.prob,
  CASE WHEN v.is_injection IS NULL OR v.error IS NOT NULL THEN 'failed' WHEN v.is_injection THEN 'disagrees' ELSE 'agrees' END AS outcome
FROM scored s LEFT JOIN verdicts v ON s.doc_id = v.doc_id
WHERE s.prob BETWEEN 0.05 AND 0.40"""

ORACLES["attack_category"] = f"""
SELECT lang, {_category('text')} AS category, count(*) AS n FROM documents GROUP BY ALL"""

ORACLES["attack_category_corpus"] = with_(FLAT, ATTACK) + f"""
SELECT conv_id, label, {_category('prompt')} AS category FROM attack_corpus"""

# ------------------------------------------------------------------ 2.10
_CONF = """count_if(prob >= 0.5 AND label = 1) AS tp, count_if(prob >= 0.5 AND label <> 1) AS fp,
  count_if(prob < 0.5 AND label <> 1) AS tn, count_if(prob < 0.5 AND label = 1) AS fn"""


def _prf_cols() -> str:
    p = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END"
    r = "CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END"
    return (f"round({p}, 6) AS precision, round({r}, 6) AS recall, "
            f"round(CASE WHEN ({p}) + ({r}) = 0 THEN 0.0 ELSE 2.0 * ({p}) * ({r}) / (({p}) + ({r})) END, 6) AS f1, "
            f"round(CASE WHEN tp + fp + tn + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + fp + tn + fn) END, 6) AS accuracy")


ORACLES["confusion"] = with_(SCORED) + f"SELECT model, {_CONF} FROM scored GROUP BY model"

ORACLES["precision_recall_f1"] = with_(SCORED, f"c AS (SELECT model, {_CONF} FROM scored GROUP BY model)") + f"""
SELECT model, tp, fp, tn, fn, {_prf_cols()} FROM c"""

ORACLES["pr_curve"] = with_(SCORED, """th AS (SELECT CAST(round(0.10 + 0.05 * i, 2) AS DOUBLE) AS threshold FROM range(18) t(i))""",
                            """c AS (
  SELECT s.model, th.threshold, count_if(s.prob >= th.threshold AND s.label = 1) AS tp,
    count_if(s.prob >= th.threshold AND s.label <> 1) AS fp, count_if(s.label = 1) AS npos
  FROM scored s, th GROUP BY s.model, th.threshold)""") + """
SELECT model, threshold, tp, fp,
  round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN npos = 0 THEN 0.0 ELSE tp / npos END, 6) AS recall,
  round(CASE WHEN (CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END) + (CASE WHEN npos = 0 THEN 0.0 ELSE tp / npos END) = 0 THEN 0.0
    ELSE 2.0 * (CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END) * (CASE WHEN npos = 0 THEN 0.0 ELSE tp / npos END)
      / ((CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END) + (CASE WHEN npos = 0 THEN 0.0 ELSE tp / npos END)) END, 6) AS f1
FROM c"""

_ALL_SCORES = """dist AS (
  SELECT model, prob AS threshold, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM scored GROUP BY model, prob),
cum AS (
  SELECT model, threshold, pos, CAST(sum(pos) OVER up AS BIGINT) AS tp, CAST(sum(neg) OVER up AS BIGINT) AS fp,
    CAST(sum(pos) OVER (PARTITION BY model) AS BIGINT) AS npos
  FROM dist WINDOW up AS (PARTITION BY model ORDER BY threshold DESC)),
pts AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN npos = 0 THEN 0.0 ELSE tp / npos END AS r FROM cum),
curve AS (
  SELECT model, threshold, pos, npos, tp, fp, p, round(p, 6) AS precision, round(r, 6) AS recall,
    round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2.0 * p * r / (p + r) END, 6) AS f1 FROM pts)"""
ORACLES["pr_curve_all"] = with_(SCORED, _ALL_SCORES) + "SELECT model, threshold, tp, fp, precision, recall, f1 FROM curve"
ORACLES["average_precision"] = with_(SCORED, _ALL_SCORES) + """
SELECT model, count(*) AS n_thresholds, max(f1) AS best_f1,
  round(sum(CASE WHEN npos = 0 THEN 0.0 ELSE pos / npos * p END), 6) AS average_precision
FROM curve GROUP BY model"""

ORACLES["latency_summary"] = with_(SCORED) + """
SELECT model, count(*) AS n,
  round(quantile_cont(latency_ms, 0.5), 4) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 4) AS p95_ms,
  round(quantile_cont(latency_ms, 0.99), 4) AS p99_ms, round(count(*) / (sum(latency_ms) / 1000.0), 4) AS samples_per_s
FROM scored GROUP BY model"""

ORACLES["missed_attacks"] = with_(SCORED) + """
SELECT model, CAST(rank AS INTEGER) AS rank, doc_id, prob, snippet FROM (
  SELECT model, row_number() OVER (PARTITION BY model ORDER BY prob, doc_id) AS rank, doc_id, prob,
    substring(text, 1, 300) AS snippet
  FROM scored WHERE label = 1 AND prob < 0.5) WHERE rank <= 10"""

ORACLES["miss_categories"] = with_(SCORED) + f"""
SELECT model, category, n, round(n / sum(n) OVER (PARTITION BY model), 6) AS share FROM (
  SELECT model, {_category('text')} AS category, count(*) AS n FROM scored WHERE label = 1 AND prob < 0.5 GROUP BY ALL)"""

ORACLES["combined_recall"] = with_(SCORED, VERDICT_TEXTS, VERDICTS, """a AS (
  SELECT s.model, count(*) AS positives, count_if(s.prob >= 0.5) AS tier2_tp, count_if(s.prob < 0.5) AS misses,
    count_if(s.prob < 0.5 AND coalesce(v.is_injection AND v.error IS NULL, false)) AS judge_catches,
    count_if(s.prob < 0.5 AND v.error IS NOT NULL) AS judge_errors
  FROM scored s LEFT JOIN verdicts v ON s.doc_id = v.doc_id WHERE s.label = 1 GROUP BY s.model)""") + """
SELECT *, round(CASE WHEN positives = 0 THEN 0.0 ELSE tier2_tp / positives END, 6) AS tier2_recall,
  round(CASE WHEN positives = 0 THEN 0.0 ELSE (tier2_tp + judge_catches) / positives END, 6) AS combined_recall,
  round(CASE WHEN misses = 0 THEN 0.0 ELSE judge_catches / misses END, 6) AS catch_rate,
  round(CASE WHEN positives = 0 THEN 0.0 ELSE (tier2_tp + judge_catches) / positives END
      - CASE WHEN positives = 0 THEN 0.0 ELSE tier2_tp / positives END, 6) AS recall_delta
FROM a"""

ORACLES["model_comparison"] = with_(SCORED, f"c AS (SELECT model, {_CONF} FROM scored GROUP BY model)",
                                    """l AS (SELECT model, round(quantile_cont(latency_ms, 0.5), 4) AS p50_ms,
  round(quantile_cont(latency_ms, 0.99), 4) AS p99_ms FROM scored GROUP BY model)""") + f"""
SELECT c.model, tp, fp, tn, fn, {_prf_cols()}, p50_ms, p99_ms FROM c JOIN l ON c.model = l.model"""


def _bigint_counts(sql: str) -> str:
    """DuckDB's count_if returns HUGEINT; wrap each call in a BIGINT cast to match Spark's count types."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k + 1] + " AS BIGINT)")
        i = k + 1


def finalize() -> dict[str, str]:
    return {k: _bigint_counts(v) for k, v in ORACLES.items()}


# ------------------------------------------------------------------ 2.5 drift
AS_OF_SQL = f"TIMESTAMP '{fx.AS_OF}'"
SERIES = f"""cs AS (
  SELECT 'app_' || CAST(user_id % 3 AS VARCHAR) AS app_id, 'c_' || event_type AS contract_id, ts,
    floor((1.0 - 0.5 * least(value / 500.0, 1.0)) *
      CASE WHEN ts > {AS_OF_SQL} - INTERVAL 24 HOUR AND event_type = 'click' THEN 0.7
           WHEN ts > {AS_OF_SQL} - INTERVAL 24 HOUR AND event_type = 'error' AND user_id % 3 = 0 THEN 0.8
           ELSE 1.0 END * 10000.0 + 0.5) / 10000.0 AS score
  FROM events),
series AS (SELECT DISTINCT app_id, contract_id, ts, epoch_us(ts) AS ts_us, round(score, 4) AS score FROM cs)"""


def _win(hours) -> str:
    return f"ts >= {AS_OF_SQL} - INTERVAL {int(hours)} HOUR AND ts <= {AS_OF_SQL}"


STATS = f"""st AS (
  SELECT app_id, contract_id,
    count(*) FILTER (WHERE ts >= {AS_OF_SQL} - INTERVAL 24 HOUR) AS recent_n, count(*) AS baseline_n,
    sum(CAST(round(score * 10000.0) AS BIGINT)) FILTER (WHERE ts >= {AS_OF_SQL} - INTERVAL 24 HOUR)
      / count(*) FILTER (WHERE ts >= {AS_OF_SQL} - INTERVAL 24 HOUR) / 10000.0 AS recent_avg,
    sum(CAST(round(score * 10000.0) AS BIGINT)) / count(*) / 10000.0 AS baseline_avg
  FROM series WHERE {_win(168)} GROUP BY app_id, contract_id),
alerts AS (
  SELECT app_id, contract_id, (CAST(floor((baseline_avg) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) AS baseline_avg, (CAST(floor((recent_avg) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) AS recent_avg,
    (CAST(floor(((baseline_avg - recent_avg) / baseline_avg) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) AS drop_pct,
    CASE WHEN (CAST(floor(((baseline_avg - recent_avg) / baseline_avg) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) >= 0.25 THEN 'critical'
         WHEN (CAST(floor(((baseline_avg - recent_avg) / baseline_avg) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) >= 0.15 THEN 'high'
         WHEN (CAST(floor(((baseline_avg - recent_avg) / baseline_avg) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) >= 0.10 THEN 'medium' ELSE 'low' END AS severity,
    24.0::DOUBLE AS window_hours, 168.0::DOUBLE AS baseline_hours
  FROM st WHERE recent_n >= 10 AND baseline_n >= 10 AND baseline_avg > 0
    AND (baseline_avg - recent_avg) / baseline_avg > 0.10)"""

ORACLES["compliance_series"] = with_(SERIES) + "SELECT app_id, contract_id, ts_us, score FROM series"
ORACLES["scores_in_window"] = with_(SERIES) + f"SELECT app_id, contract_id, ts_us, score FROM series WHERE {_win(24)}"
ORACLES["compliance_snapshot"] = with_(SERIES) + f"""
SELECT app_id, contract_id, (CAST(floor((sum(CAST(round(score * 10000.0) AS BIGINT)) / count(*) / 10000.0) * 1000000.0 + 0.5) AS DOUBLE) / 1000000.0) AS avg_score, count(*) AS sample_count, min(score) AS min_score,
  max(score) AS max_score FROM series WHERE {_win(24)} GROUP BY app_id, contract_id"""
ORACLES["drift_check"] = with_(SERIES, STATS) + "SELECT * FROM alerts WHERE app_id = 'app_0'"
ORACLES["drift_all"] = with_(SERIES, STATS) + "SELECT * FROM alerts"
ORACLES["drift_severity"] = with_(SERIES, STATS) + "SELECT app_id, severity, count(*) AS alerts FROM alerts GROUP BY ALL"
ORACLES["drift_summary"] = with_(SERIES, STATS) + f"""
SELECT k.app_id, k.contract_id, (CAST(floor((s.avg_score) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) AS avg_compliance, coalesce(s.n, 0) AS sample_count,
  s.min_score, s.max_score, a.drop_pct, a.severity, CAST(a.severity IS NOT NULL AS INTEGER) AS alert_count
FROM (SELECT DISTINCT app_id, contract_id FROM series) k
LEFT JOIN (SELECT app_id, contract_id, sum(CAST(round(score * 10000.0) AS BIGINT)) / count(*) / 10000.0 AS avg_score, count(*) AS n, min(score) AS min_score, max(score) AS max_score
           FROM series WHERE {_win(24)} GROUP BY ALL) s ON k.app_id = s.app_id AND k.contract_id = s.contract_id
LEFT JOIN alerts a ON k.app_id = a.app_id AND k.contract_id = a.contract_id"""
ORACLES["drift_timeline"] = with_(SERIES, """ticks AS (
  SELECT CAST(t AS TIMESTAMP) AS tick FROM generate_series(DATE '2024-01-08', DATE '2024-01-31', INTERVAL 1 DAY) g(t)),
keys AS (SELECT DISTINCT app_id, contract_id FROM series),
tst AS (
  SELECT k.app_id, k.contract_id, t.tick,
    (SELECT count(*) FROM series s WHERE s.app_id = k.app_id AND s.contract_id = k.contract_id
       AND s.ts >= t.tick - INTERVAL 24 HOUR AND s.ts <= t.tick) AS recent_n,
    (SELECT count(*) FROM series s WHERE s.app_id = k.app_id AND s.contract_id = k.contract_id
       AND s.ts >= t.tick - INTERVAL 168 HOUR AND s.ts <= t.tick) AS baseline_n,
    (SELECT sum(CAST(round(score * 10000.0) AS BIGINT)) / count(*) / 10000.0 FROM series s WHERE s.app_id = k.app_id
       AND s.contract_id = k.contract_id AND s.ts >= t.tick - INTERVAL 24 HOUR AND s.ts <= t.tick) AS recent_avg,
    (SELECT sum(CAST(round(score * 10000.0) AS BIGINT)) / count(*) / 10000.0 FROM series s WHERE s.app_id = k.app_id
       AND s.contract_id = k.contract_id AND s.ts >= t.tick - INTERVAL 168 HOUR AND s.ts <= t.tick) AS baseline_avg
  FROM keys k, ticks t)""") + """
SELECT app_id, contract_id, strftime(tick, '%Y-%m-%d') AS tick, recent_n, baseline_n,
  coalesce(recent_n >= 10 AND baseline_n >= 10 AND baseline_avg > 0 AND (baseline_avg - recent_avg) / baseline_avg > 0.10, false) AS alert,
  (CAST(floor((recent_avg) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) AS recent_avg, (CAST(floor((baseline_avg) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) AS baseline_avg
FROM tst"""
ORACLES["drift_ticks"] = with_(SERIES, f"""ticks AS (
  SELECT CAST(t AS TIMESTAMP) AS tick FROM generate_series(TIMESTAMP '2024-01-29 00:00:00', {AS_OF_SQL}, INTERVAL 300 SECOND) g(t)),
keys AS (SELECT DISTINCT app_id, contract_id FROM series),
inw AS (
  SELECT s.app_id, s.contract_id, t.tick, s.ts >= t.tick - INTERVAL 24 HOUR AS recent, CAST(round(s.score * 10000.0) AS BIGINT) AS u
  FROM ticks t JOIN series s ON s.ts >= t.tick - INTERVAL 168 HOUR AND s.ts <= t.tick),
tst AS (
  SELECT app_id, contract_id, tick, count_if(recent) AS recent_n, count(*) AS baseline_n,
    sum(u) FILTER (WHERE recent) / count_if(recent) / 10000.0 AS recent_avg, sum(u) / count(*) / 10000.0 AS baseline_avg
  FROM inw GROUP BY ALL)""") + """
SELECT k.app_id, k.contract_id, strftime(t.tick, '%Y-%m-%d %H:%M:%S') AS tick, coalesce(recent_n, 0) AS recent_n, coalesce(baseline_n, 0) AS baseline_n,
  coalesce(recent_n >= 10 AND baseline_n >= 10 AND baseline_avg > 0 AND (baseline_avg - recent_avg) / baseline_avg > 0.10, false) AS alert,
  (CAST(floor((recent_avg) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) AS recent_avg, (CAST(floor((baseline_avg) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) AS baseline_avg
FROM keys k CROSS JOIN ticks t LEFT JOIN tst x ON x.app_id = k.app_id AND x.contract_id = k.contract_id AND x.tick = t.tick"""
ORACLES["daily_compliance"] = with_(SERIES) + """
SELECT app_id, contract_id, strftime(day, '%Y-%m-%d') AS day, n, (CAST(floor((mean) * 1000000.0 + 0.5) AS DOUBLE) / 1000000.0) AS mean_score,
  coalesce((lag(mean) OVER w - mean) / lag(mean) OVER w > 0.10, false) AS drop_alert
FROM (SELECT app_id, contract_id, CAST(ts AS DATE) AS day, count(*) AS n,
        sum(CAST(round(score * 10000.0) AS BIGINT)) / count(*) / 10000.0 AS mean FROM series GROUP BY ALL)
WINDOW w AS (PARTITION BY app_id, contract_id ORDER BY day)"""
ORACLES["prune_retention"] = with_(SERIES) + f"""
SELECT app_id, contract_id, count(*) AS retained, min(ts_us) AS oldest_ts_us
FROM series WHERE ts > {AS_OF_SQL} - INTERVAL 20 DAY GROUP BY app_id, contract_id"""


# ------------------------------------------------------------------ 2.6 rate limits
def _admission_sql(src: str, M: int, W: int) -> str:
    keep = f"list_filter(f.win, lambda x: x > o.ts_ms - {W})"
    return f"""o AS (SELECT key, ts_ms, request_id, row_number() OVER (PARTITION BY key ORDER BY ts_ms, request_id) AS rn FROM {src}),
f AS (
  SELECT key, rn, ts_ms, request_id, [ts_ms] AS win, true AS admitted, 1 AS count_after, CAST(NULL AS DOUBLE) AS retry_after
  FROM o WHERE rn = 1
  UNION ALL
  SELECT o.key, o.rn, o.ts_ms, o.request_id,
    CASE WHEN len({keep}) >= {M} THEN {keep} ELSE list_append({keep}, o.ts_ms) END,
    len({keep}) < {M},
    CASE WHEN len({keep}) >= {M} THEN len({keep}) ELSE len({keep}) + 1 END,
    CASE WHEN len({keep}) >= {M} THEN greatest(0.0, ((list_min({keep}) + {W}) - o.ts_ms) / 1000) END
  FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1)"""


RATE_SRC = "rl AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts_ms, event_id AS request_id FROM events)"
_W = fx.RATE_WINDOW_S * 1000
ORACLES["rate_admission"] = "WITH RECURSIVE " + RATE_SRC + ",\n" + _admission_sql("rl", fx.RATE_MAX, _W) + """
SELECT key, ts_ms, request_id, admitted, CAST(count_after AS INTEGER) AS count_after FROM f"""
ORACLES["rate_retry_after"] = "WITH RECURSIVE " + RATE_SRC + ",\n" + _admission_sql("rl", fx.RATE_MAX, _W) + """
SELECT key, request_id, retry_after, CAST(trunc(retry_after) AS INTEGER) AS retry_after_header FROM f WHERE NOT admitted"""


def _as_of_ms_sql() -> int:
    import datetime as _dt
    return int(_dt.datetime.strptime(fx.AS_OF, "%Y-%m-%d %H:%M:%S").replace(tzinfo=_dt.timezone.utc).timestamp() * 1000)


ORACLES["rate_peek"] = "WITH RECURSIVE " + RATE_SRC + ",\n" + _admission_sql("rl", fx.RATE_MAX, _W) + f"""
SELECT k.key, coalesce(u.used, 0) AS used, greatest(0, {fx.RATE_MAX} - coalesce(u.used, 0)) AS remaining,
  CASE WHEN u.oldest_ms IS NOT NULL THEN (u.oldest_ms + {_W}) / 1000.0 ELSE {_as_of_ms_sql() / 1000.0} END AS reset_at
FROM (SELECT DISTINCT key FROM f) k
LEFT JOIN (SELECT key, count(*) AS used, min(ts_ms) AS oldest_ms FROM f
           WHERE admitted AND ts_ms > {_as_of_ms_sql() - _W} AND ts_ms <= {_as_of_ms_sql()} GROUP BY key) u ON k.key = u.key"""

ORACLES["rate_reset"] = "WITH RECURSIVE " + f"""ev AS (SELECT user_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts_ms, event_id, event_type = 'signup' AS is_reset FROM events),
ep AS (SELECT *, sum(CASE WHEN is_reset THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts_ms, is_reset DESC
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch FROM ev),
rr AS (SELECT CAST(user_id AS VARCHAR) || ':' || CAST(epoch AS VARCHAR) AS key, ts_ms, event_id AS request_id FROM ep WHERE NOT is_reset),
""" + _admission_sql("rr", fx.RATE_MAX, _W) + """
SELECT key, request_id, admitted, CAST(count_after AS INTEGER) AS count_after FROM f"""

ORACLES["rate_rollup"] = "WITH RECURSIVE " + RATE_SRC + ",\n" + _admission_sql("rl", fx.RATE_MAX, _W) + """
SELECT 'ratelimit' AS prefix, key, count(*) FILTER (WHERE admitted) AS allowed, count(*) FILTER (WHERE NOT admitted) AS rejected_429
FROM f GROUP BY key"""

ORACLES["rate_fixed_vs_sliding"] = """WITH rl AS (SELECT user_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts_ms FROM events),
fx AS (SELECT user_id, max(n) AS max_fixed FROM (SELECT user_id, floor(ts_ms / 3600000) AS b, count(*) AS n FROM rl GROUP BY ALL) GROUP BY user_id),
sl AS (SELECT user_id, max(n) AS max_sliding FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts_ms
        RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS n FROM rl) GROUP BY user_id)
SELECT fx.user_id, max_fixed, max_sliding, max_sliding > max_fixed AS boundary_burst FROM fx JOIN sl ON fx.user_id = sl.user_id"""

_RMPH = int(round(fx.LEAKY_RATE_PER_HOUR * 1000))
_LIMIT = fx.LEAKY_BURST * 1000
ORACLES["rate_leaky_bucket"] = "WITH RECURSIVE " + RATE_SRC + f""",
o AS (SELECT key, ts_ms, request_id, row_number() OVER (PARTITION BY key ORDER BY ts_ms, request_id) AS rn FROM rl),
f AS (
  SELECT key, rn, ts_ms, request_id, true AS admitted, CAST(0 AS BIGINT) AS excess_milli, CAST(0 AS BIGINT) AS st_excess, ts_ms AS st_last
  FROM o WHERE rn = 1
  UNION ALL
  SELECT o.key, o.rn, o.ts_ms, o.request_id,
    greatest(f.st_excess - ({_RMPH} * (o.ts_ms - f.st_last)) // 3600000 + 1000, 0) <= {_LIMIT},
    CASE WHEN greatest(f.st_excess - ({_RMPH} * (o.ts_ms - f.st_last)) // 3600000 + 1000, 0) <= {_LIMIT}
         THEN greatest(f.st_excess - ({_RMPH} * (o.ts_ms - f.st_last)) // 3600000 + 1000, 0) ELSE f.st_excess END,
    CASE WHEN greatest(f.st_excess - ({_RMPH} * (o.ts_ms - f.st_last)) // 3600000 + 1000, 0) <= {_LIMIT}
         THEN greatest(f.st_excess - ({_RMPH} * (o.ts_ms - f.st_last)) // 3600000 + 1000, 0) ELSE f.st_excess END,
    CASE WHEN greatest(f.st_excess - ({_RMPH} * (o.ts_ms - f.st_last)) // 3600000 + 1000, 0) <= {_LIMIT} THEN o.ts_ms ELSE f.st_last END
  FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1)
SELECT key, ts_ms, request_id, admitted, excess_milli FROM f"""


# ------------------------------------------------------------------ 2.8 routing / 2.9 metrics
RLOG = f"""rlog AS (
  SELECT event_id AS request_id, ts, 'app_' || CAST(user_id % 3 AS VARCHAR) AS app_id, user_id,
    {lst(fx.PROVIDERS)}[event_id % 3 + 1] AS provider, {lst(fx.ALIASES)}[event_id % 7 + 1] AS alias,
    CASE WHEN event_id % 13 = 0 THEN 'anthropic' END AS x_provider, value AS latency_ms,
    CAST(50 + (event_id * 37) % 400 AS BIGINT) AS prompt_tokens, CAST(20 + (event_id * 53) % 300 AS BIGINT) AS completion_tokens,
    CAST(CASE WHEN event_type = 'error' THEN 502 WHEN event_id % 50 = 0 THEN 400 WHEN event_id % 50 = 1 THEN 422
              WHEN event_id % 50 = 2 THEN 429 WHEN event_id % 50 = 3 THEN 401 ELSE 200 END AS INTEGER) AS status,
    CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'HIT' ELSE 'MISS' END AS cache,
    '/v1/chat/completions' AS uri, event_type, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts_ms
  FROM events)"""
ROUTES_SQL = "routes AS (SELECT alias, provider, canonical, CAST(priority AS INTEGER) AS priority, CAST(cost AS DOUBLE) AS cost, " \
             "CAST(avg_latency AS DOUBLE) AS avg_latency, CAST(pos AS INTEGER) AS pos FROM (VALUES " + ", ".join(
                 f"({q(a)}, {q(p)}, {q(c)}, {pr}, {co}, {al}, {po})" for a, p, c, pr, co, al, po in fx.ROUTES) + \
             ") t(alias, provider, canonical, priority, cost, avg_latency, pos))"


def _key_sql(policy: str, lat: str = "avg_latency") -> str:
    return {"cost": "cost", "priority": "CAST(priority AS DOUBLE)",
            "latency": f"CASE WHEN {lat} > 0 THEN {lat} ELSE 'inf'::DOUBLE END"}[policy]


def _resolve_sql(policy: str) -> str:
    return with_(RLOG, ROUTES_SQL, f"""cand AS (
  SELECT l.request_id, l.alias, l.x_provider, r.alias IS NULL AS unknown_alias,
    coalesce(r.provider, 'openai') AS provider, coalesce(r.canonical, l.alias) AS canonical,
    coalesce(r.priority, 0) AS priority, coalesce(r.cost, 0.0) AS cost, coalesce(r.avg_latency, 0.0) AS avg_latency,
    coalesce(r.pos, 0) AS pos
  FROM rlog l LEFT JOIN routes r ON l.alias = r.alias),
c2 AS (SELECT *, coalesce(bool_or(provider = x_provider) OVER (PARTITION BY request_id), false) AS has_x FROM cand),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {_key_sql(policy)}, pos) AS rn
           FROM c2 WHERE NOT has_x OR provider = x_provider)""")


ORACLES["route_resolve"] = _resolve_sql("cost") + """
SELECT request_id, alias, provider AS routed_provider, canonical AS canonical_model, unknown_alias FROM ranked WHERE rn = 1"""
for _pol in ("cost", "latency", "priority"):
    ORACLES[f"route_{_pol}"] = _resolve_sql(_pol) + """
SELECT request_id, provider AS routed_provider, canonical AS canonical_model FROM ranked WHERE rn = 1"""

ORACLES["route_fallback"] = with_(RLOG, ROUTES_SQL, """f AS (SELECT request_id, alias, provider FROM rlog WHERE status = 502),
alt AS (SELECT f.request_id, r.provider, r.canonical,
          row_number() OVER (PARTITION BY f.request_id ORDER BY r.cost, r.pos) AS rn
        FROM f JOIN routes r ON r.alias = f.alias AND r.provider <> f.provider)""") + """
SELECT f.request_id, f.alias, f.provider, a.provider AS fallback_provider, a.canonical AS fallback_canonical
FROM f LEFT JOIN alt a ON a.request_id = f.request_id AND a.rn = 1"""

UPD = """upd AS (
  SELECT alias, provider, alias || '@' || provider AS canonical, 9 AS priority, 0.5::DOUBLE AS cost,
    round(sum(CAST(round(latency_ms * 100) AS BIGINT)) / count(*) / 100.0, 4) AS avg_latency
  FROM rlog WHERE event_type = 'purchase' GROUP BY alias, provider),
ups AS (
  SELECT coalesce(u.alias, r.alias) AS alias, coalesce(u.provider, r.provider) AS provider,
    coalesce(u.canonical, r.canonical) AS canonical, CAST(coalesce(u.priority, r.priority) AS INTEGER) AS priority,
    coalesce(u.cost, r.cost) AS cost, coalesce(u.avg_latency, r.avg_latency) AS avg_latency,
    CAST(coalesce(r.pos, (SELECT max(pos) FROM routes) + row_number() OVER (PARTITION BY r.pos IS NULL ORDER BY u.alias, u.provider)) AS INTEGER) AS pos
  FROM routes r FULL OUTER JOIN upd u ON r.alias = u.alias AND r.provider = u.provider)"""
ORACLES["alias_upsert"] = with_(RLOG, ROUTES_SQL, UPD) + "SELECT * FROM ups"
ORACLES["model_catalog"] = with_(RLOG, ROUTES_SQL, UPD) + """
SELECT alias AS id, provider AS owned_by, canonical AS canonical_model, cost AS cost_per_1k_tokens, avg_latency AS avg_latency_ms
FROM (SELECT *, row_number() OVER (PARTITION BY alias, provider ORDER BY pos) AS r FROM ups) WHERE r = 1"""

EMA_SQL = """samples AS (
  SELECT l.alias, l.provider, l.ts_ms, l.request_id, l.latency_ms, r.avg_latency AS seed,
    row_number() OVER (PARTITION BY l.alias, l.provider ORDER BY l.ts_ms, l.request_id) AS rn
  FROM rlog l JOIN routes r ON l.alias = r.alias AND l.provider = r.provider WHERE l.status = 200 AND l.cache <> 'HIT'),
ema AS (
  SELECT alias, provider, rn, ts_ms, request_id,
    CASE WHEN seed = 0.0 THEN latency_ms ELSE 0.2::DOUBLE * latency_ms + 0.8::DOUBLE * seed END AS e
  FROM samples WHERE rn = 1
  UNION ALL
  SELECT s.alias, s.provider, s.rn, s.ts_ms, s.request_id,
    CASE WHEN m.e = 0.0 THEN s.latency_ms ELSE 0.2::DOUBLE * s.latency_ms + 0.8::DOUBLE * m.e END
  FROM ema m JOIN samples s ON s.alias = m.alias AND s.provider = m.provider AND s.rn = m.rn + 1)"""
ORACLES["latency_ema"] = "WITH RECURSIVE " + RLOG + ",\n" + ROUTES_SQL + ",\n" + EMA_SQL + """
SELECT r.alias, r.provider, coalesce(x.n, 0) AS samples, round(coalesce(x.e, r.avg_latency), 6) AS ema_ms
FROM routes r LEFT JOIN (SELECT alias, provider, count(*) AS n, arg_max(e, rn) AS e FROM ema GROUP BY ALL) x
  ON r.alias = x.alias AND r.provider = x.provider"""

ORACLES["route_latency_asof"] = "WITH RECURSIVE " + RLOG + ",\n" + ROUTES_SQL + ",\n" + EMA_SQL + """,
upd AS (SELECT alias, provider, CAST(ts_ms AS HUGEINT) * 10000000 + request_id AS ord, e FROM ema),
rq AS (SELECT l.request_id, l.alias, CAST(l.ts_ms AS HUGEINT) * 10000000 + l.request_id AS ord, r.provider, r.avg_latency, r.pos
       FROM rlog l JOIN routes r ON l.alias = r.alias),
known AS (SELECT rq.*, u.e FROM rq ASOF LEFT JOIN upd u ON rq.alias = u.alias AND rq.provider = u.provider AND rq.ord > u.ord),
rk AS (SELECT *, coalesce(e, avg_latency) AS cur,
        row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN coalesce(e, avg_latency) > 0 THEN coalesce(e, avg_latency) ELSE 'inf'::DOUBLE END, pos) AS rn
       FROM known)
SELECT l.request_id, l.alias, k.provider AS routed_provider, round(k.cur, 6) AS ema_used_ms
FROM rlog l LEFT JOIN rk k ON l.request_id = k.request_id AND k.rn = 1"""

ORACLES["spend_by_model"] = with_(RLOG, ROUTES_SQL) + """
SELECT l.app_id, l.provider, l.alias, strftime(CAST(l.ts AS DATE), '%Y-%m-%d') AS day,
  CAST(sum(l.prompt_tokens + l.completion_tokens) AS BIGINT) AS tokens,
  round(CAST(sum((l.prompt_tokens + l.completion_tokens) * CAST(coalesce(r.cost, 0.0) AS DECIMAL(18, 6))) AS DOUBLE) / 1000.0, 6) AS spend_usd
FROM rlog l LEFT JOIN routes r ON l.alias = r.alias AND l.provider = r.provider
WHERE l.status = 200 AND l.cache <> 'HIT' GROUP BY ALL"""

ORACLES["usage_totals"] = with_(RLOG) + """
SELECT provider, alias, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens
FROM rlog WHERE status = 200 AND cache <> 'HIT' GROUP BY provider, alias"""

# the cache is asked after limiter and guard: 200, 422 and 502 rows asked it, and a 200 row marked HIT was served by it
ORACLES["metrics_snapshot"] = with_(RLOG, """c AS (
  SELECT count_if(status = 200 AND cache <> 'HIT') AS requests_total, count_if(status = 429) AS rate_limited,
    count_if(status = 422) AS contract_violations, count_if(status = 200 AND cache = 'HIT') AS cache_hits,
    count_if(status IN (422, 502)) + count_if(status = 200 AND cache <> 'HIT') AS cache_misses,
    count_if(status = 400) AS injection_blocks, count_if(status = 502) AS provider_errors, count_if(status = 401) AS unauthorized
  FROM rlog)""") + """
SELECT requests_total, rate_limited, contract_violations, cache_hits, cache_misses,
  CASE WHEN cache_hits + cache_misses = 0 THEN 0.0 ELSE round(cache_hits / (cache_hits + cache_misses), 4) END AS cache_hit_rate,
  injection_blocks, provider_errors, unauthorized FROM c"""

_P = "round(quantile_cont(latency_ms, 0.5), 4) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 4) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 4) AS p99_ms"
ORACLES["latency_percentiles"] = with_(RLOG, "ok AS (SELECT * FROM rlog WHERE status = 200 AND cache <> 'HIT')") + f"""
SELECT 'global' AS scope, count(*) AS samples, {_P} FROM (SELECT * FROM ok ORDER BY ts DESC, request_id DESC LIMIT 2000)
UNION ALL
SELECT provider AS scope, count(*) AS samples, {_P} FROM (
  SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ts DESC, request_id DESC) AS r FROM ok) WHERE r <= 1000 GROUP BY provider"""

ORACLES["provider_stats"] = with_(RLOG) + """
SELECT c.provider, c.requests, c.errors,
  CASE WHEN c.requests = 0 THEN 0.0 ELSE round(c.errors / c.requests, 4) END AS error_rate,
  CASE WHEN c.requests + c.errors = 0 THEN 0.0 ELSE round(c.errors / (c.requests + c.errors), 4) END AS error_rate_attempts,
  l.p50_ms, l.p95_ms
FROM (SELECT provider, count_if(status = 200 AND cache <> 'HIT') AS requests, count_if(status = 502) AS errors FROM rlog GROUP BY provider) c
LEFT JOIN (SELECT provider, round(quantile_cont(latency_ms, 0.5), 4) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 4) AS p95_ms
           FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ts DESC, request_id DESC) AS r FROM rlog
                 WHERE status = 200 AND cache <> 'HIT') WHERE r <= 1000 GROUP BY provider) l ON c.provider = l.provider"""

ORACLES["security_counts"] = with_(FLAT, ATTACK, SCAN, DECISIONS) + """
SELECT count_if(tier_triggered = 1) AS tier1_blocks, count_if(tier_triggered = 2) AS tier2_blocks,
  count_if(tier_triggered IS NOT NULL) AS total_blocks FROM decisions"""

_CLS = " ".join(f"WHEN {c} THEN {q(n)}" for c, n in {200: "ok", 400: "injection_blocked", 401: "unauthorized",
                                                   422: "contract_blocked", 429: "rate_limited", 502: "upstream_error"}.items())
ORACLES["status_rollup"] = with_(RLOG) + f"""
SELECT uri, strftime(ts, '%Y-%m-%d %H:00:00') AS hour, status, count(*) AS n, CASE status {_CLS} ELSE 'other' END AS outcome
FROM rlog GROUP BY ALL"""

ORACLES["upstream_error_classes"] = with_(RLOG, """seqs AS (
  SELECT request_id, provider,
    CASE WHEN status = 502 THEN [500, 0, 502]
         WHEN status IN (200, 422) AND request_id % 10 = 7 THEN [503, 200]
         WHEN status IN (200, 422) AND request_id % 10 = 8 THEN [0, 500, 200]
         WHEN status IN (200, 422) AND request_id % 17 = 5 THEN [429]
         WHEN status IN (200, 422) AND request_id % 23 = 4 THEN [404]
         WHEN status IN (200, 422) THEN [200] END AS seq
  FROM rlog),
att AS (SELECT request_id, provider, CAST(unnest(range(len(seq))) AS INTEGER) AS attempt, unnest(seq) AS http_status FROM seqs WHERE seq IS NOT NULL),
pr AS (SELECT provider, request_id, count(*) AS attempts, arg_max(http_status, attempt) AS last_status,
         sum(CASE WHEN (http_status >= 500 OR http_status = 0) AND attempt < 2 THEN CAST(pow(2, attempt) AS DOUBLE) ELSE 0.0 END) AS backoff_s
       FROM att GROUP BY provider, request_id)""") + """
SELECT provider, CASE WHEN last_status = 200 THEN 'ok' WHEN last_status = 429 THEN 'rate_limited'
                      WHEN last_status >= 500 OR last_status = 0 THEN 'retryable_exhausted' ELSE 'final' END AS final_class,
  count(*) AS requests, CAST(sum(attempts) AS BIGINT) AS attempts, sum(backoff_s) AS backoff_s
FROM pr GROUP BY ALL"""

ORACLES["request_funnel"] = with_(RLOG, """a AS (
  SELECT count(*) AS received, count_if(status NOT IN (429, 401)) AS rate_limit,
    count_if(status NOT IN (429, 401, 400)) AS guard,
    count_if(status NOT IN (429, 401, 400) AND NOT (cache = 'HIT' AND status = 200)) AS cache_lookup,
    count_if(status NOT IN (429, 401, 400, 502) AND NOT (cache = 'HIT' AND status = 200)) AS provider,
    count_if(status NOT IN (429, 401, 400, 502, 422) AND NOT (cache = 'HIT' AND status = 200)) AS contracts,
    count_if(status = 200) AS delivered FROM rlog)""") + """
SELECT CAST(stage_order AS INTEGER) AS stage_order, stage, n FROM (
  SELECT 0 AS stage_order, 'received' AS stage, received AS n FROM a UNION ALL SELECT 1, 'rate_limit', rate_limit FROM a
  UNION ALL SELECT 2, 'guard', guard FROM a UNION ALL SELECT 3, 'cache_lookup', cache_lookup FROM a
  UNION ALL SELECT 4, 'provider', provider FROM a UNION ALL SELECT 5, 'contracts', contracts FROM a
  UNION ALL SELECT 6, 'delivered', delivered FROM a)"""

ORACLES["trace_rollup"] = with_(RLOG) + """
SELECT request_id AS trace_id, CAST(4 AS BIGINT) AS n_spans,
  ((CAST(round(latency_ms * 100) AS BIGINT) * 5 + 50) // 100) / 100.0 AS guard_ms,
  ((CAST(round(latency_ms * 100) AS BIGINT) * 2 + 50) // 100) / 100.0 AS cache_ms,
  ((CAST(round(latency_ms * 100) AS BIGINT) * 85 + 50) // 100) / 100.0 AS provider_ms,
  ((CAST(round(latency_ms * 100) AS BIGINT) * 8 + 50) // 100) / 100.0 AS contracts_ms, status = 502 AS error,
  prompt_tokens + completion_tokens AS total_tokens
FROM rlog"""


# ------------------------------------------------------------------ 2.7 vectors (brute force twins)
VEC = f"""stn AS (SELECT vec_id, embedding, label, sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) AS nrm FROM embeddings),
st AS (SELECT vec_id AS entry_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / nrm) AS v, label AS payload,
         CAST(vec_id * {fx.ENTRY_SPACING_S} AS DOUBLE) AS stored_at FROM stn),
qm AS (SELECT a.vec_id AS i, CAST({'[' + ', '.join(str(w) for w in fx.MIX_WEIGHTS) + ']'}[a.vec_id % 3 + 1] AS DOUBLE) AS w,
         a.embedding AS ea, b.embedding AS eb
       FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT max(vec_id) + 1 FROM embeddings)),
qm2 AS (SELECT i, list_transform(ea, lambda x, k: w * CAST(x AS DOUBLE) + (1.0 - w) * CAST(eb[k] AS DOUBLE)) AS m FROM qm),
qv AS (SELECT i AS query_id, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS v,
         CAST(i * {fx.ENTRY_SPACING_S} + [{', '.join(str(d) for d in fx.QUERY_DELAYS_S)}][i % 2 + 1] AS DOUBLE) AS asked_at FROM qm2)"""


def _lookup_sql(thr: float, store: str = "st", extra: str = "") -> str:
    return f"""pairs AS (SELECT q.query_id, s.entry_id, s.payload, list_dot_product(q.v, s.v) AS sim FROM qv q, {store} s
               WHERE list_dot_product(q.v, s.v) >= {thr} {extra}),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, entry_id) AS rk FROM pairs)"""


_HU6 = "(CAST(floor((b.sim) * 1000000.0 + 0.5) AS DOUBLE) / 1000000.0)"
ORACLES["cache_lookup"] = with_(VEC, _lookup_sql(0.92)) + f"""
SELECT q.query_id, b.entry_id, {_HU6} AS similarity, b.entry_id IS NOT NULL AS hit, b.payload
FROM qv q LEFT JOIN best b ON b.query_id = q.query_id AND b.rk = 1"""
ORACLES["cache_topk"] = with_(VEC, _lookup_sql(0.6)) + f"""
SELECT b.query_id, CAST(b.rk AS INTEGER) AS rank, b.entry_id, {_HU6} AS similarity FROM best b WHERE b.rk <= 3"""
ORACLES["cache_ttl"] = with_(VEC, _lookup_sql(0.92, extra=f"AND q.asked_at - s.stored_at >= 0 AND q.asked_at - s.stored_at < {fx.TTL_S}")) + f"""
SELECT q.query_id, b.entry_id, {_HU6} AS similarity, b.entry_id IS NOT NULL AS hit
FROM qv q LEFT JOIN best b ON b.query_id = q.query_id AND b.rk = 1"""
ORACLES["cache_invalidate"] = with_(VEC, "kept AS (SELECT * FROM st WHERE payload IS DISTINCT FROM 1)", _lookup_sql(0.92, "kept")) + f"""
SELECT q.query_id, b.entry_id, {_HU6} AS similarity, b.entry_id IS NOT NULL AS hit
FROM qv q LEFT JOIN best b ON b.query_id = q.query_id AND b.rk = 1"""
ORACLES["cache_stats"] = with_(VEC, _lookup_sql(0.92), """o AS (SELECT q.query_id, b.entry_id IS NOT NULL AS hit FROM qv q
  LEFT JOIN best b ON b.query_id = q.query_id AND b.rk = 1)""") + """
SELECT CAST(query_id % 3 AS INTEGER) AS mix_group, count_if(hit) AS hits, count_if(NOT hit) AS misses,
  CASE WHEN count(*) = 0 THEN 0.0 ELSE (CAST(floor((count_if(hit) / count(*)) * 10000.0 + 0.5) AS DOUBLE) / 10000.0) END AS hit_rate
FROM o GROUP BY ALL"""
ORACLES["cache_capacity"] = with_(VEC) + "SELECT entry_id, stored_at FROM st ORDER BY stored_at DESC, entry_id DESC LIMIT 300"
ORACLES["cache_replay"] = "WITH RECURSIVE " + VEC + f""",
stream AS (SELECT entry_id AS item_id, v, stored_at AS t FROM st
           UNION ALL SELECT query_id + (SELECT max(entry_id) + 1 FROM st), v, asked_at FROM qv),
edges AS (SELECT b.item_id AS dst, list(a.item_id) AS preds FROM stream a, stream b
          WHERE (a.t < b.t OR (a.t = b.t AND a.item_id < b.item_id)) AND b.t - a.t < {fx.TTL_S}
            AND list_dot_product(a.v, b.v) >= 0.92 GROUP BY b.item_id),
ord AS (SELECT s.item_id, coalesce(e.preds, []) AS preds, row_number() OVER (ORDER BY s.t, s.item_id) AS rn
        FROM stream s LEFT JOIN edges e ON e.dst = s.item_id),
rec AS (SELECT item_id, rn, false AS hit, [item_id] AS stored FROM ord WHERE rn = 1
        UNION ALL
        SELECT o.item_id, o.rn, len(list_intersect(r.stored, o.preds)) > 0,
          CASE WHEN len(list_intersect(r.stored, o.preds)) > 0 THEN r.stored ELSE list_append(r.stored, o.item_id) END
        FROM rec r JOIN ord o ON o.rn = r.rn + 1)
SELECT item_id, hit FROM rec"""


# ------------------------------------------------------------------ 2.1 / 2.2 / 2.11
REQ = f"""req AS (
  SELECT conv_id AS request_id, {lst(fx.PROVIDERS)}[conv_id % 3 + 1] AS provider, {lst(fx.ALIASES)}[conv_id % 7 + 1] AS model,
    list(struct_pack(role := role, content := text) ORDER BY turn) AS messages,
    CASE WHEN conv_id % 4 <> 0 THEN CAST(conv_id % 10 AS DOUBLE) / 10.0 END AS temperature,
    CASE WHEN conv_id % 3 = 0 THEN 0.9::DOUBLE END AS top_p,
    CASE WHEN conv_id % 7 = 0 THEN 40 END AS top_k, CASE WHEN conv_id % 11 = 0 THEN 128 END AS num_predict,
    CASE WHEN conv_id % 2 = 0 THEN 256 END AS max_tokens, CASE WHEN conv_id % 5 = 0 THEN '###' END AS stop
  FROM conversations GROUP BY conv_id)"""
ORACLES["shape_requests"] = with_(REQ) + f"""
SELECT request_id, provider, model, CAST(len(messages) AS INTEGER) AS n_messages, CAST(NULL AS VARCHAR) AS system,
  CAST(max_tokens AS BIGINT) AS max_tokens, stop AS stop_sequences, temperature, top_p, CAST(NULL AS VARCHAR) AS options_keys,
  false AS stream FROM req WHERE provider = 'openai'
UNION ALL
SELECT request_id, provider, model, CAST(len(list_filter(messages, lambda m: m.role <> 'system')) AS INTEGER),
  CASE WHEN len(list_filter(messages, lambda m: m.role = 'system')) > 0 THEN
    array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'system'), lambda m: m.content), {NL}) END,
  CAST(coalesce(max_tokens, 1024) AS BIGINT), CASE WHEN stop <> '' THEN stop END, temperature, top_p, NULL, false
FROM req WHERE provider = 'anthropic'
UNION ALL
SELECT request_id, provider, model, CAST(len(messages) AS INTEGER), NULL, CAST(coalesce(num_predict, max_tokens) AS BIGINT), NULL,
  temperature, top_p,
  CASE WHEN len(list_filter([CASE WHEN temperature IS NOT NULL THEN 'temperature' END, CASE WHEN top_p IS NOT NULL THEN 'top_p' END,
                             CASE WHEN top_k IS NOT NULL THEN 'top_k' END,
                             CASE WHEN num_predict IS NOT NULL OR max_tokens IS NOT NULL THEN 'num_predict' END], lambda x: x IS NOT NULL)) > 0
       THEN array_to_string(list_sort(list_filter([CASE WHEN temperature IS NOT NULL THEN 'temperature' END,
                             CASE WHEN top_p IS NOT NULL THEN 'top_p' END, CASE WHEN top_k IS NOT NULL THEN 'top_k' END,
                             CASE WHEN num_predict IS NOT NULL OR max_tokens IS NOT NULL THEN 'num_predict' END], lambda x: x IS NOT NULL)), ',') END,
  true
FROM req WHERE provider = 'local'"""

TP = """tpp AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS response,
    coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (
      PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS request
  FROM conversations),
tpa AS (SELECT conv_id, turn, request, response FROM tpp WHERE role = 'assistant')"""
ORACLES["normalise_responses"] = with_(TP) + """
SELECT conv_id * 1000 + turn AS response_id, ['openai', 'anthropic', 'local'][(conv_id + turn) % 3 + 1] AS provider,
  response AS content,
  CASE (conv_id + turn) % 3
    WHEN 0 THEN coalesce(['stop', 'length', NULL][turn % 3 + 1], 'stop')
    WHEN 1 THEN CASE ['end_turn', 'max_tokens', 'stop_sequence', NULL][turn % 4 + 1] WHEN 'max_tokens' THEN 'length' ELSE 'stop' END
    ELSE CASE ['stop', 'length', NULL, 'unload'][turn % 4 + 1] WHEN 'length' THEN 'length' ELSE 'stop' END END AS finish_reason,
  CAST(floor(length(request) / 4) AS BIGINT) AS prompt_tokens, CAST(floor(length(response) / 4) AS BIGINT) AS completion_tokens,
  CAST(floor(length(request) / 4) + floor(length(response) / 4) AS BIGINT) AS total_tokens
FROM tpa"""
ORACLES["assemble_chunks"] = with_(TP) + """
SELECT conv_id * 1000 + turn AS response_id, response AS content, 'local-model' AS model, 'stop' AS finish_reason,
  CAST(0 AS BIGINT) AS prompt_tokens, CAST(len(string_split(response, ' ')) AS BIGINT) AS completion_tokens FROM tpa"""

LD = "ld AS (SELECT d.doc_id, d.text, l.toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
ORACLES["read_labelled_jsonl"] = with_(LD) + """
SELECT label, CAST(NULL AS VARCHAR) AS reason, count(*) AS n FROM ld GROUP BY label
UNION ALL SELECT CAST(NULL AS INTEGER), 'missing or non-integer label', count(*) FROM ld WHERE doc_id % 50 = 7
UNION ALL SELECT CAST(NULL AS INTEGER), 'not JSON', count(*) FROM ld WHERE doc_id % 50 = 7"""
ORACLES["write_jsonl"] = with_(LD) + "SELECT doc_id, label, CAST(length(text) AS INTEGER) AS n_chars FROM ld"
ORACLES["read_access_log"] = with_(RLOG) + """
SELECT status, count(*) AS n, CAST(sum(completion_tokens * 4) AS BIGINT) AS bytes, max(latency_ms / 1000.0) AS max_request_time,
  count(*) FILTER (WHERE status IN (200, 422, 502)) AS upstream_timed
FROM rlog GROUP BY status"""
ORACLES["read_patterns"] = ORACLES["pattern_rollup"]
ORACLES["write_compliance"] = with_(SERIES) + """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n FROM series GROUP BY ALL"""

ORACLES["attack_corpus"] = with_(FLAT, ATTACK) + "SELECT conv_id, prompt, label FROM attack_corpus"
ORACLES["balance_classes"] = with_(LD) + """
SELECT doc_id, label FROM (
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM ld)
WHERE r <= least(40, (SELECT min(c) FROM (SELECT count(*) AS c FROM ld GROUP BY label)))"""
ORACLES["seeded_shuffle"] = with_(LD) + "SELECT doc_id, label, md5('42:' || CAST(doc_id AS VARCHAR)) AS shuffle_key FROM ld"
ORACLES["stratified_split"] = with_(LD) + """
SELECT doc_id, label,
  CASE WHEN r < floor(n * 0.1::DOUBLE + 0.5) THEN 'test'
       WHEN r < floor(n * 0.1::DOUBLE + 0.5) + floor(n * 0.1::DOUBLE + 0.5) THEN 'val' ELSE 'train' END AS split
FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r,
        count(*) OVER (PARTITION BY label) AS n FROM ld)"""
ORACLES["dedup_samples"] = with_(LD) + """
SELECT min(doc_id) AS doc_id, arg_min(label, doc_id) AS label, count(*) AS copies FROM ld GROUP BY lower(trim(text))"""


# ------------------------------------------------------------------ 2.12 streaming twins (same answers as batch)
ORACLES["stream_guard"] = with_(FLAT, ATTACK, SCAN, DECISIONS) + """
SELECT conv_id, label, pattern_id, severity, ml_prob, blocked, tier_triggered, reason FROM decisions"""
ORACLES["stream_rate_admission"] = ORACLES["rate_admission"]
ORACLES["stream_drift"] = ORACLES["drift_all"]
ORACLES["stream_latency_ema"] = ORACLES["latency_ema"]
ORACLES["stream_metrics"] = with_(RLOG) + """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00:00') AS hour, status, count(*) AS n FROM rlog GROUP BY ALL"""
ORACLES["stream_metrics_sliding"] = with_(RLOG) + """
SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts) - s * INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S') AS start, status, count(*) AS n
FROM rlog, (VALUES (0), (1), (2), (3)) w(s) GROUP BY ALL"""
ORACLES["stream_dedup"] = "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS distinct_ids FROM events GROUP BY event_type"

ORACLES["score_histogram"] = with_(SCORED) + """
SELECT model, CAST(least(floor(prob * 10), 9) AS INTEGER) AS bucket, count(*) AS n FROM scored GROUP BY ALL"""

ORACLES["write_eval_report"] = ORACLES["precision_recall_f1"]
ORACLES["embed_prompts"] = """
SELECT conv_id, CAST(64 AS INTEGER) AS dim, CAST(1.0 AS DOUBLE) AS norm FROM conversations GROUP BY conv_id"""
