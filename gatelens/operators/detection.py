"""Prompt-injection detection over prompt tables: rule scan, scored tier, cascade, judge parsing.

Cost model: the rule scan is one projection of built-in regex expressions; the
tier-2 scorer is either a Column (stays in codegen) or a DataFrame plug-in
(``mapInPandas``). For plug-ins the cascade splits the plan so rows already
blocked by tier 1 never cross the Python boundary.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions.lexicon import lexical_injection_prob, strict_parse_json
from gatelens.functions.text import WS
from gatelens.functions.patterns import BLOCKING_SEVERITIES, first_match, ordered_rules
from gatelens.session import spread

# Gateway and evaluation thresholds, judge zone.
GATEWAY_THRESHOLD = 0.85
EVAL_THRESHOLD = 0.5
JUDGE_LOW, JUDGE_HIGH = 0.05, 0.40

MATCH_COLS = ["pattern_id", "severity", "matched_text", "match_start", "match_end"]


def pattern_scan(prompts: DataFrame, rules=None, text: str = "prompt") -> DataFrame:
    """Adds the first rule hit (severity desc, then file order) as flat nullable columns."""
    m = first_match(F.col(text), rules)
    return prompts.withColumn("_m", m).select(
        "*", *[F.col("_m")[c].alias(c) for c in MATCH_COLS]).drop("_m")


def pattern_rollup(hits: DataFrame, rules=None) -> DataFrame:
    """Hits per active rule; rules with no hit are listed with 0 (rule table left-joined)."""
    spark = hits.sparkSession
    rs = ordered_rules(rules)
    rule_df = spark.createDataFrame([(r.id, r.severity, r.rank, i) for i, r in enumerate(rs)],
                                    "pattern_id string, severity string, severity_rank int, scan_order int")
    counts = hits.filter(F.col("pattern_id").isNotNull()).groupBy("pattern_id").agg(F.count("*").alias("hits"))
    # the rule table is bounded by the rule file, never by the data
    return (rule_df.join(counts, "pattern_id", "left")
            .select("pattern_id", "severity", "scan_order", F.coalesce("hits", F.lit(0)).cast("long").alias("hits")))


def scan_documents(docs: DataFrame, text: str, by: list[str], rules=None) -> DataFrame:
    """Indirect-injection scan of stored documents/pages; hit counts per group and rule."""
    hit = first_match(F.col(text), rules)
    return (spread(docs).select(*by, hit["pattern_id"].alias("pattern_id"), hit["severity"].alias("severity"))
            .groupBy(*by, "pattern_id", "severity")
            .agg(F.count("*").alias("n_docs")))


# ---------------------------------------------------------------- tier-2 scorers
@dataclass
class Scorer:
    """A tier-2 scorer: either a Column function of the text or a DataFrame plug-in.

    ``frame_fn(df, text_col)`` must return ``df`` plus a double column ``ml_prob``
    (use ``mapInPandas`` for model inference; load the model once per worker).
    """
    name: str = "lexical"
    column_fn: Callable[[Column], Column] | None = lexical_injection_prob
    frame_fn: Callable[[DataFrame, str], DataFrame] | None = None
    available: bool = True

    def apply(self, df: DataFrame, text: str) -> DataFrame:
        if not self.available:
            return df.withColumn("ml_prob", F.lit(0.0))
        if self.column_fn is not None:
            return df.withColumn("ml_prob", self.column_fn(F.col(text)))
        return self.frame_fn(df, text)


LEXICAL = Scorer()


def tier2_scores(prompts: DataFrame, scorer: Scorer = LEXICAL, threshold: float = GATEWAY_THRESHOLD,
                 text: str = "prompt") -> DataFrame:
    """P(injection) per prompt and label INJECTION/BENIGN; MODEL_UNAVAILABLE (p=0) without a model."""
    s = scorer.apply(prompts, text)
    label = (F.when(F.lit(not scorer.available), "MODEL_UNAVAILABLE")
             .when(F.col("ml_prob") >= threshold, "INJECTION").otherwise("BENIGN"))
    return s.withColumn("ml_label", label)


def guard_decisions(prompts: DataFrame, rules=None, scorer: Scorer = LEXICAL, threshold: float = GATEWAY_THRESHOLD,
                    text: str = "prompt", pattern_tier: bool = True, ml_tier: bool = True,
                    dry_run: bool = False) -> DataFrame:
    """Two-tier cascade. HIGH/CRITICAL rule hit → blocked at tier 1; otherwise the scorer decides."""
    scanned = pattern_scan(prompts, rules if pattern_tier else [], text)
    tier1 = F.col("severity").isin(*BLOCKING_SEVERITIES)
    if scorer.column_fn is not None or not ml_tier:
        scored = scorer.apply(scanned, text) if ml_tier else scanned.withColumn("ml_prob", F.lit(None).cast("double"))
        scored = scored.withColumn("ml_prob", F.when(~F.coalesce(tier1, F.lit(False)), F.col("ml_prob")))
    else:
        # costly scorer: only rows surviving tier 1 are scored
        blocked1 = scanned.filter(tier1).withColumn("ml_prob", F.lit(None).cast("double"))
        rest = scorer.apply(scanned.filter(~F.coalesce(tier1, F.lit(False))), text)
        scored = blocked1.unionByName(rest)
    t1 = F.coalesce(tier1, F.lit(False))
    t2 = ~t1 & F.coalesce(F.col("ml_prob") >= threshold, F.lit(False))
    would_block = t1 | t2
    reason = (F.when(t1, F.concat(F.lit("Prompt injection detected by pattern guard (pattern: '"), F.col("pattern_id"),
                                  F.lit("', severity: "), F.col("severity"), F.lit(")")))
              .when(t2, F.lit("Prompt injection detected by ML classifier"))
              .otherwise(F.lit("")))
    if dry_run:
        reason = F.when(would_block, F.concat(F.lit("[DRY RUN — would have blocked] "), reason)).otherwise(reason)
    return scored.select(
        "*",
        (F.lit(False) if dry_run else would_block).alias("blocked"),
        would_block.alias("would_block"),
        F.when(t1, 1).when(t2, 2).cast("int").alias("tier_triggered"),
        reason.alias("reason"))


def judge_queue(decisions: DataFrame, low: float = JUDGE_LOW, high: float = JUDGE_HIGH) -> DataFrame:
    """Scored, not blocked, and low <= p <= high (inclusive)."""
    return decisions.filter(~F.col("blocked") & F.col("ml_prob").isNotNull() & F.col("ml_prob").between(low, high))


# ---------------------------------------------------------------- judge text parsing
def _truthy_json(js: Column) -> Column:
    """Truthiness of a JSON value given as JSON text (false, null, 0, "", [] and {} are false)."""
    return (F.when(js.isNull(), False)
            .when(js.isin("false", "null", '""', "[]", "{}"), False)
            .when(js.rlike(r"^-?0+(\.0*)?([eE][+-]?[0-9]+)?$"), False)
            .otherwise(True))


def judge_object_text(raw: Column) -> Column:
    """Candidate JSON text: first fenced block holding an object, else raw; then first '{' .. last '}'."""
    parts = F.split(raw, "```")
    fenced = F.transform(F.filter(parts, lambda x, i: i % 2 == 1),
                         lambda x: F.regexp_replace(F.regexp_replace(x, "^[json]+", ""), "^" + WS + "+|" + WS + "+$", ""))
    first_obj = F.try_element_at(F.filter(fenced, lambda x: x.startswith("{")), F.lit(1))
    text = F.when(raw.contains("```") & first_obj.isNotNull(), first_obj).otherwise(raw)
    start = F.instr(text, "{")
    last = F.instr(F.reverse(text), "}")
    end = F.length(text) - last + 1
    return F.when((start > 0) & (last > 0), F.when(end >= start, F.substring(text, start, end - start + 1)).otherwise(F.lit("")))


def judge_verdicts(raw_df: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse judge replies into is_injection / confidence / reason / error (error rows kept, treated benign)."""
    cand = judge_object_text(F.col(raw))
    v = strict_parse_json(F.col("_cand"))
    inj_js = F.to_json(F.try_variant_get(v, "$.injection", "variant"))
    r_var = F.try_variant_get(v, "$.reason", "variant")
    r_type = F.schema_of_variant(r_var)
    reason = (F.when(r_var.isNull(), F.lit(""))
              .when(r_type == "STRING", F.try_variant_get(v, "$.reason", "string"))
              .when(r_type == "VOID", F.lit("None"))
              .when(r_type == "BOOLEAN", F.when(F.try_variant_get(v, "$.reason", "boolean"), "True").otherwise("False"))
              .otherwise(F.to_json(r_var)))
    err = (F.when(F.col("_cand").isNull(), F.lit("no_object"))
           .when(v.isNull(), F.lit("bad_json")))
    inj = F.when(err.isNull(), _truthy_json(inj_js)).otherwise(F.lit(False))
    return (raw_df.withColumn("_cand", cand)
            .select("*", inj.alias("is_injection"),
                    F.when(inj, 1.0).otherwise(0.0).alias("confidence"),
                    F.when(err.isNull(), reason).otherwise(F.lit("")).alias("reason"),
                    err.alias("error"))
            .drop("_cand"))


def tier_disagreements(scores: DataFrame, verdicts: DataFrame, key: str,
                       low: float = JUDGE_LOW, high: float = JUDGE_HIGH) -> DataFrame:
    """Judge-zone rows joined to verdicts: failed / disagrees (judge says injection) / agrees."""
    zone = scores.filter(F.col("prob").between(low, high))
    j = zone.join(verdicts.select(key, "is_injection", "error"), key, "left")
    outcome = (F.when(j["is_injection"].isNull() | j["error"].isNotNull(), "failed")
               .when(j["is_injection"], "disagrees").otherwise("agrees"))
    return j.withColumn("outcome", outcome)


# ---------------------------------------------------------------- attack categories
# Persona signals, leet markers and thresholds of the miss categoriser.
ROLEPLAY_SIGNALS = ["dan", "pretend", "roleplay", "role play", "role-play", "you are now", "act as", "imagine you",
                    "character", "jailbreak", "your true self", "no restrictions", "unrestricted"]
LEET_SIGNALS = ["1gnor3", "1gnore", "sy5tem", "pr0mpt", "1nstruction"]
NON_ASCII_SHARE = 0.15
LONG_TOKEN = 20


def attack_category(text: Column) -> Column:
    low = F.lower(text)
    role = F.lit(False)
    for s in ROLEPLAY_SIGNALS:
        role = role | low.contains(s)
    non_ascii = F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / F.greatest(F.length(text), F.lit(1))
    b64 = F.exists(F.split(text, WS + "+"),   # str.split(): any Unicode whitespace
                   lambda w: (F.length(w) >= LONG_TOKEN) & F.regexp_replace(w, "[+/=]", "").rlike(r"^[\p{L}\p{N}]+$"))
    leet = F.lit(False)
    for s in LEET_SIGNALS:
        leet = leet | low.contains(s)
    return (F.when(role, "[ROLE-PLAY]")
            .when((non_ascii > NON_ASCII_SHARE) | b64 | leet, "[OBFUSCATED]")
            .otherwise("[INDIRECT]"))


def to_injection_prob(label: Column, score: Column) -> Column:
    """P(injection) from a (top label, score) pair: score if the label names the injection class, else 1-score."""
    up = F.upper(label)
    pos = up.contains("INJECTION") | up.contains("MALICIOUS") | up.contains("LABEL_1") | up.contains("HARMFUL")
    return F.round(F.when(pos, score).otherwise(F.lit(1.0) - score), 6)

