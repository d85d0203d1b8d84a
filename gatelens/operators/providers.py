"""Provider payload reshaping as column expressions: request layouts, response normalisation, chunk assembly.

Each provider layout is one projection over the rows routed to it; layouts are
combined with ``unionByName``. Chunked (streamed) responses are reassembled
with one grouping per response id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.lexicon import strict_parse_json

# Provider translation rules.
INTERNAL_FIELDS = ["app_id", "x_provider", "x_request_id"]
ANTHROPIC_DEFAULT_MAX_TOKENS = 1024
LOCAL_OPTION_FIELDS = ["temperature", "top_p", "top_k", "num_predict", "num_ctx", "repeat_penalty", "seed", "tfs_z",
                       "typical_p"]
ANTHROPIC_STOP_MAP = {"end_turn": "stop", "max_tokens": "length", "stop_sequence": "stop"}
LOCAL_DONE_MAP = {"stop": "stop", "length": "length"}


def _map(col, mapping: dict, default: str):
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(col == k, v).otherwise(out)
    return F.when(col.isNull(), default).otherwise(out)


def shape_requests(req: DataFrame) -> DataFrame:
    """Canonical requests → provider bodies, flattened for reporting.

    Input columns: request_id, provider, model, messages array<struct<role,content>>, temperature, top_p,
    top_k, num_predict, max_tokens, stop, plus internal fields. Output: one row per request with the
    fields each provider would receive.
    """
    sys_msgs = F.filter("messages", lambda m: m["role"] == "system")
    rest = F.filter("messages", lambda m: m["role"] != "system")
    common = [F.col("request_id"), F.col("provider"), F.col("model")]
    openai = req.filter(F.col("provider") == "openai").select(
        *common, F.size("messages").alias("n_messages"), F.lit(None).cast("string").alias("system"),
        F.col("max_tokens").cast("long").alias("max_tokens"), F.col("stop").alias("stop_sequences"),
        "temperature", "top_p", F.lit(None).cast("string").alias("options_keys"), F.lit(False).alias("stream"))
    anthropic = req.filter(F.col("provider") == "anthropic").select(
        *common, F.size(rest).alias("n_messages"),
        F.when(F.size(sys_msgs) > 0, F.array_join(F.transform(sys_msgs, lambda m: m["content"]), "\n")).alias("system"),
        F.coalesce(F.col("max_tokens"), F.lit(ANTHROPIC_DEFAULT_MAX_TOKENS)).cast("long").alias("max_tokens"),
        F.when(F.col("stop") != "", F.col("stop")).alias("stop_sequences"),
        "temperature", "top_p", F.lit(None).cast("string").alias("options_keys"), F.lit(False).alias("stream"))
    present = [F.when(F.col(f).isNotNull(), F.lit(f)) for f in LOCAL_OPTION_FIELDS if f in req.columns]
    keys = F.filter(F.array(*present), lambda x: x.isNotNull())
    keys = F.when(F.col("max_tokens").isNotNull() & F.col("num_predict").isNull(),
                  F.array_union(keys, F.array(F.lit("num_predict")))).otherwise(keys)
    local = req.filter(F.col("provider") == "local").select(
        *common, F.size("messages").alias("n_messages"), F.lit(None).cast("string").alias("system"),
        F.coalesce(F.col("num_predict"), F.col("max_tokens")).cast("long").alias("max_tokens"),
        F.lit(None).cast("string").alias("stop_sequences"), "temperature", "top_p",
        F.when(F.size(keys) > 0, F.array_join(F.array_sort(keys), ",")).alias("options_keys"), F.lit(True).alias("stream"))
    return openai.unionByName(anthropic).unionByName(local)


def normalise_responses(openai: DataFrame, anthropic: DataFrame, local: DataFrame) -> DataFrame:
    """Three raw layouts → (response_id, provider, content, finish_reason, prompt/completion/total tokens)."""
    o = openai.select(
        "response_id", F.lit("openai").alias("provider"),
        F.coalesce(F.col("choices")[0]["message"]["content"], F.lit("")).alias("content"),
        F.coalesce(F.col("choices")[0]["finish_reason"], F.lit("stop")).alias("finish_reason"),
        F.coalesce("usage.prompt_tokens", F.lit(0)).cast("long").alias("prompt_tokens"),
        F.coalesce("usage.completion_tokens", F.lit(0)).cast("long").alias("completion_tokens"),
        F.coalesce("usage.total_tokens", F.coalesce("usage.prompt_tokens", F.lit(0)) + F.coalesce("usage.completion_tokens", F.lit(0)))
        .cast("long").alias("total_tokens"))
    text_blocks = F.filter("content", lambda b: b["type"] == "text")
    pt, ct = F.coalesce("usage.input_tokens", F.lit(0)).cast("long"), F.coalesce("usage.output_tokens", F.lit(0)).cast("long")
    a = anthropic.select(
        "response_id", F.lit("anthropic").alias("provider"),
        F.array_join(F.transform(text_blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "").alias("content"),
        _map(F.col("stop_reason"), ANTHROPIC_STOP_MAP, "stop").alias("finish_reason"),
        pt.alias("prompt_tokens"), ct.alias("completion_tokens"), (pt + ct).alias("total_tokens"))
    lp, lc = F.coalesce("prompt_eval_count", F.lit(0)).cast("long"), F.coalesce("eval_count", F.lit(0)).cast("long")
    l_ = local.select(
        "response_id", F.lit("local").alias("provider"), F.coalesce("message.content", F.lit("")).alias("content"),
        _map(F.col("done_reason"), LOCAL_DONE_MAP, "stop").alias("finish_reason"),
        lp.alias("prompt_tokens"), lc.alias("completion_tokens"), (lp + lc).alias("total_tokens"))
    return o.unionByName(a).unionByName(l_)


def assemble_chunks(lines: DataFrame, id_col: str = "response_id", seq_col: str = "seq", line_col: str = "line") -> DataFrame:
    """NDJSON stream lines → one response: fragments in arrival order; blank/undecodable lines skipped;
    metadata (model, done_reason, token counts) from the last ``done=true`` chunk."""
    schema = ("model string, message struct<role:string,content:string>, done boolean, done_reason string, "
              "prompt_eval_count long, eval_count long")
    parsed = lines.select(id_col, seq_col, F.from_json(F.trim(F.col(line_col)), schema).alias("c"),
                          strict_parse_json(F.trim(F.col(line_col))).isNotNull().alias("ok"))
    good = parsed.filter(F.col("ok"))
    frag = F.coalesce(F.col("c.message.content"), F.lit(""))
    g = good.groupBy(id_col).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(seq_col).alias("k"), frag.alias("v")))),
                                 lambda x: x["v"]), "").alias("content"),
        F.max_by("c", F.when(F.col("c.done"), F.col(seq_col))).alias("final"))
    return g.select(id_col, "content", F.col("final.model").alias("model"),
                    _map(F.col("final.done_reason"), LOCAL_DONE_MAP, "stop").alias("finish_reason"),
                    F.coalesce("final.prompt_eval_count", F.lit(0)).alias("prompt_tokens"),
                    F.coalesce("final.eval_count", F.lit(0)).alias("completion_tokens"))
