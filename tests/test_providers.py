import json

from hypothesis import given, settings
from hypothesis import strategies as st

from gatelens.operators import providers as pv


def _assemble_model(lines):
    parts, final = [], {}
    for line in lines:
        line = line.strip()
        if not line:
            continue
        try:
            chunk = json.loads(line)
        except json.JSONDecodeError:
            continue
        frag = chunk.get("message", {}).get("content", "")
        if frag:
            parts.append(frag)
        if chunk.get("done", False):
            final = chunk
    reason = {"stop": "stop", "length": "length"}.get(final.get("done_reason") or "", "stop")
    return "".join(parts), final.get("model"), reason, final.get("eval_count", 0)


@st.composite
def _line(draw):
    kind = draw(st.sampled_from(["chunk", "chunk", "done", "blank", "broken", "trailing"]))
    frag = draw(st.sampled_from(["Hel", "lo", " wor", "ld", "", "é"]))
    if kind == "blank":
        return draw(st.sampled_from(["", "   ", "\t"]))
    if kind == "broken":
        return '{"message": {"content": "x"'
    body = {"model": draw(st.sampled_from(["m1", "m2"])), "message": {"role": "assistant", "content": frag},
            "done": kind == "done"}
    if kind == "done":
        body["done_reason"] = draw(st.sampled_from(["stop", "length", "unload"]))
        body["eval_count"] = draw(st.integers(0, 50))
    text = json.dumps(body)
    return text + " junk" if kind == "trailing" else text


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(_line(), min_size=1, max_size=12), min_size=1, max_size=8))
def test_chunk_assembly_matches_model(spark, streams):
    rows = [(rid, seq, line) for rid, lines in enumerate(streams) for seq, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "response_id long, seq long, line string")
    got = {r["response_id"]: r for r in pv.assemble_chunks(df).collect()}
    for rid, lines in enumerate(streams):
        content, model, reason, n = _assemble_model(lines)
        if rid not in got:              # no decodable line at all: nothing to assemble
            assert content == "" and model is None, lines
            continue
        r = got[rid]
        assert (r["content"], r["model"], r["finish_reason"], r["completion_tokens"]) == (content, model, reason, n), lines


def _shape_model(req):
    msgs = req["messages"]
    if req["provider"] == "openai":
        return (len(msgs), None, req["max_tokens"], req["stop"], None, False)
    if req["provider"] == "anthropic":
        system = [m["content"] for m in msgs if m["role"] == "system"]
        rest = [m for m in msgs if m["role"] != "system"]
        stop = req["stop"] if req["stop"] else None
        return (len(rest), "\n".join(system) if system else None,
                req["max_tokens"] if req["max_tokens"] is not None else 1024, stop, None, False)
    options = {k: req[k] for k in ("temperature", "top_p", "top_k", "num_predict") if req[k] is not None}
    if req["max_tokens"] is not None and "num_predict" not in options:
        options["num_predict"] = req["max_tokens"]
    return (len(msgs), None, options.get("num_predict"), None, ",".join(sorted(options)) if options else None, True)


_msg = st.fixed_dictionaries({"role": st.sampled_from(["system", "user", "assistant"]),
                              "content": st.sampled_from(["be brief", "hi", "hello there"])})
_req = st.fixed_dictionaries({
    "provider": st.sampled_from(["openai", "anthropic", "local"]), "messages": st.lists(_msg, min_size=1, max_size=5),
    "temperature": st.sampled_from([None, 0.2]), "top_p": st.sampled_from([None, 0.9]), "top_k": st.sampled_from([None, 40]),
    "num_predict": st.sampled_from([None, 64]), "max_tokens": st.sampled_from([None, 256]), "stop": st.sampled_from([None, "", "###"])})


@settings(max_examples=25, deadline=None)
@given(st.lists(_req, min_size=1, max_size=12))
def test_request_shapes_match_adapters(spark, reqs):
    rows = [(i, r["provider"], "m", r["messages"], r["temperature"], r["top_p"], r["top_k"], r["num_predict"],
             r["max_tokens"], r["stop"]) for i, r in enumerate(reqs)]
    df = spark.createDataFrame(rows, "request_id long, provider string, model string, "
                                     "messages array<struct<role:string,content:string>>, temperature double, top_p double, "
                                     "top_k int, num_predict int, max_tokens int, stop string")
    got = {r["request_id"]: (r["n_messages"], r["system"], r["max_tokens"], r["stop_sequences"], r["options_keys"], r["stream"])
           for r in pv.shape_requests(df).collect()}
    for i, r in enumerate(reqs):
        assert got[i] == _shape_model(r), r


from gatelens.operators import prompts as pr  # noqa: E402


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), st.sampled_from(["a", "b c", "d"])),
                         min_size=1, max_size=6), min_size=1, max_size=6))
def test_conversation_reshaping_matches_model(spark, convs):
    rows = [(c, t, role, text) for c, msgs in enumerate(convs) for t, (role, text) in enumerate(msgs)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = {(r["conv_id"], r["turn"]): r["request"] for r in pr.turn_pairs(df).collect()}
    last = {r["conv_id"]: r["user_text"] for r in pr.last_user_text(df).collect()}
    split = {r["conv_id"]: (r["system"], r["messages"]) for r in pr.split_system(df).collect()}
    flat = {r["conv_id"]: r["prompt"] for r in pr.flatten_prompts(df).collect()}
    for c, msgs in enumerate(convs):
        users = [text for role, text in msgs if role == "user"]
        assert last[c] == (users[-1] if users else "")
        assert flat[c] == "\n".join(f"{role}: {text}" for role, text in msgs)
        system = [text for role, text in msgs if role == "system"]
        rest = "\n".join(f"{role}: {text}" for role, text in msgs if role != "system")
        assert split[c] == ("\n".join(system) if system else None, rest)
        for t, (role, _) in enumerate(msgs):
            if role == "assistant":
                earlier = [text for r, text in msgs[:t] if r == "user"]
                assert pairs[(c, t)] == (earlier[-1] if earlier else "")
