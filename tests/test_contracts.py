import json

import pytest
from pyspark.sql import functions as F

from gatelens.operators import contracts as ct


def run(spark, rule, response, request="", judge=None, kinds_app="a"):
    rows = [(1, kinds_app, request, response, judge)]
    df = spark.createDataFrame(rows, "id int, app_id string, request string, response string, judge_raw string")
    defs = {"a": [ct.parse_contract(rule)]}
    return ct.contract_verdicts(df, defs, ["id"], judge_raw="judge_raw").first()


def test_keyword_substring_case_insensitive(spark):
    v = run(spark, {"id": "k", "name": "k", "type": "keyword", "keywords": ["secret", "Password"]}, "my PASSWORD is a secret")
    assert not v["passed"] and v["evidence"] == "secret" and v["action"] == "block" and v["compliance"] == 0.0
    assert v["message"] == "Response contains forbidden keyword: 'secret'"


def test_keyword_whole_word(spark):
    rule = {"id": "k", "name": "k", "type": "keyword", "keywords": ["den"], "match_whole_word": True}
    assert run(spark, rule, "die Schäden sind gross")["passed"]
    assert not run(spark, rule, "in den Bergen")["passed"]


def test_keyword_case_sensitive(spark):
    rule = {"id": "k", "name": "k", "type": "keyword", "keywords": ["API"], "case_sensitive": True}
    assert run(spark, rule, "the api")["passed"] and not run(spark, rule, "the API")["passed"]


def test_regex_flags_and_location(spark):
    rule = {"id": "r", "name": "r", "type": "regex", "pattern": r"\d{4}-\d{4}", "flags": ["IGNORECASE", "nonsense"]}
    v = run(spark, rule, "card 1234-5678 ok")
    assert not v["passed"] and v["evidence"] == "1234-5678"
    assert v["location"] == "choices[0].message.content[5:14]"


def test_length_limits_all_reported(spark):
    rule = {"id": "l", "name": "l", "type": "length_limit", "max_words": 3, "max_characters": 10, "max_sentences": 1}
    v = run(spark, rule, "One two. Three four five!")
    assert v["message"] == ("Word count 5 exceeds limit 3; Character count 25 exceeds limit 10; "
                            "Sentence count 2 exceeds limit 1")
    assert v["evidence"] == "text_length=25"


def test_language_match_and_fail_open(spark):
    rule = {"id": "g", "name": "g", "type": "language_match"}
    assert not run(spark, rule, "the cat and the dog", request="der Hund und die Katze")["passed"]
    assert run(spark, rule, "the cat and the dog", request="")["passed"]          # blank user text → pass
    assert run(spark, rule, "   ", request="der Hund")["passed"]                  # blank response → pass
    assert run(spark, {"id": "g", "name": "g", "type": "language_match", "expected_language": "en"},
               "the cat is on the mat")["passed"]


def test_sentiment_compliance_formula(spark):
    rule = {"id": "s", "name": "s", "type": "sentiment", "min_score": 0.0}
    v = run(spark, rule, "terrible awful service")
    assert not v["passed"] and v["compliance"] == 0.0
    v = run(spark, rule, "great great bad")
    assert v["passed"] and v["compliance"] == pytest.approx((1 / 3 + 1) / 2)


@pytest.mark.parametrize("raw,passed,comp", [
    ('{"score": 0.9, "reasoning": "fine"}', True, 0.9),
    ('```json\n{"score": 0.3, "reasoning": "weak"}\n```', False, 0.3),
    ("I give it 85", True, 0.85),
    ("nothing numeric", False, 0.5),
    ('{"score": null}', True, 1.0),        # parse error → fail open
])
def test_judge(spark, raw, passed, comp):
    rule = {"id": "j", "name": "j", "type": "llm_judge", "assertion": "is polite", "threshold": 0.7, "action": "flag"}
    v = run(spark, rule, "resp", judge=raw)
    assert v["passed"] == passed and v["compliance"] == pytest.approx(comp)


def test_composite_or_and_semantics(spark):
    kw = {"id": "m1", "name": "m1", "type": "keyword", "keywords": ["bad"]}
    ln = {"id": "m2", "name": "m2", "type": "length_limit", "max_words": 100}
    v = run(spark, {"id": "c", "name": "c", "type": "composite", "operator": "OR", "contracts": [kw, ln]}, "bad")
    assert not v["passed"] and v["message"] == "Composite (OR) violated: 1/2 sub-contracts failed"
    assert v["evidence"] == "Response contains forbidden keyword: 'bad'" and v["compliance"] == 0.5
    v = run(spark, {"id": "c", "name": "c", "type": "composite", "operator": "AND", "contracts": [kw, ln]}, "bad")
    assert v["passed"]
    v = run(spark, {"id": "c", "name": "c", "type": "composite", "operator": "AND", "contracts": []}, "x")
    assert not v["passed"]                                                      # empty AND: 0 == 0


def test_schema_subset(spark):
    rule = {"id": "s", "name": "s", "type": "schema", "json_schema": {"type": "object", "required": ["a"],
            "properties": {"a": {"type": "integer", "maximum": 5}}}}
    assert run(spark, rule, '{"a": 3}')["passed"]
    assert "maximum" in run(spark, rule, '{"a": 9}')["message"]
    assert "'a' is a required property" in run(spark, rule, '{"b": 1}')["message"]
    assert "not of type object" in run(spark, rule, "plain text")["message"]
    for bad in ({"oneOf": []}, {"type": "text"}, {"contains": {}}):      # an invalid schema never blocks; lint reports it
        rule = {"id": "s", "name": "s", "type": "schema", "json_schema": bad}
        assert run(spark, rule, "{}")["passed"] and ct.lint_contract(rule)
    rule = {"id": "s", "name": "s", "type": "schema", "target_field": "usage.total_tokens", "json_schema": {"type": "string"}}
    assert "Could not extract target field" in run(spark, rule, "text")["message"]


def test_schema_keywords_and_paths(spark):
    cases = [({"required": ["a.b"]}, '{"a.b": 1}', '{"a": {"b": 1}}'), ({"properties": {"it's": {"type": "null"}}}, "{\"it's\": null}", "{\"it's\": 1}"),
             ({"oneOf": [{"type": "integer"}, {"minimum": 5}]}, "3", "7"), ({"uniqueItems": True}, "[1, 2]", "[1, 1]"),
             ({"multipleOf": 0.5}, "2.5", "2.4"), ({"enum": [{"a": [1]}, [2]]}, '{"a": [1]}', '{"a": [2]}'),
             ({"patternProperties": {"^n_": {"type": "number"}}, "additionalProperties": False}, '{"n_1": 1}', '{"m": 1}'),
             ({"patternProperties": {"^n_": {"type": "number"}}}, '{"n_1": 1, "z": "s"}', '{"n_1": "s"}'),
             ({"$ref": "#/$defs/x", "$defs": {"x": {"type": "boolean"}}}, "true", "1")]
    docs = [(2 * i + j, text) for i, (_, good, bad) in enumerate(cases) for j, text in enumerate((good, bad))]
    df = spark.createDataFrame(docs, "i int, t string").withColumn("v", F.parse_json("t"))
    checks = F.create_map(*(x for i, (schema, _, _) in enumerate(cases) for x in (F.lit(i), ct.schema_check(schema, F.col("v")).isNull())))
    got = {r["i"]: r["ok"] for r in df.select("i", checks[(F.col("i") / 2).cast("int")].alias("ok")).collect()}
    assert got == {i: i % 2 == 0 for i, _ in docs}
    v = spark.sql("""SELECT parse_json('{"0": 5, "l": [7, {"x.y": 1}]}') AS v""")
    paths = [ct.resolve_path(F.col("v"), p).cast("string").alias(str(n)) for n, p in enumerate(["0", "l.0", "l.1", "l.9", "q"])]
    assert list(v.select(*paths).first()) == ["5", "7", '{"x.y":1}', None, None]


def test_python_named_groups_run(spark):
    rule = {"id": "r", "name": "r", "type": "regex", "pattern": r"(?P<n>o+)x(?P=n)"}
    assert not ct.lint_contract(rule)
    assert run(spark, rule, "a ooxoo")["location"].endswith("[2:7]")


def test_tiered_skips_flags_when_blocked_and_unknown_app(spark):
    rules = {"a": [ct.parse_contract({"id": "b", "name": "b", "type": "keyword", "keywords": ["x"]}),
                   ct.parse_contract({"id": "f", "name": "f", "type": "keyword", "keywords": ["y"], "action": "flag"})]}
    df = spark.createDataFrame([(1, "a", "", "x y"), (2, "a", "", "y"), (3, "zzz", "", "x")],
                               "id int, app_id string, request string, response string")
    out = {(r["id"], r["contract_id"]): r["passed"] for r in ct.contract_tiered(df, rules, ["id"]).collect()}
    assert out == {(1, "b"): False, (2, "b"): True, (2, "f"): False}
    rep = {r["id"]: r for r in ct.contract_report(df, rules, ["id"]).collect()}
    assert rep[1]["blocked"] and rep[1]["violations"] == "b" and rep[1]["total_contracts"] == 2
    assert not rep[3]["blocked"] and rep[3]["total_contracts"] == 0


def test_lint_and_loading():
    assert ct.lint_contract({"id": "x", "name": "x", "type": "regex", "pattern": "(a"})
    assert "empty composite" in ct.lint_contract({"id": "x", "name": "x", "type": "composite", "contracts": []})
    defs, rejected = ct.load_definitions(ct.INVALID_CONTRACT_DIR)
    assert defs == {} and len(rejected) == 2
    defs, rejected = ct.load_definitions(ct.CONTRACT_DIR)
    assert set(defs) == {"app_0", "app_1"} and rejected == []
    assert ct.load_definitions("/nonexistent") == ({}, [])


def test_spark_reader_of_contract_files(spark):
    rules, rejected = ct.read_contracts(spark, ct.CONTRACT_DIR)
    assert {r["app_id"] for r in rules.select("app_id").distinct().collect()} == {"app_0", "app_1"}
    assert rejected.count() == 0
    _, bad = ct.read_contracts(spark, ct.INVALID_CONTRACT_DIR)
    assert [r["file_name"] for r in bad.collect()] == ["zz-broken.json"]


def test_custom_contract_type_plugs_in(spark):
    from pyspark.sql import functions as F

    def shouting(c, ctx):
        failed = ctx["response"] == F.upper(ctx["response"])
        return ct._verdict(c, failed, F.when(failed, 0.0).otherwise(1.0), F.lit("all caps"), ctx["response"],
                           F.lit(ct.CONTENT_LOCATION))
    ct.register_contract_type("no_shouting", shouting)
    v = run(spark, {"id": "x", "name": "x", "type": "no_shouting"}, "HELLO")
    assert not v["passed"] and v["message"] == "all caps"
    assert run(spark, {"id": "x", "name": "x", "type": "no_shouting"}, "Hello")["passed"]


import json as _json  # noqa: E402
import re as _re  # noqa: E402

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


def _score_model(content: str):
    """The gateway's judge-score parsing, restated: (score, reasoning) or None when a null-like score raises."""
    def clamp(x):
        return max(0.0, min(1.0, x))
    content = content.strip()
    try:
        parsed = _json.loads(content)
        return clamp(float(parsed.get("score", 0.5))), str(parsed.get("reasoning", ""))
    except TypeError:
        return None
    except (ValueError, AttributeError):
        pass
    m = _re.search(r"```(?:json)?\s*(\{.*?\})\s*```", content, _re.DOTALL)
    if m:
        try:
            parsed = _json.loads(m.group(1))
            return clamp(float(parsed.get("score", 0.5))), str(parsed.get("reasoning", ""))
        except TypeError:
            return None
        except ValueError:
            pass
    n = _re.search(r"(\d+\.?\d*)", content)
    if n:
        x = float(n.group(1))
        return clamp(x / 100.0 if x > 1.0 else x), content[:200]
    return 0.5, "Could not parse judge response: " + content[:200]


_scores = st.sampled_from(["0.9", "0.35", "1", "0", "85", '"0.75"', '"abc"', "null", "true", "false", "[]", "-0.5", "2.5", None])
_reasonings = st.sampled_from(['"fine"', "12", "null", "true", None])


@st.composite
def _judge_replies(draw):
    fields = []
    sc, rs = draw(_scores), draw(_reasonings)
    if sc is not None:
        fields.append(f'"score": {sc}')
    if rs is not None:
        fields.append(f'"reasoning": {rs}')
    obj = "{" + ", ".join(fields) + "}"
    shape = draw(st.sampled_from(["plain", "fenced", "fenced_json", "trailing", "number", "words", "bare"]))
    return {"plain": f"  {obj} ", "fenced": f"Here:\n```\n{obj}\n```", "fenced_json": f"```json {obj} ```",
            "trailing": f"{obj} (that is my score 7)", "number": "I'd say 73 out of 100", "words": "no idea",
            "bare": draw(st.sampled_from(["0.4", "85", "1.", "  42  "]))}[shape]


@settings(max_examples=40, deadline=None)
@given(st.lists(_judge_replies(), min_size=1, max_size=25))
def test_judge_score_parser_matches_reference_semantics(spark, raws):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id int, raw string")
    j = ct.judge_score_parse(F.col("raw"))
    got = {r["id"]: r for r in df.select("id", j.alias("j")).select("id", "j.*").collect()}
    for i, raw in enumerate(raws):
        want = _score_model(raw)
        if want is None:
            assert got[i]["path"] == "error", raw
        else:
            assert (got[i]["score"], got[i]["reasoning"]) == (round(want[0], 6), want[1]), raw


_text_frags = st.sampled_from(["word", "Den", "den", "Schäden", "x_y", "é", "2", ".", "!", "?", "...", " ", "  ", "\n", "\t",
                               "\x0b", "\x1c", "\xa0", " ", "　", "😀", "den.", "_den", "den2"])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(_text_frags, max_size=30), min_size=1, max_size=20))
def test_length_and_whole_word_match_python_semantics(spark, docs):
    texts = ["".join(d) for d in docs]
    rules = {"a": [ct.parse_contract({"id": "len", "name": "len", "type": "length_limit", "max_words": 1, "max_sentences": 1,
                                      "max_characters": 1}),
                   ct.parse_contract({"id": "kw", "name": "kw", "type": "keyword", "keywords": ["den"], "match_whole_word": True})]}
    df = spark.createDataFrame([(i, "a", "", t) for i, t in enumerate(texts)], "id int, app_id string, request string, response string")
    v = {(r["id"], r["contract_id"]): r for r in ct.contract_verdicts(df, rules, ["id"]).collect()}
    for i, t in enumerate(texts):
        words, chars = len(t.split()), len(t)
        sents = len([p for p in _re.split(r"[.!?]+", t) if p.strip()])
        want = []
        if words > 1:
            want.append(f"Word count {words} exceeds limit 1")
        if chars > 1:
            want.append(f"Character count {chars} exceeds limit 1")
        if sents > 1:
            want.append(f"Sentence count {sents} exceeds limit 1")
        assert (v[(i, "len")]["message"] or "") == "; ".join(want), repr(t)
        hit = _re.search(r"\bden\b", t.lower()) is not None
        assert (not v[(i, "kw")]["passed"]) == hit, repr(t)


@st.composite
def _tree(draw, depth=0):
    if depth >= 2 or draw(st.booleans()):
        kw = draw(st.sampled_from(["alpha", "beta", "gamma", "delta"]))
        return {"id": f"k{draw(st.integers(0, 9999))}", "name": "k", "type": "keyword", "keywords": [kw]}
    members = draw(st.lists(_tree(depth + 1), min_size=0, max_size=3))
    return {"id": f"c{draw(st.integers(0, 9999))}", "name": "c", "type": "composite",
            "operator": draw(st.sampled_from(["AND", "OR"])), "contracts": members}


def _eval_model(rule, text):
    """(passed, compliance, message) as the gateway evaluates keyword and composite rules."""
    if rule["type"] == "keyword":
        kw = rule["keywords"][0]
        hit = kw in text.lower()
        return (not hit, 0.0 if hit else 1.0, f"Response contains forbidden keyword: {kw!r}" if hit else None)
    subs = [_eval_model(m, text) for m in rule["contracts"]]
    fails = [s for s in subs if not s[0]]
    comp = sum(s[1] for s in subs) / len(subs) if subs else 1.0
    if rule["operator"] == "OR":
        return (not fails, comp, f"Composite (OR) violated: {len(fails)}/{len(subs)} sub-contracts failed" if fails else None)
    failed = len(fails) == len(subs)
    return (not failed, comp, f"Composite (AND) violated: all {len(subs)} sub-contracts failed" if failed else None)


@settings(max_examples=25, deadline=None)
@given(_tree(), st.lists(st.sampled_from(["alpha", "beta", "gamma", "delta", "other"]), max_size=4))
def test_composites_match_model(spark, rule, words):
    rule = dict(rule, id="root", type="composite") if rule["type"] == "composite" else {
        "id": "root", "name": "r", "type": "composite", "operator": "OR", "contracts": [rule]}
    text = " ".join(words)
    v = run(spark, rule, text)
    passed, comp, msg = _eval_model(rule, text)
    assert v["passed"] == passed and abs(v["compliance"] - comp) < 1e-12 and v["message"] == msg, (rule, text)


NESTED = {"$ref": "#/$defs/n", "$defs": {"n": {"type": "object", "required": ["v"], "properties": {"next": {"$ref": "#/$defs/n"}}}}}


def nested(depth, last):
    return json.dumps(last) if not depth else f'{{"v": 1, "next": {nested(depth - 1, last)}}}'


def test_schema_keywords_beyond_expressions(spark):
    cases = [({"minProperties": 2}, '{"a": 1, "b": 2}', '{"a": 1}'), ({"maxProperties": 1}, '{"a": 1}', '{"a": 1, "b": 2}'),
             ({"contains": {"type": "string"}}, '[1, "s"]', "[1]"), ({"contains": {"const": 1}, "maxContains": 1, "minContains": 0}, "[2]", "[1, 1]"),
             ({"dependentRequired": {"a": ["b"]}}, '{"b": 1}', '{"a": 1}'), ({"propertyNames": {"maxLength": 2}}, '{"ab": 1}', '{"abc": 1}'),
             ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, '{"c": 1}', '{"a": 1, "c": 1}'),
             ({"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, '["s", 1.0]', '["s", "t"]'),
             ({"allOf": [{"properties": {"a": {}}}], "unevaluatedProperties": False}, '{"a": 1}', '{"b": 1}'),
             ({"prefixItems": [{}], "unevaluatedItems": False}, "[1]", "[1, 2]"),
             ({"dependentSchemas": {"a": {"minProperties": 2}}}, '{"b": 1}', '{"a": 1}'),
             ({"$schema": "http://json-schema.org/draft-07/schema#", "items": [{"type": "string"}], "additionalItems": False}, '["s"]', '["s", 1]'),
             ({"$ref": "#n", "$defs": {"n": {"$anchor": "n", "type": "null"}}}, "null", "1"),
             ({"readOnly": True, "x-owner": [{}], "required": ["a"]}, '{"a": 1}', "{}"),
             (NESTED, nested(9, {"v": 1}), nested(9, {})), (NESTED, nested(200, {"v": 1}), nested(200, {})), ({"$ref": "#", "minProperties": 1}, '{"a": 1}', "{}")]
    docs = [(2 * i + j, text) for i, (_, good, bad) in enumerate(cases) for j, text in enumerate((good, bad))]
    df = spark.createDataFrame(docs, "i int, t string").withColumn("v", F.parse_json("t"))
    checks = [ct.schema_check(schema, F.col("v")).isNull().alias(f"c{i}") for i, (schema, _, _) in enumerate(cases)]
    got = {r["i"]: r[f"c{r['i'] // 2}"] for r in df.select("i", *checks).collect()}
    assert got == {i: i % 2 == 0 for i, _ in docs}


def test_an_invalid_schema_costs_its_own_rule_only(spark, tmp_path):
    rules = [{"id": "bad", "name": "bad", "type": "schema", "json_schema": {"type": "text", "required": ["a"]}},
             {"id": "odd", "name": "odd", "type": "schema", "json_schema": {"required": ["a"], "minProperties": 2, "x-owner": "me"}},
             {"id": "kw", "name": "kw", "type": "keyword", "keywords": ["b"]}]
    (tmp_path / "a.json").write_text(json.dumps({"app_id": "a", "version": "1", "contracts": rules}))
    defs, rejected = ct.load_definitions(str(tmp_path))
    assert [n for n, _ in rejected] == ["a.json"] and "bad: invalid schema" in rejected[0][1]
    pairs = spark.createDataFrame([(1, "a", "", '{"a": 1}'), (2, "a", "", '{"a": 1, "c": 2}'), (3, "a", "", '{"b": 1, "c": 2}')],
                                  "id int, app_id string, request string, response string")
    failed = {(r["id"], r["contract_id"]) for r in ct.contract_verdicts(pairs, defs, ["id"]).collect() if not r["passed"]}
    assert failed == {(1, "odd"), (3, "odd"), (3, "kw")}
