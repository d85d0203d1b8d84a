"""Contract rules as data: plan size, blocked responses, large rule tables, schema numbers."""

import json

import pytest
from pyspark.sql import functions as F

from gatelens.operators import contracts as ct
from gatelens.operators import rules as rd


def app_rules(k):
    rules = [{"type": "keyword", "keywords": [f"word{k}", "secret"]}, {"type": "regex", "pattern": rf"\bcode-{k}\b", "action": "flag"},
             {"type": "length_limit", "max_words": 3 + k % 5}, {"type": "sentiment", "min_score": -0.5, "action": "log"},
             {"type": "schema", "json_schema": {"type": "string", "maxLength": 10 + k}, "action": "flag"},
             {"type": "composite", "operator": "OR", "contracts": [
                 {"id": "m", "name": "m", "type": "keyword", "keywords": ["secret"]},
                 {"id": "n", "name": "n", "type": "composite", "operator": "AND", "contracts": [
                     {"id": "o", "name": "o", "type": "length_limit", "max_characters": 5}]}]}]
    return [ct.parse_contract(dict(r, id=f"{k}-{i}", name="r")) for i, r in enumerate(rules)]


def pairs(spark, apps):
    texts = ["secret plan", "all good here and there and back", "word7 code-7", ""]
    return spark.createDataFrame([(4 * a + i, f"app{a}", "", t) for a in apps for i, t in enumerate(texts)],
                                 "id long, app_id string, request string, response string")


def test_plan_does_not_grow_with_apps_and_rows_do_not_change(spark):
    sizes, rows = {}, {}
    for n in (8, 100, 10_000):
        defs = {f"app{k}": app_rules(k) for k in range(n)}
        df = ct.contract_verdicts(pairs(spark, [0, 7]), defs, ["id"])
        sizes[n] = len(df._jdf.queryExecution().optimizedPlan().toString())
        rows[n] = sorted(map(tuple, df.select("id", "contract_id", "passed", "compliance", "message", "evidence", "location").collect()))
        tiered = sorted((r["id"], r["contract_id"]) for r in ct.contract_tiered(pairs(spark, [0, 7]), defs, ["id"]).collect())
        rows[n].append(tiered)
    assert max(sizes.values()) < 1.05 * min(sizes.values())      # names of columns are numbered, so lengths differ a little
    assert rows[8] == rows[100] == rows[10_000]
    found = {(r[0], r[1]): r for r in rows[8][:-1]}
    assert found[(0, "0-0")][2] is False and found[(30, "7-0")][5] == "word7" and found[(30, "7-1")][6].endswith("[6:12]")
    assert found[(1, "0-2")][4] == "Word count 7 exceeds limit 3" and found[(29, "7-2")][4] == "Word count 7 exceeds limit 5"
    assert found[(1, "0-4")][4] == "JSON Schema validation failed: is longer than 10" and found[(0, "0-5")][3] == 0.0


def test_large_rule_tables_are_joined_by_a_shuffle_with_equal_rows(spark, monkeypatch):
    defs = {f"app{k}": app_rules(k) for k in range(30)}

    def rows():
        return sorted(map(str, ct.contract_report(pairs(spark, [0, 7, 99]), defs, ["id"]).collect()))
    small = rows()
    monkeypatch.setattr(rd, "BROADCAST_CHARS", 10)
    table = rd.rule_table(spark, defs, ct.static_tier, ct.regex_java, ct._quote)
    assert not table.small and rows() == small and len(small) == 12
    assert any("blocked=False" in r and "total_contracts=0" in r for r in small)


def test_no_check_sees_a_blocked_response(spark):
    def judge(frame):
        assert not any("secret" in t for t in frame["response"]), "a blocked response reached the judge"
        return frame.assign(failed=[json.loads(p)["limit"] < len(t) for p, t in zip(frame["params"], frame["response"])], compliance=0.5,
                            message="too long", evidence=frame["response"], location=None)
    ct.register_batch_type("length_judge", judge)
    try:
        rules = [{"id": "b", "name": "b", "type": "keyword", "keywords": ["secret"]},
                 {"id": "j", "name": "j", "type": "length_judge", "limit": 5, "action": "flag"}]
        defs = {"a": [ct.parse_contract(r) for r in rules]}
        df = spark.createDataFrame([(1, "a", "", "a secret"), (2, "a", "", "short"), (3, "a", "", "much longer")],
                                   "id int, app_id string, request string, response string")
        got = {(r["id"], r["contract_id"]): (r["passed"], r["message"]) for r in ct.contract_tiered(df, defs, ["id"]).collect()}
    finally:
        del rd.BATCHES["length_judge"], ct.KIND_TIER["length_judge"]
    assert got == {(1, "b"): (False, got[(1, "b")][1]), (2, "b"): (True, None), (3, "b"): (True, None), (2, "j"): (True, None), (3, "j"): (False, "too long")}


def test_a_batch_check_runs_once_and_on_bounded_frames(spark, monkeypatch):
    defs = {"app0": app_rules(0), "app7": app_rules(7)}
    plan = ct.contract_verdicts(pairs(spark, [0, 7]), defs, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1

    def judge(frame):
        return frame.assign(failed=len(frame) > 2, compliance=1.0, message="a large frame", evidence=frame["response"], location=None)
    monkeypatch.setattr(rd, "CHECKED_ROWS", 2, raising=False)
    monkeypatch.setitem(ct.KIND_TIER, "own", "deterministic")
    monkeypatch.setitem(rd.BATCHES, "own", judge)
    own = {"a": [ct.parse_contract({"id": f"r{k}", "name": "r", "type": "own"}) for k in range(3)]}
    df = spark.createDataFrame([(i, "a", "", f"t{i}") for i in range(5)], "id int, app_id string, request string, response string").coalesce(1)
    assert [r["passed"] for r in ct.contract_verdicts(df, own, ["id"]).collect()] == [True] * 15


@pytest.mark.parametrize("schema, good, bad", [
    ({"enum": [1, 2], "const": 2}, ["2"], ["1", "3"]),
    ({"maximum": 2 ** 53}, [str(2 ** 53)], [str(2 ** 53 + 1)]),
    ({"exclusiveMinimum": 10 ** 17}, [str(10 ** 17 + 1)], [str(10 ** 17)]),
    ({"multipleOf": 0.1}, ["0.3", "1.1", "7"], ["0.35", "0.30000001"]),
    ({"multipleOf": 3}, ["900000000000000003", "9"], ["10", "100000000000000001"])])
def test_schema_numbers_are_exact(spark, schema, good, bad):
    rows = [(i, "a", "", t) for i, t in enumerate([*good, *bad])]
    df = spark.createDataFrame(rows, "id int, app_id string, request string, response string")
    defs = {"a": [ct.parse_contract({"id": "s", "name": "s", "type": "schema", "json_schema": schema})]}
    got = {r["id"]: r["passed"] for r in ct.contract_verdicts(df, defs, ["id"]).collect()}
    assert got == {i: i < len(good) for i in range(len(rows))}
    compiled = ct.schema_check(schema, F.parse_json("response")).isNull().alias("ok")
    assert {r["id"]: r["ok"] for r in df.select("id", compiled).collect()} == got
