from gatelens.operators import prompts as pr


def test_multi_part_content_keeps_only_text_blocks(spark):
    schema = "conv_id long, turn long, role string, text array<struct<type:string,text:string,url:string>>"
    rows = [(1, 0, "user", [("text", "see this", None), ("image_url", None, "http://x"), ("text", "and that", None)]),
            (1, 1, "assistant", [("text", "ok", None)]), (1, 2, "user", [("image_url", None, "http://y")]), (2, 0, None, None),
            (3, 0, "user", [("text", "a", None), ("text", None, None), ("text", "b", None)])]
    df = spark.createDataFrame(rows, schema)
    flat = {r["conv_id"]: r["prompt"] for r in pr.flatten_prompts(df).collect()}
    assert flat == {1: "user: see this\nuser: and that\nassistant: ok", 2: "", 3: "user: a\nuser: b"}
    last = {r["conv_id"]: r["user_text"] for r in pr.last_user_text(df).collect()}
    assert last == {1: "", 2: "", 3: "a b"}
