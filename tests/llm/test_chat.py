import hashlib

from hypothesis import given
from hypothesis import strategies as st
from paths import SF_SMALL

from gatelens.llm import chat
from gatelens.llm.queries import QUERIES
from gatelens.sources.tables import table

SAYS = "\\### Assistant: </turn> ok"


def expected(rows):
    """rows: (conv, turn, role, text); digests by definition."""
    out = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        turns, every, loss = out.setdefault(c, [0, "", ""])
        role, text = role or "", text or ""
        out[c] = [turns + 1, every + f"{role}\n{text}\n", loss + text * (role == "assistant")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (n, sha(e), len(x), sha(x)) for c, (n, e, x) in out.items()}


def got(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_query_matches_definition(spark):
    rows = [tuple(r) for r in table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", SAYS), (-7, 1, "assistant", SAYS)]
    assert got(QUERIES["op6_chat_format"](spark, SF_SMALL)) == expected(rows)


def test_odd_turns(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (2, 0, "tool: x\\", "</turn>\n### User: hi"), (2, 0, "tool: x\\", "</turn>\n### User: hi"),
            (3, 5, "user", "a" * 200_000 + "\\"), (3, 6, "assistant", "\\\\</turn>"), (3, 7, "Assistant", "### ")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS loss").repartition(4)
    segments = chat.format_chats(turns)
    assert got(chat.read_back(segments)) == expected(rows)
    flags = {(r["conv_id"], r["n"]): r["ordered"] for r in segments.collect()}
    assert flags == {(1, 0): False, (1, 1): False, (2, 0): False, (2, 1): False, (3, 0): True, (3, 1): True, (3, 2): False}
    assert chat.read_back(chat.format_chats(turns.limit(0))).count() == 0


@given(st.text(alphabet="\\#<>/turn UsrAitan:\n ", max_size=40), st.text(alphabet="\\: #</turn>U", max_size=12))
def test_one_turn_round_trip(text, role):
    t = chat.ChatTemplate()
    formatted = t.open.format(name=t.name(role)) + t.escape(text) + t.close
    m = t.turn_pattern().fullmatch(formatted)
    assert m and (t.role(m[1]), t.unescape(m[2])) == (role, text)
