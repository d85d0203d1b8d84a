import hashlib

import brute
from paths import SF_SMALL

from gatelens.llm import pii
from gatelens.sources.tables import table

KINDS = list(pii.BASE)


def check(df):
    texts = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    rows = pii.find_personal_data(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        spans = brute.personal_spans(texts[r["doc_id"]])
        said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in KINDS] == [x for x in said.split(",") if x], r["doc_id"]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[1] == n for s in spans) for n in range(4)]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    return rows


def test_base_spans_of_the_small_table_match_brute_force(spark):
    check(table(spark, SF_SMALL, "documents"))


def test_base_spans_of_odd_texts_match_brute_force(spark):
    texts = [None, "", "a@b.c%d@e.f g@h h@i..j @k.l", "1.2.3.4.5.6.7.8 256.1.1.1 000.0255.1.1 0.0.0.0000000000000000001 99999999999.1.1.1",
             "é\U0001f600 4111 1111 1111 1111 4111-1111-1111-1112 4111  1111", "+1 (555) 010-9999. +12 +3456789012345678 +1-2-3-4-5-6-7-8-9-0-1()..5",
             "4" * 5000 + " x@" + "y" * 3000 + "." + "z" * 3000, "a." * 40_000 + "@b.c", "0" * 14 + "-" + "0" * 19 + " 0000000000000000",
             "x+1@2.3+4 5 6 7 8 9 0 1 2 3", "1" * 13 + "-2 +9" + "8" * 12 + "(", "a@b.c" * 500]
    check(spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string"))
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_weak_labels_add_likely_spans_and_no_overlaps(spark):
    rows = [(i, f"please call my phone {200 + i}-555-{1000 + i} today") for i in range(40)]
    rows += [(100 + i, f"social ssn {100 + i}-45-{2000 + i}.") for i in range(40)]
    rows += [(200 + i, f"invoice ref {123456789012 + i} total") for i in range(60)]
    rows += [(300 + i, f"contact anna at mail{i} dot com now") for i in range(20)]
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == "local_phone:21:33" for i in range(40))
    assert all(found[100 + i] == "ssn:11:22" for i in range(40))
    assert not any(found[200 + i] for i in range(60))
    assert found[300].startswith("email_words:8:")


def test_reliabilities_favour_agreeing_labelers():
    good, bad = (1, 1, 0, 0, 1, 0), (-1, -1, 0, 0, 1, 0)
    post, table_, prior = pii.reliabilities({good: 70, bad: 30})
    assert post[good] > 0.9 > 0.1 > post[bad] and 0.6 < prior < 0.8
    assert table_[0][1][1] > 0.9 > table_[0][1][0]


def test_plan_has_no_python(spark):
    df = pii.find_personal_data(spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
