from pyspark.sql import functions as F

from gatelens.llm import warc

SCHEMA = "record_id long, kind string, url string, ts long, etag string, last_modified string, headers map<string,string>"


def canonical(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    return [r[0] for r in df.select(warc.canonical_url(F.col("u"))).collect()]


def test_canonical_urls(spark):
    same = ["http://www.Example.org/a/B?b=2&a=1#top", "https://example.org:443/a/B?a=1&utm_source=x&b=2", "//u:p@example.org/a/B?a=1&b=2&ref=q"]
    assert set(canonical(spark, same)) == {"example.org/a/B?a=1&b=2"}
    assert canonical(spark, ["http://x.org", "http://x.org/?", None, "", "http://x.org?q=1"]) == ["x.org/", "x.org/", None, "/", "x.org/?q=1"]


def resolve(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r["record_id"]: (r["status"], r["response_id"], r["headers"]) for r in warc.resolve_revisits(df, **options).collect()}


def brute(rows):
    def url(u):
        return None if u is None else u.split("#")[0].replace("http://", "").replace("www.", "")
    out = {}
    for i, kind, u, ts, etag, modified, headers in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[1] == "response" and u is not None and ts is not None and url(r[2]) == url(u) and r[3] is not None and r[3] < ts]
        headers = headers or {}
        if not earlier:
            out[i] = ("missing", None, headers)
            continue
        best = max(earlier, key=lambda r: (r[3], r[0]))
        status = ("resolved" if etag == best[4] else "changed") if etag is not None else \
            ("resolved" if modified == best[5] else "changed") if modified is not None else "unchecked"
        kept = {k: v for k, v in headers.items() if k in warc.PERMITTED_HEADERS}
        out[i] = ("resolved", best[0], {**(best[6] or {}), **kept}) if status == "resolved" else (status, None, headers)
    return out


def test_as_of_join_matches_brute_force_for_any_chunk(spark):
    import random
    rng, rows = random.Random(1), []
    for i in range(300):
        kind = rng.choice(["response", "revisit", "revisit"])
        rows.append((i, kind, rng.choice(["http://www.a.org/x#f", "http://a.org/x", "http://b.org/", "http://c.org/" + str(i), None]),
                     rng.choice([rng.randrange(1000), rng.randrange(20), None]), rng.choice([None, "1", "2"]), rng.choice([None, "m"]),
                     rng.choice([None, {}, {"etag": "9", "server": str(i), "age": "1"}, {"vary": "q"}])))
    for chunk in (1, 7, 100, 10_000):
        assert resolve(spark, rows, chunk_seconds=chunk) == brute(rows)


def test_empty_and_repeated(spark):
    assert resolve(spark, []) == {}
    row = (1, "revisit", "http://x.org/", 5, "e", None, None)
    first = (0, "response", "http://x.org/", 4, "e", None, {"a": "b"})
    df = spark.createDataFrame([first, first, row, row], SCHEMA).selectExpr("*", "1 AS chunk", "2 AS answer")
    assert [(r["status"], r["response_id"], r["headers"]) for r in warc.resolve_revisits(df).collect()] == [("resolved", 0, {"a": "b"})] * 2
