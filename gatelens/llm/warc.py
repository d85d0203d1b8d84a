"""WARC not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

Only ids, validators and headers are joined; payloads stay where they are. A URL's records are cut into chunks of
time: the latest response inside a chunk is found there, and each chunk gets the latest response of the chunks before
it from one row per chunk, so a URL with most of all records is spread over its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: headers that a 304 answer may update in the stored response (RFC 9110, 15.4.5, and RFC 9111)
PERMITTED_HEADERS = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
# fixed values: query parameters that do not select another page
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|sessionid|sid|phpsessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """host/path?query without scheme, user, www, default port, fragment and tracking parameters; host in lower case,
    parameters sorted. Null stays null."""
    bare = F.regexp_replace(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//|#.*$", "")
    whole = F.regexp_extract(bare, r"^([^/?]*)([^?]*)\??([\s\S]*)$", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(whole, r"^[^@]*@", "")), r"^www[0-9]*\.|:(80|443)$", "")
    path = F.regexp_extract(bare, r"^([^/?]*)([^?]*)\??([\s\S]*)$", 2)
    query = F.regexp_extract(bare, r"^([^/?]*)([^?]*)\??([\s\S]*)$", 3)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    joined = F.array_join(kept, "&")
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined)))


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored headers, with the permitted ones replaced or added from the update."""
    allowed = F.map_filter(update, lambda k, v: k.isin(*PERMITTED_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.coalesce(F.map_contains_key(allowed, k), F.lit(False))), allowed)


def resolve_revisits(records: DataFrame, chunk_seconds: int = 86_400) -> DataFrame:
    """Each revisit with the response it repeats: (record_id, canonical_url, status, response_id, headers).

    ``records``: record_id long, kind ('response' | 'revisit'), url, ts (seconds, long), etag, last_modified,
    headers map<string, string> (lower-case names). The response is the latest one of the same canonical URL with a
    smaller ts; among equal times the largest record_id. status is 'resolved' if the revisit's etag equals the response's (or,
    without an etag, its last_modified does), 'changed' if a validator differs, 'unchecked' if the revisit has none,
    and 'missing' without an earlier response. Headers are merged only when resolved, else they are the revisit's own;
    null headers count as empty. A null url or ts resolves to nothing ('missing'); rows of another kind are left out.
    Repeated rows are records of their own. Other columns are not read.
    """
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), "kind", canonical_url(F.col("url")).alias("canonical_url"),
        F.col("ts").cast("long").alias("ts"), "etag", "last_modified",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers")) \
        .where("kind IN ('response', 'revisit')").withColumn("chunk", F.floor(F.col("ts") / chunk_seconds))
    known = "canonical_url IS NOT NULL AND ts IS NOT NULL"
    answer = F.struct("ts", "record_id", "etag", "last_modified", "headers")
    responses = rows.where(f"kind = 'response' AND {known}")
    # max() cannot order maps: the latest response of a chunk is named by (ts, record_id) and its fields follow by max_by
    last = responses.groupBy("canonical_url", "chunk").agg(F.max_by(answer, F.struct("ts", F.coalesce("record_id", F.lit(-1)))).alias("last"))
    at_chunks = rows.where(known).groupBy("canonical_url", "chunk").agg(F.count("*").alias("n")).select("canonical_url", "chunk") \
        .join(last, ["canonical_url", "chunk"], "left")
    before = at_chunks.withColumn("carried", F.last("last", ignorenulls=True).over(
        Window.partitionBy("canonical_url").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))) \
        .where("carried IS NOT NULL").select("canonical_url", "chunk", "carried")
    inside = rows.where(known).withColumn("near", F.last(F.when(F.col("kind") == "response", answer), ignorenulls=True).over(
        Window.partitionBy("canonical_url", "chunk").orderBy(
            "ts", F.when(F.col("kind") == "revisit", 0).otherwise(1), F.col("record_id").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("kind = 'revisit'")
    found = inside.join(before, ["canonical_url", "chunk"], "left").withColumn("answer", F.coalesce("near", "carried"))
    lost = rows.where(f"kind = 'revisit' AND NOT coalesce({known}, false)").withColumn("answer", F.lit(None).cast(
        "struct<ts:bigint,record_id:bigint,etag:string,last_modified:string,headers:map<string,string>>"))
    names = ["record_id", "canonical_url", "etag", "last_modified", "headers", "answer"]
    every = found.select(names).unionByName(lost.select(names))
    status = F.when(F.col("answer").isNull(), "missing") \
        .when(F.col("etag").isNotNull(), F.when(F.col("etag").eqNullSafe(F.col("answer.etag")), "resolved").otherwise("changed")) \
        .when(F.col("last_modified").isNotNull(),
              F.when(F.col("last_modified").eqNullSafe(F.col("answer.last_modified")), "resolved").otherwise("changed")) \
        .otherwise("unchecked")
    return every.withColumn("status", status).select(
        "record_id", "canonical_url", "status",
        F.when(F.col("status") == "resolved", F.col("answer.record_id")).alias("response_id"),
        F.when(F.col("status") == "resolved", merged_headers(F.col("answer.headers"), F.col("headers")))
        .otherwise(F.col("headers")).alias("headers"))


def capture_log(pages: DataFrame) -> DataFrame:
    """A capture log derived from ``pages(page_id, url, html)``: each page is a full response at page_id minutes; every
    fourth is captured again, changed, twelve hours later; two of three are revisited under another address of the same
    page, with the etag, with last-modified alone, with an outdated etag or with no validator."""
    p = pages.select(F.col("page_id").cast("long").alias("p"), "url", F.md5(F.coalesce("html", F.lit(""))).alias("tag"))
    ts = F.col("p") * 60
    again = F.regexp_replace("url", r"[?#].*$", "")

    def record(number: int, kind: str, url: Column, when: Column, etag: Column, modified: Column, extra: dict[str, Column]) -> Column:
        headers = F.map_filter(F.create_map(
            F.lit("etag"), etag, F.lit("last-modified"), modified, F.lit("date"), when.cast("string"),
            *(x for k, v in extra.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
        return F.struct((F.col("p") * 4 + number).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"),
                        when.alias("ts"), etag.alias("etag"), modified.alias("last_modified"), headers.alias("headers"))

    none = F.lit(None).cast("string")
    stamp = ts.cast("string")
    full = {"content-type": F.lit("text/html"), "server": F.lit("s1"), "cache-control": F.lit("max-age=60")}
    second = F.concat("tag", F.lit("-2"))
    how = F.col("p") % 5
    revisit_tag = F.when(how < 2, F.when(F.col("p") % 4 == 0, second).otherwise(F.col("tag"))).when(how == 3, F.lit("old"))
    light = {"server": F.lit("s2"), "cache-control": F.lit("max-age=600"), "set-cookie": F.lit("a=1")}
    records = F.array(
        record(0, "response", F.col("url"), ts, F.col("tag"), stamp, full),
        F.when(F.col("p") % 4 == 0, record(1, "response", again, ts + 43_200, second, stamp, full)),
        F.when(F.col("p") % 3 != 0, record(2, "revisit", F.concat(again, F.lit("?utm_source=again")), ts + 50_000 + F.col("p") % 7 * 30_000,
                                           revisit_tag, F.when(how.isin(1, 2), stamp).otherwise(none), light)))
    return p.select(F.explode(F.filter(records, lambda r: r.isNotNull())).alias("r")).select("r.*")
