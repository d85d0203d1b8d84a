"""DuckDB twins of the registered queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# fixed values: ASCII white space and letters, as the contracts name them
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES["op5_line_dedup"] = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM d),
k AS (SELECT *, translate(trim(line, {_SPACE}), {_LOWER}) AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""

# the synthetic pages hold their text in one article of h1 and p blocks; tags, references and white space as the contract says
ORACLES["op4_html_extraction"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
          replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'),
              '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""

ORACLES["op6_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, lag(role, 1, 'start') OVER w AS before, lead(role) OVER w IS NULL AS is_last FROM c
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (SELECT *, CASE before WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant'
                            WHEN 'assistant' THEN role = 'user' ELSE false END AS ordered,
             4 + 2 + 8 + length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '### ', ''))) // 4
             + (length(text) - length(replace(text, '</turn>', ''))) // 7
             + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE 5 + length(role) END AS chars FROM s)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and(ordered) AND bool_and(role = 'assistant' OR NOT is_last) AS well_ordered
FROM f GROUP BY conv_id
"""

# the capture log is derived as warc.capture_log says; the join is DuckDB's own as-of join
ORACLES["op8_warc_revisits"] = r"""
WITH p AS (SELECT page_id AS p, url, md5(coalesce(html, '')) AS tag, page_id * 60 AS ts, regexp_replace(url, '[?#].*$', '') AS again FROM pages),
responses AS (
  SELECT p * 4 AS record_id, url, ts, tag AS etag, ts::VARCHAR AS modified FROM p
  UNION ALL SELECT p * 4 + 1, again, ts + 43200, tag || '-2', ts::VARCHAR FROM p WHERE p % 4 = 0),
revisits AS (
  SELECT p * 4 + 2 AS record_id, again || '?utm_source=again' AS url, ts + 50000 + p % 7 * 30000 AS ts,
         CASE WHEN p % 5 < 2 THEN CASE WHEN p % 4 = 0 THEN tag || '-2' ELSE tag END WHEN p % 5 = 3 THEN 'old' END AS etag,
         CASE WHEN p % 5 IN (1, 2) THEN ts::VARCHAR END AS modified FROM p WHERE p % 3 <> 0),
u AS (SELECT *, 'a' AS side FROM responses UNION ALL SELECT *, 'r' FROM revisits),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//', ''), '#.*$', '') AS b FROM u),
parts AS (SELECT *, regexp_extract(b, '^([^/?]*)([^?]*)\??([\s\S]*)$', 1) AS h, regexp_extract(b, '^([^/?]*)([^?]*)\??([\s\S]*)$', 2) AS path,
                 regexp_extract(b, '^([^/?]*)([^?]*)\??([\s\S]*)$', 3) AS q FROM bare),
kept AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x),
           '^(utm_[a-z]+|ref|gclid|fbclid|sessionid|sid|phpsessionid)(=|$)'))), '&') AS params FROM parts),
c AS (SELECT *, regexp_replace(lower(regexp_replace(h, '^[^@]*@', '')), '^www[0-9]*\.|:(80|443)$', '', 'g') || CASE WHEN path = '' THEN '/' ELSE path END
             || CASE WHEN params = '' THEN '' ELSE '?' || params END AS canonical_url FROM kept),
a AS (SELECT canonical_url, ts, max(record_id) AS record_id, arg_max(etag, record_id) AS etag, arg_max(modified, record_id) AS modified
      FROM c WHERE side = 'a' GROUP BY canonical_url, ts),
r AS (SELECT * FROM c WHERE side = 'r'),
j AS (SELECT r.record_id, r.canonical_url, r.ts, r.etag, r.modified, a.record_id AS found, a.etag AS a_etag, a.modified AS a_modified, a.ts AS a_ts
      FROM r ASOF LEFT JOIN a ON r.canonical_url = a.canonical_url AND r.ts > a.ts),
s AS (SELECT *, CASE WHEN found IS NULL THEN 'missing' WHEN etag IS NOT NULL THEN CASE WHEN etag = a_etag THEN 'resolved' ELSE 'changed' END
                     WHEN modified IS NOT NULL THEN CASE WHEN modified = a_modified THEN 'resolved' ELSE 'changed' END ELSE 'unchecked' END AS status FROM j)
SELECT record_id, canonical_url, status, CASE WHEN status = 'resolved' THEN found END AS response_id,
       CASE WHEN status = 'resolved' THEN concat_ws(chr(10), 'cache-control: max-age=600', 'content-type: text/html', 'date: ' || ts,
                 'etag: ' || coalesce(etag, a_etag), 'last-modified: ' || coalesce(modified, a_modified), 'server: s1')
            ELSE concat_ws(chr(10), 'cache-control: max-age=600', 'date: ' || ts, 'etag: ' || etag, 'last-modified: ' || modified, 'server: s2', 'set-cookie: a=1') END AS headers
FROM s
"""

# h is the checksum of the decimal id, bit by bit. A run of at least max(12, 2 q) words has 6 equal words in a row at distance
# q or more often, so windows of six words that recur in a text give every run: neighbouring starts at one distance are joined
ORACLES["op13_periodic_runs"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
                  list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                      lambda c: list_concat([ascii(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
                    lambda s, e: CASE WHEN e >= 0 THEN xor(s, e) ELSE xor(s >> 1, (s & 1) * 3988292384) END) AS c FROM documents),
h AS (SELECT r, doc_id, w, len(w) AS n, xor(c, 4294967295) AS h, xor(c, 4294967295) // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
six AS (SELECT r, unnest(range(n - 5)) AS i, unnest(list_transform(range(n - 5), lambda i: hash(w[i + 1 : i + 6]))) AS k FROM t WHERE n >= 12),
again AS (SELECT r, k FROM six GROUP BY r, k HAVING count(*) > 1),
kept AS (SELECT r, i, k FROM six SEMI JOIN again USING (r, k)),
m AS (SELECT x.r, x.i, y.i - x.i AS p FROM kept x JOIN kept y ON x.r = y.r AND x.k = y.k AND x.i < y.i),
o AS (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM m),
s AS (SELECT r, p, min(i) AS start, max(i) - min(i) + 6 + p AS length FROM o GROUP BY r, p, island),
runs AS (SELECT r, start, length, min(p) AS period FROM s WHERE length >= 12 AND length >= 2 * p GROUP BY r, start, length),
per AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
               first(start ORDER BY length DESC, start, period) AS start, first(length ORDER BY length DESC, start, period) AS length,
               first(period ORDER BY length DESC, start, period) AS period FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
words AS (SELECT r, unnest(range(n)) AS i, unnest(w) AS word FROM t),
left_over AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM t LEFT JOIN per USING (r) LEFT JOIN left_over USING (r)
"""
