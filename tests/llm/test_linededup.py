import brute
from paths import SF_SMALL

from gatelens.llm import linededup
from gatelens.sources.tables import table


def compare(rows, df):
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect())
    assert got == sorted(rows)


def test_whole_small_table_matches_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    compare(brute.line_dedup(rows), linededup.line_dedup(docs))
    compare(brute.line_dedup(rows, 3, 8), linededup.line_dedup(docs, min_docs=3, min_chars=8, batches=5))


def test_odd_rows(spark):
    rows = [(i, f"Same LINE \x0b\n\n own {i}\nsame line") for i in range(12)] + [(100, None), (101, ""), (102, "\n\n"), (103, "é\n" * 5)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, n_dropped string")
    compare(brute.line_dedup(rows), linededup.line_dedup(docs))
    out = linededup.without_frequent_lines(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: (None if i == 100 else t) for i, t, _, _ in brute.line_dedup(rows)}


def test_null_id_keeps_its_lines_and_repeated_rows_count(spark):
    docs = spark.createDataFrame([(None, "a")] + [(5, "a")] * 9, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["n_dropped"]) for r in linededup.line_dedup(docs).collect())
    assert got == [(False, 1)] * 9 + [(True, 0)]
    assert linededup.line_dedup(docs.limit(0)).count() == 0


def test_runs_are_levelled_sorted_and_complete(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for n in range(5):
        runs.add(spark.createDataFrame([(f"x\ny{n}",), ("x",)], "text string"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(r["n_docs"] for r in runs.lines().collect()) == [1] * 5 + [10]
    path = runs.levels[2][0]
    part = [(r["h1"], r["h2"]) for r in spark.read.parquet(path).coalesce(1).collect()]
    assert part and sorted(part) == sorted(set(part))
