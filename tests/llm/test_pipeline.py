import brute
import corpus_pipeline as cp
from paths import SF_SMALL
from test_packing import check

from gatelens.llm import quality
from gatelens.sources.tables import table


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages_match_brute_force_on_their_own_inputs(spark, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = given = table(spark, SF_SMALL, "documents")
    out = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / name))
        out[name] = docs, spark.read.parquet(str(tmp_path / name))
        docs = out[name][1]
        assert name == "packing" or docs.columns == given.columns

    before, after = out["quality_rules"]
    kept = {r["doc_id"] for r in quality.quality(before, quality.fit_on_labels(before, table(spark, SF_SMALL, "labels"))).where("kept").collect()}
    assert rows(after) == [(i, t) for i, t in rows(before) if i in kept]
    assert all(not brute.quality_counts(t)[-1] for _, t in rows(after))
    bad = {r["doc_id"] for r in table(spark, SF_SMALL, "labels").where("quality = 0").collect()}
    good = {r["doc_id"] for r in table(spark, SF_SMALL, "labels").where("quality = 1").collect()}
    failing = {i for i, t in rows(before) if brute.quality_counts(t)[-1]}
    assert not kept & bad and good - failing <= kept

    before, after = out["line_dedup"]
    assert rows(after) == sorted((i, t) for i, t, _, _ in brute.line_dedup(rows(before)))
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())

    before, after = out["near_dedup"]
    groups = brute.near_duplicates(rows(before), 5)
    assert rows(after) == [(i, t) for i, t in rows(before) if groups[i][1] == i]

    before, after = out["decontamination"]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF_SMALL, "benchmark").collect()]
    hit = {d for d, _ in brute.passages([x for x in rows(before) if len(x[1]) < 8000], items)}
    gone = {i for i, _ in rows(before)} - {i for i, _ in rows(after)}
    assert hit <= gone and all(len(t) >= 8000 for i, t in rows(before) if i in gone - hit)

    before, after = out["packing"]
    check(rows(before), after.collect())
    assert cp.run(spark, SF_SMALL).count() == after.count()
