"""Each stage on its own input."""

import corpus_pipeline as p
from lodeseek.llm import decontaminate, minhash

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = [n for n, _ in p.STAGES]
    assert names == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    at = {"documents": docs}
    for name, stage in p.STAGES:
        last = list(at.values())[-1]
        at[name] = stage(spark, last, SF).cache()
        if name != names[-1]:
            assert at[name].columns == docs.columns and at[name].schema == docs.schema
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in at.items()}
    kept = ids["quality_classifier"]
    assert sum((d in kept) == bool(q) for d, q in labels.items()) >= 0.95 * len(labels)
    assert all(r["n_chars"] == len(r["text"]) for r in at["line_dedup"].collect())
    near = minhash.near_duplicates(at["line_dedup"]).collect()
    assert ids["minhash_near_dedup"] == {r["doc_id"] for r in near if r["kept"]}
    bad = {r["doc_id"] for r in decontaminate.contamination(at["minhash_near_dedup"], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert bad and ids["benchmark_decontamination"] == ids["minhash_near_dedup"] - bad
    assert ids["best_fit_packing"] == ids["benchmark_decontamination"]
    for df in at.values():
        df.unpersist()


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "some words in a text", "en", "s", 20), (3, "some words in a text", "en", "s", 20), (None, "some words in a text", "en", "s", 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES[1:]:
        assert stage(spark, docs, SF).count() >= 1
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = sorted(((r["doc_id"], r["text"]) for r in p.drop_near_copies(spark, docs, SF).collect()), key=str)
    assert kept == [(1, None), (2, ""), (3, "some words in a text"), (None, "some words in a text")]
