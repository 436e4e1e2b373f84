"""Each stage of the pipeline does its work on what the stage before it kept."""

import brute

import corpus_pipeline
from palisade.llm import decontamination, mixing, toxicity


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in kept.select("doc_id", "text").collect()}
        made = stage(spark, kept, data).cache()
        after = [r["doc_id"] for r in made.select("doc_id").collect()]
        if name != "source mixing":
            assert made.columns == docs.columns and len(after) == len(set(after))
        if name == "toxicity":
            model = toxicity.fit_toxicity(kept, spark.read.parquet(f"{data}/labels.parquet"))
            bad = {r["doc_id"] for r in toxicity.score_toxicity(kept, model).where("predicted = 1").collect()}
            assert set(after) == before.keys() - bad
        elif name == "exact dedup":
            assert set(after) == {d for d, x in brute.exact(before.items()).items() if x[2]}
        elif name == "n-gram Jaccard join":
            assert set(after) == {d for d, x in brute.similar(before.items()).items() if x[1] == d}
        elif name == "benchmark decontamination":
            items = {r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
            assert not any(t in (before[d] or "") for d in after for t in items)
            leaks = decontamination.find_leaks(kept, spark.read.parquet(f"{data}/benchmark.parquet"))
            assert set(after) == before.keys() - {r["doc_id"] for r in leaks.collect()}
        else:
            assert set(after) <= before.keys() and made.columns[: len(docs.columns)] == docs.columns
            assert made.count() == mixing.mix_sources(kept).count()
        kept = made
        assert k < 5
    assert corpus_pipeline.run(spark, data).count() == kept.count() and corpus_pipeline.ORACLE_SQL is None
