"""The pipeline against a brute-force run of its decisions."""

from pyspark.sql import functions as F

import corpus_pipeline
from sextant.llm import langid, simhash, toxicity
from tests.llm.test_operators import brute_components, brute_decontaminate, brute_fingerprint


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).filter("predicted = 1").collect()}
    left = [i for i in sorted(rows) if i not in toxic]
    left = [i for i in left if langid.has_letter(rows[i].text)]
    roots = brute_components([brute_fingerprint(rows[i].text) for i in left])
    left = [left[k] for k, r in enumerate(roots) if r == k]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = brute_decontaminate([(i, rows[i].text) for i in left], items)
    want = {i for i in left if hits[i][2] < 2}

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialise(stage(spark, now, sf))
        assert now.columns == docs.columns, name
    assert {r.doc_id for r in now.collect()} == want
    again = brute_decontaminate([(r.doc_id, r.text) for r in now.collect()], items)
    assert not any(h[1] for h in again.values())
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == want
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_copies", "decontamination", "packing"]
    assert simhash.fingerprint(None) == 0
