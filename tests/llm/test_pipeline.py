"""The pipeline's stages, each on its own input."""

import corpus_pipeline as cp


def test_stages(spark, frame, texts, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    own = [*texts, "leak " + item, "mail bob.x@example.com please and answer soon", "12345 !!", texts[4]]
    docs = frame(own)
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        kept[name] = {r["doc_id"]: r["text"] for r in rows}
        docs = spark.createDataFrame(rows, docs.schema)
    n = len(texts)
    assert n + 2 not in kept["language identification"] and n in kept["language identification"]
    near = kept["simhash near duplicates"]
    assert n + 3 not in near and 4 in near and n in near
    assert n not in kept["benchmark decontamination"] and n + 1 in kept["benchmark decontamination"]
    assert "bob.x@" not in kept["personal data"][n + 1] and "[EMAIL]" in kept["personal data"][n + 1]
    last = cp.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in last.collect()} == set(kept["personal data"])


def test_empty_table(spark, frame, sf):
    docs = frame([])
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf).count() == 0
