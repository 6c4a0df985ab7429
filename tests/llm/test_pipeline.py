import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from quire.llm.common import materialise

from llm_data import brute_components


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = materialise(stage(spark, docs, tiny), "test-stage")
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.count() > 0
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "near_dedup":
            groups = brute_components(list(before.items()), 80)
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in groups.items() if i == c}
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
            assert not any(x in r.text for r in out.collect() for x in items)
        if name == "source_mix":
            total = sum(len(t.split()) for t in before.values())
            assert abs(sum(len(r.text.split()) for r in out.collect()) / total - 1.5) < 0.1
        docs = out
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_on_odd_rows(spark, odd, none, tiny):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", F.col("key"))
    for _, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, tiny), "test-stage")
    empty = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES:
        empty = materialise(stage(spark, empty, tiny), "test-stage")
    assert empty.count() == 0
