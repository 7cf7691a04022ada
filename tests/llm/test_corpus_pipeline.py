from __future__ import annotations

import corpus_pipeline as pipeline


def test_stages(spark, data, documents, tmp_path):
    docs, seen = documents, {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == documents.columns
        assert docs.join(before, "doc_id", "left_anti").isEmpty()
    kept = seen["minmax_near_dedup"]
    assert kept.select("doc_id").distinct().count() == kept.count()
    assert kept.groupBy("text").count().where("count > 1").isEmpty()
    assert seen["line_dedup"].where("length(text) <> n_chars").isEmpty()
    packed = seen["cost_balanced_packing"]
    assert packed.where("length <> size(ids)").isEmpty()


def test_odd_and_empty_inputs(spark, data, odd, empty, tmp_path):
    for k, docs in enumerate((odd, odd.drop("n_chars"), empty)):
        for name, stage in pipeline.STAGES:
            stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
