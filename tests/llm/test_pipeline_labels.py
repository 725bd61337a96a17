"""The quality stage when the labels allow no model."""

import pytest

import corpus_pipeline


@pytest.mark.parametrize("labels", [[], [(i, 1) for i in range(12)], [(None, 0), (0, 1), (1, None)]])
def test_without_a_model_the_quality_stage_keeps_all(spark, docs, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
