"""The corpus pipeline, stage by stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from panelloom.llm import pii


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
    return out


def test_stages_keep_columns_and_shrink(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert after.columns == before.columns and after.count() <= before.count()
    assert stages[4].count() == stages[3].count()


def test_stages_decide(stages):
    assert stages[2].groupBy("text").count().where("count > 1").count() == 0
    assert sum(len(pii.base_spans(r["text"])) for r in stages[4].select("text").collect() if r["text"]) == 0
    packed = stages[5]
    assert packed.select("doc_id").distinct().count() == stages[4].select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_on_awkward_rows(spark, sf_dir):
    rows = [(None, None, None, None, None, 1), (1, "", None, None, 0, 1), (1, "", None, None, 0, 1), (2, "Some text here. And more +1 (269) 555-3296.", "en", "s", 40, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _salt int")
    for _, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            stage(spark, given, sf_dir).count()
