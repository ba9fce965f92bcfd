"""The corpus pipeline, each stage against its operator's promise, and the whole."""

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as p  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        kept[name] = out.cache()
        docs = out
    assert kept["near_duplicates"].count() == kept["near_duplicates"].select("doc_id").distinct().count()
    assert kept["near_duplicates"].select("text").distinct().count() == kept["near_duplicates"].count()
    assert kept["personal_data"].where(F.col("text").rlike("555-[0-9]{4}")).count() <= 1
    pieces = p.STAGES[-1][1](spark, docs, data)
    assert pieces.agg(F.count_distinct("doc_id")).first()[0] == docs.count()


def test_run(spark, data):
    out = p.run(spark, data)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0 and out.count() > 0
