"""The corpus pipeline on planted cases."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """sf0.001 with planted rows: a copy, a near copy, a benchmark passage, and extra columns."""
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{_SF}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{_SF}/{name}.parquet").write.parquet(str(folder / f"{name}.parquet"))
    rows = docs.orderBy(F.desc("n_chars")).limit(3).collect()
    item = spark.read.parquet(f"{_SF}/benchmark.parquet").first()["text"]
    planted = [(9001, rows[0]["text"], "en", "src0", 1), (9002, rows[1]["text"] + " end", "en", "src1", 1), (9003, "some words. " + item, "en", "src1", 1), (9004, None, None, None, None), (9005, "", "", "", 0)]
    extra = [F.lit(7).alias("shard"), F.lit("x").alias("score")]
    both = docs.union(spark.createDataFrame(planted, docs.schema)).select("*", *extra)
    both.repartition(3).write.parquet(str(folder / "documents.parquet"))
    return str(folder), {r["doc_id"] for r in rows}


def test_stages_keep_columns_and_take_effect(spark, table):
    folder, _ = table
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, folder), "test-stage")
        if name != "sharding":
            assert docs.columns == before.columns
        if name == "MinHash near-dedup":
            ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert not ids & {9001, 9002}
        if name == "benchmark decontamination":
            assert docs.where("doc_id = 9003").count() == 0
        assert docs.count() <= before.count()
    assert docs.select("doc_id").distinct().count() == docs.count()
    counts = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1


def test_empty_table(spark, table):
    folder, _ = table
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
