import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert after.columns == docs.columns
        if name in ("toxicity", "minhash_near_dedup"):
            assert 0 < after.count() <= docs.count()
            assert after.join(docs, "doc_id", "left_anti").count() == 0
        if name == "minhash_near_dedup":
            assert after.groupBy("doc_id").count().filter("count > 1").count() == 0
        docs = after
    assert after.filter(F.col("n_tokens") < 0).count() == 0
