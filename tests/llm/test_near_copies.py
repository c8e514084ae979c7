"""The pipeline's near copies: similarity 0.80 and more; op2's: 0.85 and more."""

import corpus_pipeline
from loomspark.llm import neardup
from test_operators import shingle_set, words


def test_threshold_of_the_pipeline(spark):
    rows, alike = [], {}
    for k in range(12):
        base = words(200, 300 + k)
        other = list(base)
        for j in range(2 + k % 6):
            other[20 + 25 * j] = f"new{k}x{j}"
        a, b = shingle_set(" ".join(base)), shingle_set(" ".join(other))
        alike[2 * k + 1] = len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    assert any(0.80 <= x < 0.85 for x in alike.values()) and any(x < 0.80 for x in alike.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert left == {i for i, _ in rows if alike.get(i, 0) < 0.80}
    kept = {r.doc_id for r in neardup.near_duplicates(docs).filter("kept").collect()}
    assert kept == {i for i, _ in rows if alike.get(i, 0) < 0.85}
