"""The reduction of chunks asks for each chunk's result once."""

from loomspark.operators import session as P


def test_each_result_is_made_once(spark):
    rows = [(f"s{s}", p, "user", "some words " * 12) for s in range(5) for p in range(9)]
    parts = P.chunks(spark.createDataFrame(rows, "session_id string, position long, kind string, content string"), 600)
    n, calls = parts.count(), spark.sparkContext.accumulator(0)

    def told(_):
        return {"summary_sentences": ["told"], "concepts": [f"c{i}" for i in range(10)]}

    def generator(text):
        calls.add(1)
        return told(text)

    assert P.reduce(P.generate(parts, generator), told, 400).count() == 5
    assert calls.value == n
