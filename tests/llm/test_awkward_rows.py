"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables and
extra columns whose names clash with their own."""

import pytest
from loomspark.llm import bpe, licenses, linededup, mixing, neardup, quality, secrets, tokencount, toxicity
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import words

#: Names that operators use inside.
NAMES = ["mark", "class", "c", "whole", "keys", "low", "size", "runs", "block", "score", "x", "found", "hits", "digest", "lines", "parts", "sizes", "toxic", "sig", "label", "edits", "target", "taken", "seen", "t", "base", "free", "pos", "piece", "n", "copy", "n_tokens", "kept", "component_id"]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(words(150_000, 21))
    rows = [(0, "one two three four five six."), (0, "one two three four five six."), (0, "another text of the same id, which has other words"), (1, None), (2, ""), (3, " \t\n"), (None, "no id at all"), (None, None), (4, long), (5, long), (6, "x" * 300_000)]
    df = spark.createDataFrame([(i, t, "en", None if i == 3 else f"s{(i or 0) % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in NAMES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, 1), (4, 1, 1), (4, None, 0), (None, 1, 1), (77, 0, 0)], LABELS)


OPERATORS = {
    "toxicity": lambda spark, d, l: toxicity.score(d, l),
    "neardup": lambda spark, d, l: neardup.near_duplicates(d),
    "tokencount": lambda spark, d, l: tokencount.count_with_edits(d),
    "quality": lambda spark, d, l: quality.judge(d),
    "linededup": lambda spark, d, l: linededup.dedup_lines(d),
    "bpe": lambda spark, d, l: bpe.encode(d),
    "licenses": lambda spark, d, l: licenses.scan(d, licenses.known_digests(spark)),
    "secrets": lambda spark, d, l: secrets.scan(d, secrets.train(secrets.labelled_samples(spark, 100))),
    "mixing": lambda spark, d, l: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(name, spark, docs, labels):
    """One row for every row, whatever it holds, and none for none."""
    got = OPERATORS[name](spark, docs, labels).collect()
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in got) == sorted(i if i is not None else -1 for i in ids)
    assert OPERATORS[name](spark, docs.limit(0), labels.limit(0)).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    if name == "neardup":
        assert {r.component_id for r in by[4] + by[5]} == {4} and [r.kept for r in by[5]] == [False] and by[1][0].n_shingles == 0
    elif name == "tokencount":
        assert by[4][0].n_tokens == by[5][0].n_tokens > 150_000 and by[1][0].n_tokens == by[2][0].n_tokens == 0
    elif name == "linededup":
        assert by[1][0].text is None and by[2][0].text == "" and by[4][0].n_cut == 0 and len({r.text for r in by[0]}) == 2
    elif name == "bpe":
        assert by[1][0].n_tokens == by[2][0].n_tokens == 0 and by[4][0].ids_sha256 == by[5][0].ids_sha256
    elif name == "mixing":
        assert all(r.taken <= 3 * r.size for r in got) and {r.size for r in by[4] + by[5]} == {150_000}
    elif name == "toxicity":
        assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(name, stage, spark, docs, labels, tmp_path):
    """The columns of documents come back, clashing ones included; rows that share a doc_id and
    differ in text are different documents."""
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    if name != "bpe_encode":
        assert out.columns == docs.columns and all(r.mark == "clash" and r.kept == "clash" for r in rows)
    texts = [(r.doc_id, r.text) for r in rows] if name != "bpe_encode" else []
    if name == "minhash_near_dedup":
        assert sum(r[0] == 0 for r in texts) == 2 and sum(r[0] == 4 for r in texts) == 1 and not any(r[0] == 5 for r in texts)
        assert sum(r[0] is None for r in texts) == 2
    elif name == "line_dedup":
        assert sum(r[0] == 0 for r in texts) == 3
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.count() == 0
