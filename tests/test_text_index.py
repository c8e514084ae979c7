"""The kept index against full scans after any order of versions, and the search cases of the reference's own tests."""

import random
import re

import pytest

from loomspark.operators import memory as M
from loomspark.operators import search as S
from loomspark.operators.text_index import TextIndex

SCHEMA = "id string, version long, title string, content string, concepts array<string>"


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _scan(spark, rows, query):
    return [(r.rank, r.id, r.version, round(r.score, 9)) for r in S.bm25(_frame(spark, rows), query, 10, english=True).collect()]


def _indexed(index, spark, query):
    got = index.bm25(spark.createDataFrame([(7, query)], "query_id int, query string"), 10).collect()
    return sorted((r.rank, r.id, r.version, round(r.score, 9)) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_index_equals_scan_after_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    said = ["running rains", "the licenses of heating", "rain rain", "", "heated run", "of the", "licensed runner"]
    rows = [(f"m{i}", v, rng.choice(said), rng.choice(said), [rng.choice(said)]) for i in range(12) for v in range(1, rng.randint(2, 4))]
    rng.shuffle(rows)
    index, done = TextIndex(str(tmp_path / "index"), 4), []
    for batch, at in enumerate(range(0, len(rows), 9), 1):
        new = rows[at : at + 9]
        index.add(_frame(spark, done), _frame(spark, new + new[:1]), batch)
        done += new
    query = "rains, licensing and running"
    assert _indexed(index, spark, query) == _scan(spark, done, query)
    heads = M.heads(_frame(spark, done)).count()
    assert index.corpus(spark).groupBy().sum("n").first()[0] == heads
    if seed == 1:
        small = index.compact(spark, str(tmp_path / "compact"))
        assert _indexed(small, spark, query) == _scan(spark, done, query)
        assert small.postings(spark).filter("sign < 0").count() == 0


def test_batch_counts_once_its_numbers_are_written(spark, tmp_path):
    index = TextIndex(str(tmp_path / "index"), 4)
    rows = [("a", 1, "rain", "", []), ("b", 1, "rain", "", [])]
    index.add(_frame(spark, []), _frame(spark, rows), 1)
    # a batch that failed between its postings and its numbers
    spark.sql("select 'rain' term, 'c' id, 1L version, 1L tf, 1L dl, 1 sign, 9L batch, 0 bucket").write.mode("append").partitionBy("bucket").parquet(f"{index.path}/postings")
    assert [r[1] for r in _indexed(index, spark, "raining")] == ["a", "b"]


def test_query_reads_its_terms_only(spark, tmp_path):
    index = TextIndex(str(tmp_path / "index"), 16)
    index.add(_frame(spark, []), _frame(spark, [("a", 1, "one two three four five six seven eight", "", [])]), 1)
    plan = index.bm25(spark.createDataFrame([(1, "seven")], "query_id int, query string"), 5)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "FileScan" in x and "term#" in x)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = ", scan) and "EqualTo(term,seven)" in scan


def test_search_cases(spark):
    """Matches in title, content and concepts; heads only; positive scores; ties by id in code point order."""
    rows = [("t", 1, "titlelexeme", "ordinary body", []), ("c", 1, "ordinary title", "contentlexeme", []), ("k", 1, "ordinary title", "ordinary body", ["conceptlexeme"])]
    for query, want in (("titlelexeme", "t"), ("contentlexeme", "c"), ("conceptlexeme", "k"), ("titlelexemes", "t")):
        assert [r[1] for r in _scan(spark, rows, query)] == [want]
    assert _scan(spark, rows, "absentlexeme") == [] and _scan(spark, rows, "the of and") == []
    rows += [("target", 1, "corpusglyph", "fixed content", ["f"]), ("obsolete", 1, "corpusglyph", "fixed content", ["f"])]
    before = _scan(spark, rows, "corpusglyph")
    assert len(before) == 2 and all(r[3] > 0 for r in before)
    after = _scan(spark, [*rows, ("obsolete", 2, "unrelatedxx", "fixed content", ["f"])], "corpusglyph")
    assert [r[1] for r in after] == ["target"] and after[0][3] > before[0][3]
    tied = [(f"tie-{x}", 1, "tiequasar", "same", []) for x in ("a", "z", "A")]
    got = _scan(spark, rows + tied, "tiequasar")
    assert [r[1] for r in got] == ["tie-A", "tie-a", "tie-z"] and len({r[3] for r in got}) == 1
