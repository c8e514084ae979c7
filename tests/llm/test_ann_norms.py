"""Nearest neighbours of vectors whose norms differ."""

import numpy as np
import pytest
from loomspark.llm import ann


@pytest.mark.parametrize("kind", ["unit", "outlier", "lognormal", "two_sizes"])
def test_recall_whatever_the_norms(spark, kind):
    r = np.random.default_rng(2)
    v = r.normal(size=(3000, 64))
    v /= np.sqrt((v**2).sum(1))[:, None]
    if kind == "outlier":
        v[7] *= 100
    elif kind == "lognormal":
        v *= r.lognormal(0, 1, 3000)[:, None]
    elif kind == "two_sizes":
        v[::2] *= 5
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = {}
    for x in ann.search(df, df.filter("vec_id % 100 = 0"), block=1500).collect():
        found.setdefault(x.query_id, []).append(x.vec_id)
    assert len(found) == 30 and all(len(set(x)) == 20 for x in found.values())
    hits = 0
    for q, ids in found.items():
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(ids) & set(np.argsort(-s)[:20].tolist()))
    assert hits / 600 >= 0.9


@pytest.mark.parametrize("n", [1, 2, 5, 12, 21, 40, 500, 2000, 9000])
def test_tables_of_any_size(spark, n):
    """All candidates where there are fewer than 20; recall over one block and over two."""
    r = np.random.default_rng(n)
    v = r.normal(size=(n, 64))
    v /= np.sqrt((v**2).sum(1))[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    step = max(1, n // 40)
    found = {}
    for x in ann.search(df, df.filter(f"vec_id % {step} = 0")).collect():
        found.setdefault(x.query_id, []).append((x.rank, x.vec_id))
    k = min(20, n - 1)
    assert len(found) == (len(range(0, n, step)) if k else 0) and all(len(x) == k for x in found.values())
    hits = 0
    for q, ids in found.items():
        s = v @ v[q]
        s[q] = -np.inf
        hits += len({i for _, i in ids} & set(np.argsort(-s)[:k].tolist()))
    assert hits >= 0.95 * k * len(found)


def test_ties_and_repeated_rows(spark):
    """Equal scores by vec_id; equal rows count once."""
    rows = [(i, [1.0, 0.0]) for i in range(30)] * 2 + [(100, [2.0, 0.0]), (101, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as block", "2 as score", "3 as query_id")
    got = ann.search(df, df.filter("vec_id = 5")).orderBy("rank").collect()
    assert [x.vec_id for x in got] == [100, *[i for i in range(20) if i != 5]]
