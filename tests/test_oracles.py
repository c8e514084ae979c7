"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from loomspark import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[str]:
    cell = lambda v: "" if v is None or v is pd.NA or v != v else v.isoformat() if hasattr(v, "isoformat") else v
    return sorted(str(tuple(map(cell, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, duck):
    got = plans.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
