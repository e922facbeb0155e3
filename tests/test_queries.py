"""Every registered graph query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pytest

from graphloom import more_queries  # noqa: F401
from graphloom.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def normal(df):
    df = df[sorted(df.columns)].copy()
    for x in df.columns:
        if str(df[x].dtype).startswith("float"):
            df[x] = df[x].round(6)
        elif df[x].dtype == object or str(df[x].dtype) == "str":
            df[x] = df[x].map(lambda v: None if v is None or isinstance(v, float) and np.isnan(v) else str(v))
    return sorted(map(tuple, df.astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
