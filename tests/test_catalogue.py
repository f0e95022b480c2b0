"""Every query of the engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from grovelight.plans import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[k]) for k in cols) for r in df.collect()), key=repr)
    rel = c.sql(catalogue.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(k) for k in cols]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in rel.fetchall()), key=repr)
