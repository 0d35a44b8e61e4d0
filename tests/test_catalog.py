"""Every query of the catalogue: against DuckDB where it has SQL, else that it runs."""

import math

import pytest

from millrace.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark".split()


@pytest.fixture(scope="module")
def duck(tiny):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, tiny, name):
    df = QUERIES[name](spark, tiny)
    got = df.collect()
    if name not in ORACLE_SQL:
        assert got
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert ordered(df.select(*names).collect() if names != df.columns else got) == ordered(found.fetchall())


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
