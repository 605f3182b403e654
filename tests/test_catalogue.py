"""Every registered query of the library itself against its SQL, over whole tables."""

import duckdb
import pytest

from geoquern import catalogue, catalogue_operators, catalogue_scalars

QUERIES = catalogue.queries() | catalogue_scalars.QUERIES | catalogue_operators.QUERIES
SQL = catalogue.oracle_sql() | catalogue_scalars.SQL | catalogue_operators.SQL
TABLES = "region nation customer supplier part orders lineitem events".split()


def clean(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, db):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    r = db.execute(SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(clean(dict(zip(names, x, strict=True))[c]) for c in sorted(names)) for x in r.fetchall()), key=repr)
    got = sorted((tuple(clean(x[c]) for c in sorted(names)) for x in rows), key=repr)
    assert got == want


def test_entry(spark, data):
    assert catalogue.flagship(spark, data).count() > 0
