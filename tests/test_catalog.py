"""Every registered query with SQL gives the SQL's rows."""

import duckdb
import pytest

from docloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in [*catalog.KEYS, "embeddings", "pages", "benchmark", "labels"]:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = db.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
