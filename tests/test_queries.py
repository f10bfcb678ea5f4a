import os

import pytest

duckdb = pytest.importorskip("duckdb")

from tidemark import plans  # noqa: E402

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")


def normal(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 4)
    text = str(value)
    return text.removesuffix(" 00:00:00")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{TABLES}/{f}')")
    return con


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query_equals_sql(spark, tables, name):
    df = plans.QUERIES[name](spark, TABLES)
    got = tables.execute(plans.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(normal, r)) for r in got.fetchall()), key=str)
    assert sorted((tuple(normal(r[c]) for c in names) for r in df.collect()), key=str) == want


def test_whole_table_is_published(spark, tables):
    """Not the first days of January alone."""
    assert plans.QUERIES["publish_initial"](spark, TABLES).count() == tables.execute("SELECT count(*) FROM events").fetchone()[0]


def test_entry(spark):
    assert plans.entry(spark, TABLES).count() == 7
