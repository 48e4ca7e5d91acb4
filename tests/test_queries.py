"""Every query of the engine with a SQL twin against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from fringework.plans import registry

SF = os.environ.get("FRINGEWORK_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def values(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: v if v is None or isinstance(v, str | bool) else repr(float(v))
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    twin = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in twin.description]
    assert sorted(names) == sorted(got.columns)
    assert values([tuple(r) for r in got.collect()], got.columns) == values(twin.fetchall(), names)


def test_every_query_is_registered_once():
    seen = [n for m in registry.MODULES for n in __import__(f"fringework.plans.{m}", fromlist=["QUERIES"]).QUERIES]
    assert len(seen) == len(set(seen)) and set(registry.oracle_sql()) <= set(seen)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert set(df.columns) == {"pair", "yi", "xi", "re", "im", "coherence"} and df.count() > 0
