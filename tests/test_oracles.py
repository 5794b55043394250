"""Every registered query of the library proper against its SQL, on the small tables."""

import math

import duckdb
import pytest

from tickloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(frame):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(r[c]) for c in sorted(frame.columns)) for r in frame.to_dict("records"))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = db.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_without_sql_gives_rows_and_the_same_ones_again(spark, name):
    first = norm(registry.queries()[name](spark, SF).toPandas())
    assert first and norm(registry.queries()[name](spark.newSession(), SF).repartition(3).toPandas()) == first


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert entry.queries().keys() >= registry.queries().keys()
