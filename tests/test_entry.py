import duckdb
import pytest
from paths import DATA, TABLES

import __spark_entry__ as entry

NAMES = sorted(n for n in entry.registry.ORACLES)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_against_duckdb(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    want = db.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    tell = lambda x: "%.8g" % x if isinstance(x, float) else str(x)
    rows = lambda names, data: sorted(tuple(tell(r[names.index(c)]) for c in columns) for r in data)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
