import duckdb
import pytest

from helixframe.plans.more import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(cols).collect())))
    assert rows
    if name in ORACLE:
        quoted = ", ".join(f'"{c}"' for c in cols)
        want = con.sql(f"SELECT {quoted} FROM ({ORACLE[name]})").fetchall()
        assert rows == sorted(map(repr, want))
