import duckdb
import pytest

import __spark_entry__ as E
from citegraph.plans.standins import TABLES
from conftest import SF001

#: every oracle but those of the training-data operators, which have tests of their own
ORACLES = sorted(n for n in E.oracle_sql() if n not in getattr(E.llm, "ORACLE", {}))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["year", "node1", "node2", "weight", "cii"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 160


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ORACLES)
def test_matches_oracle(spark, con, name):
    import sys, os

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
    from oracle_check import digest

    df = E.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    orows = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]
