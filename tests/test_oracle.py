"""Every registered query outside llm runs on the smallest tables, and gives what its SQL gives."""

import glob
import os

import duckdb
import pytest

from oracle import canon
from talkgraph.plans import evidence, general, graph, learning, retrieval, scoring, smaller, speech, timeline, whole

D = "/root/testdata/sf0.001"
MODULES = [general, graph, timeline, speech, evidence, retrieval, learning, scoring, smaller, whole]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    ours = sorted(str(tuple(canon(r[c]) for c in cols)) for r in df.collect())
    if name in SQL:
        res = con.execute(SQL[name])
        names = [x[0] for x in res.description]
        assert sorted(names) == cols
        assert ours == sorted(str(tuple(canon(r[names.index(c)]) for c in cols)) for r in res.fetchall())


def test_entry_lists_them():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
