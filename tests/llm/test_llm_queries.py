"""The queries of this subpackage on the smallest tables, against their SQL or a library."""

import glob
import os

import duckdb
import pytest

from oracle import canon
from talkgraph.llm import queries as Q

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    df = Q.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    ours = sorted(str(tuple(canon(r[c]) for c in cols)) for r in df.collect())
    if name.endswith("_found"):
        assert len(ours) == len(set(ours))
    if name in Q.SQL:
        res = con.execute(Q.SQL[name])
        names = [x[0] for x in res.description]
        assert ours == sorted(str(tuple(canon(r[names.index(c)]) for c in cols)) for r in res.fetchall())


COLUMNS = {
    "p1_found": [("source_table", "string"), ("row_key", "string"), ("noise", "string")],
    "p2_found": [("keep_id", "bigint"), ("triple_id", "bigint")],
    "p3_found": [("utterance_id", "string"), ("slide_id", "string")],
    "p4_found": [("result_id", "bigint"), ("answer_field", "string"), ("defect", "string")],
    "p6_found": [("sample_id", "string"), ("triple_id", "bigint")],
    "p7_found": [("source", "string"), ("key_a", "string"), ("key_b", "string")],
    "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p10_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert Q.QUERIES[name](spark, D).dtypes == COLUMNS[name]
