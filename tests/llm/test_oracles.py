"""The queries of this subpackage that SQL can express, against their SQL."""

import glob
import os

import duckdb
import pytest

from tidegraph.llm.queries import ORACLES, QUERIES
from tidegraph.storage import scratch

SF = os.environ.get("TIDEGRAPH_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    made = con.execute(ORACLES[name])
    names = [d[0] for d in made.description]
    with scratch():
        got = QUERIES[name](spark, SF)
        assert sorted(got.columns) == sorted(names)
        rows = sorted(tuple(r[c] for c in names) for r in got.collect())
    want = sorted(made.fetchall())
    assert rows == want and want
