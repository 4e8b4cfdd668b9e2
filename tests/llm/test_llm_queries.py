"""The text queries on the smallest tables, against SQL where there is some."""

import glob
from collections import Counter

import duckdb
import pytest

from docloom.llm import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, DATA)
    rows = df.collect()
    assert rows or name in ("p4_found", "p4_lines")  # too few files here for a repeated line
    if name in catalog.oracle_sql():
        con = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"create view {f.split('/')[-1][:-8]} as select * from '{f}'")
        cur = con.execute(catalog.oracle_sql()[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert Counter(tuple(r[c] for c in names) for r in rows) == Counter(map(tuple, cur.fetchall()))
    if name.endswith("_found"):
        assert len(set(map(tuple, rows))) == len(rows)
