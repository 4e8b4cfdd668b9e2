"""Every core query against its SQL on the smallest tables, and rows where there is no SQL."""

import glob
import math
from collections import Counter

import duckdb
import pytest

from docloom.plans import catalog

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
#: Queries that find nothing in these tables; their operators have tests on small rows.
EMPTY = {"scholarly_notes", "reference_lines", "region_iou_pairs", "gfm_tables", "repeated_edge_text", "repeated_text_blocks", "region_matches", "unsafe_sources", "captioned_media", "code_lines", "row_runs", "backend_rejection", "implicit_tables", "grid_cells", "scholarly_pages", "density_warnings", "repeated_media", "reference_pages"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {f.split('/')[-1][:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    assert rows or name in EMPTY
    if name in SQL:
        cur = duck.execute(SQL[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        want = [tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
        assert Counter(map(repr, rows)) == Counter(map(repr, want))
