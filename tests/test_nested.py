"""Nested records: every shape a field can have."""

import datetime as dt
import json

from docloom.operators import nested

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "fixture_id bigint, file_name string, body string, received_at timestamp, c string, pages string"


def rows_of(spark, *bodies):
    df = spark.createDataFrame([(i, None, b, T0, "x", "y") for i, b in enumerate(bodies)], SCHEMA)
    return {tuple(r) for r in nested.fixture_rows(df).collect()}


def test_shapes(spark):
    page = {"page": 1, "expected_headings": {"text": "a"}, "expected_table_regions": [None, {"x0": 1}, {"x0": 2}]}
    got = rows_of(spark, json.dumps({"pages": [page, None, {}]}), json.dumps({"pages": page}), '﻿ {"pages": [{"page": 1}]} \n')
    assert got == {
        (0, 0, "page", -1), (0, 0, "heading", 0), (0, 0, "table_region", 1), (0, 0, "table_region", 2), (0, 2, "page", -1),
        (1, 0, "page", -1), (1, 0, "heading", 0), (1, 0, "table_region", 1), (1, 0, "table_region", 2), (2, 0, "page", -1),
    }


def test_nothing_to_give(spark):
    assert rows_of(spark, None, "", "{", '{"pages": [{"page": 1}', '{"pages": null}', '{"pages": []}', "[]", '{"pages": "no"}', '{"pages": [{"expected_headings": "no"}]}') == {(8, 0, "page", -1)}


def test_long_body_and_values(spark):
    heads = [{"text": f"h{i}", "level": "2" if i % 2 else 3} for i in range(5000)]
    df = spark.createDataFrame([(1, "f", json.dumps({"pdf": "p", "pages": [{"page": 7, "expected_headings": heads}]}), T0, None, None)] * 2, SCHEMA)
    out = nested.fixture_headings(df).collect()
    assert len(out) == 5000
    assert {(r.page, r.level) for r in out} == {(7, 2), (7, 3)}
    assert nested.fixture_pages(df).first().expected_tables == 0


def test_newest_body_stands(spark):
    later = T0 + dt.timedelta(days=1)
    df = spark.createDataFrame([(1, "f", '{"pages": [{}, {}]}', T0, "", ""), (1, "f", '{"pages": [{}]}', later, "", ""), (1, "f", '{"pages": [{}]}', later, "", "")], SCHEMA)
    assert [tuple(r) for r in nested.fixture_rows(df).collect()] == [(1, 0, "page", -1)]


def test_empty_table(spark):
    assert nested.fixture_rows(spark.createDataFrame([], SCHEMA)).count() == 0
