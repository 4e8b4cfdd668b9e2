"""Nested JSON records to flat tables that keep parent-child links (problem 3).

One pass over the parsed body: nested ``transform`` calls attach the ancestor's keys and
array positions to each element, ``flatten`` joins the inner arrays, and one ``inline`` per
target table emits its rows. Everything stays in the JVM; bodies are parsed to VARIANT, so
missing, re-ordered, unknown or differently typed fields do not break a record.

Defined results: a body that is null, empty or not complete JSON gives no rows; white space
and a byte-order mark around it are ignored; a null element keeps its position and gives no
row; an object in place of an array is an array of one; a scalar in place of an array gives
no rows; a field of another type is read as null unless it casts; a record delivered twice
counts once (newest ``received_at``); a null id is an id of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import latest

#: White space and byte-order marks that may stand around a body.
_AROUND = r"^[\\s\\x{FEFF}]+|[\\s\\x{FEFF}]+$"


def _array(variant: str, path: str) -> str:
    """SQL for the array at ``path``: arrays as they are, an object as an array of one, else null."""
    got = f"try_variant_get({variant}, '{path}', 'variant')"
    kind = f"schema_of_variant({got})"
    return (
        f"case when {kind} like 'ARRAY%' then try_variant_get({variant}, '{path}', 'array<variant>') "
        f"when {kind} like 'OBJECT%' then array({got}) end"
    )


def parse_bodies(files: DataFrame) -> DataFrame:
    """(fixture_id, file_name, v): the newest body of each record as VARIANT; incomplete JSON is null."""
    one = latest(files, ["fixture_id"], "received_at", "file_name", "body")
    return one.select("fixture_id", "file_name", F.expr(f"try_parse_json(regexp_replace(body, '{_AROUND}', ''))").alias("v"))


def nested_arrays(files: DataFrame) -> DataFrame:
    """Per record: arrays of page, heading and table-region structs carrying their ancestors' keys."""
    child = lambda field, fields: (
        "flatten(transform(pages, (p, i) -> coalesce(transform("
        + _array("p", f"$.{field}")
        + f", (c, j) -> struct(fixture_id, i as page_idx, j as child_idx, p as parent, c as c{fields})), array())))"
    )
    pages = parse_bodies(files).selectExpr("fixture_id", "file_name", "try_variant_get(v, '$.pdf', 'string') as pdf", f"{_array('v', '$.pages')} as pages")
    return pages.selectExpr(
        "fixture_id",
        "file_name",
        "pdf",
        "transform(pages, (p, i) -> struct(fixture_id, i as page_idx, p as c)) as page_rows",
        child("expected_headings", "") + " as heading_rows",
        child("expected_table_regions", "") + " as region_rows",
    )


def _inline(arrays: DataFrame, column: str) -> DataFrame:
    """Rows of one array of structs; null elements give none."""
    return arrays.selectExpr(f"inline({column})").where("c is not null and not is_variant_null(c)")


#: Counts that are 0 where a page leaves them out.
_COUNTS = (
    "expected_formula_count", "formula_false_positive_budget", "expected_tables",
    "expected_decorative_images", "expected_meaningful_figures", "expected_figure_captions", "expected_vector_only_regions",
)


def fixture_pages(files: DataFrame) -> DataFrame:
    """(fixture_id, page_idx, page, counts..., flags): one row for each page element."""
    return _inline(nested_arrays(files), "page_rows").selectExpr(
        "fixture_id",
        "page_idx",
        "try_variant_get(c, '$.page', 'bigint') as page",
        *[f"coalesce(try_variant_get(c, '$.{f}', 'bigint'), 0) as {f}" for f in _COUNTS],
        "try_variant_get(c, '$.expected_formula_detection_count', 'bigint') as expected_formula_detection_count",
        "coalesce(try_variant_get(c, '$.skip_text_metrics', 'boolean'), false) as skip_text_metrics",
        "coalesce(try_variant_get(c, '$.skip_table_metrics', 'boolean'), false) as skip_table_metrics",
    )


def fixture_headings(files: DataFrame) -> DataFrame:
    """(fixture_id, page_idx, heading_idx, page, text, level); parent link (fixture_id, page_idx)."""
    return _inline(nested_arrays(files), "heading_rows").selectExpr(
        "fixture_id", "page_idx", "child_idx as heading_idx", "try_variant_get(parent, '$.page', 'bigint') as page",
        "try_variant_get(c, '$.text', 'string') as text", "try_variant_get(c, '$.level', 'int') as level",
    )


def fixture_table_regions(files: DataFrame) -> DataFrame:
    """(fixture_id, page_idx, region_idx, page, x0, y0, x1, y1); parent link (fixture_id, page_idx)."""
    return _inline(nested_arrays(files), "region_rows").selectExpr(
        "fixture_id", "page_idx", "child_idx as region_idx", "try_variant_get(parent, '$.page', 'bigint') as page",
        *[f"try_variant_get(c, '$.{k}', 'double') as {k}" for k in ("x0", "y0", "x1", "y1")],
    )


def fixture_rows(files: DataFrame) -> DataFrame:
    """(fixture_id, page_idx, child, child_idx): every row of the three tables, from one parse of each body."""
    arrays = nested_arrays(files).selectExpr(
        "concat(coalesce(transform(page_rows, r -> struct(r.fixture_id, r.page_idx, 'page' as child, -1 as child_idx, r.c)), array()),"
        " coalesce(transform(heading_rows, r -> struct(r.fixture_id, r.page_idx, 'heading' as child, r.child_idx, r.c)), array()),"
        " coalesce(transform(region_rows, r -> struct(r.fixture_id, r.page_idx, 'table_region' as child, r.child_idx, r.c)), array())) as rows"
    )
    return _inline(arrays, "rows").selectExpr("fixture_id", "cast(page_idx as bigint) as page_idx", "child", "cast(child_idx as bigint) as child_idx")
