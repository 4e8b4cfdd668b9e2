"""Queries over the nested fixture records (problem 3)."""

from __future__ import annotations

from docloom.operators import nested
from docloom.session import table

_SQL_BASE = r"""
with raw as (select fixture_id, max_by(body, received_at) as body from fixture_files group by fixture_id),
ok as (select fixture_id, regexp_replace(body, '^[\s\x{FEFF}]+|[\s\x{FEFF}]+$', '', 'g') as b from raw),
js as (select fixture_id, cast(b as json) as b from ok where json_valid(b)),
pl as (select fixture_id, case json_type(b, '$.pages') when 'ARRAY' then json_extract(b, '$.pages[*]')
       when 'OBJECT' then [json_extract(b, '$.pages')] else [] end as ps from js),
p0 as (select fixture_id, unnest(ps) as p, generate_subscripts(ps, 1) - 1 as page_idx from pl),
p as (select * from p0 where json_type(p) <> 'NULL'),
hl as (select fixture_id, page_idx, p, case json_type(p, '$.expected_headings') when 'ARRAY' then json_extract(p, '$.expected_headings[*]')
       when 'OBJECT' then [json_extract(p, '$.expected_headings')] else [] end as cs from p),
h0 as (select fixture_id, page_idx, p, unnest(cs) as c, generate_subscripts(cs, 1) - 1 as child_idx from hl),
h as (select * from h0 where json_type(c) <> 'NULL'),
tl as (select fixture_id, page_idx, p, case json_type(p, '$.expected_table_regions') when 'ARRAY' then json_extract(p, '$.expected_table_regions[*]')
       when 'OBJECT' then [json_extract(p, '$.expected_table_regions')] else [] end as cs from p),
t0 as (select fixture_id, page_idx, p, unnest(cs) as c, generate_subscripts(cs, 1) - 1 as child_idx from tl),
t as (select * from t0 where json_type(c) <> 'NULL')
"""

QUERIES = {
    "p3_found": lambda spark, d: nested.fixture_rows(table(spark, d, "fixture_files")),
    "p3_headings": lambda spark, d: nested.fixture_headings(table(spark, d, "fixture_files")),
    "p3_table_regions": lambda spark, d: nested.fixture_table_regions(table(spark, d, "fixture_files")),
    "p3_pages": lambda spark, d: nested.fixture_pages(table(spark, d, "fixture_files")),
}

_COUNTS = ", ".join(f"coalesce(try_cast(p ->> '$.{f}' as bigint), 0) as {f}" for f in nested._COUNTS)

SQL = {
    "p3_found": _SQL_BASE
    + """select fixture_id, cast(page_idx as bigint) as page_idx, 'page' as child, cast(-1 as bigint) as child_idx from p
union all select fixture_id, cast(page_idx as bigint), 'heading', cast(child_idx as bigint) from h
union all select fixture_id, cast(page_idx as bigint), 'table_region', cast(child_idx as bigint) from t""",
    "p3_headings": _SQL_BASE
    + """select fixture_id, cast(page_idx as int) as page_idx, cast(child_idx as int) as heading_idx, try_cast(p ->> '$.page' as bigint) as page,
c ->> '$.text' as text, try_cast(c ->> '$.level' as int) as level from h""",
    "p3_table_regions": _SQL_BASE
    + """select fixture_id, cast(page_idx as int) as page_idx, cast(child_idx as int) as region_idx, try_cast(p ->> '$.page' as bigint) as page,
try_cast(c ->> '$.x0' as double) as x0, try_cast(c ->> '$.y0' as double) as y0, try_cast(c ->> '$.x1' as double) as x1, try_cast(c ->> '$.y1' as double) as y1 from t""",
    "p3_pages": _SQL_BASE
    + f"""select fixture_id, cast(page_idx as int) as page_idx, try_cast(p ->> '$.page' as bigint) as page, {_COUNTS},
try_cast(p ->> '$.expected_formula_detection_count' as bigint) as expected_formula_detection_count,
coalesce(try_cast(p ->> '$.skip_text_metrics' as boolean), false) as skip_text_metrics,
coalesce(try_cast(p ->> '$.skip_table_metrics' as boolean), false) as skip_table_metrics from p""",
}
