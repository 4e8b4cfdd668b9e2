"""Queries of the page plans with their SQL, over the reports' page counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import base, pageplan
from docloom.operators.base import sql

_DOCS = "docs as (select doc_id, source, page_count from reports where page_count > 0)"
_SIZES = "sizes as (select doc_id, page_num, max(width) as width, max(height) as height from pages group by all)"
#: Selections that exercise the parser, with page counts.
SELECTIONS = [("all", 4), ("odd", 5), ("even", 5), ("2-4,1,3", 6), (" 1 , 1,2", 3), ("0", 3), ("4-2", 5), ("7", 3), ("x", 3), ("1-9", 4), ("EVEN,1", 4), ("", 2)]
#: Dates that exercise the PDF date rules.
DATES = ["D:20240131123059Z", "D:20240131123059+02'30'", "D:20240131123059-05'00", "D:20240131123059", "20240131123059", "D:2024", "D:20240131123059+0230", ""]
#: Dotted versions.
VERSIONS = ["1.2.10", "v1.2.9", "1.2", "2.0.0-rc1", "1.10"]


def _docs(s, d):
    return base.reports(s, d).select("doc_id", "source", "page_count")


def _sizes(s, d):
    return base.pages(s, d).groupBy("doc_id", "page_num").agg(F.max("width").alias("width"), F.max("height").alias("height"))


def _rows(s, values, schema):
    return s.createDataFrame(values, schema)


QUERIES = {
    "split_plan": lambda s, d: pageplan.split(_docs(s, d), 2),
    "extract_plan": lambda s, d: pageplan.extract(_docs(s, d), "odd"),
    "reorder_plan": lambda s, d: pageplan.reorder(_docs(s, d), "even,1"),
    "delete_plan": lambda s, d: pageplan.delete(_docs(s, d), "1"),
    "rotate_plan": lambda s, d: pageplan.rotate(_docs(s, d), "even", -90),
    "merge_plan": lambda s, d: pageplan.merge(_docs(s, d).where("source is not null"), "source"),
    "booklet_plan": lambda s, d: pageplan.booklet(_docs(s, d)),
    "two_up_plan": lambda s, d: pageplan.two_up(_docs(s, d)),
    "resize_contain": lambda s, d: pageplan.resize_matrix(_sizes(s, d), "a4", "contain"),
    "resize_cover": lambda s, d: pageplan.resize_matrix(_sizes(s, d), "letter", "cover"),
    "resize_stretch": lambda s, d: pageplan.resize_matrix(_sizes(s, d), "a4", "stretch"),
    "crop_plan": lambda s, d: pageplan.crop(_sizes(s, d), 36.0, 36.0, 500.0, 700.0),
    "page_selection": lambda s, d: _rows(s, SELECTIONS, "spec string, n bigint").select("spec", "n", F.array_join(T.page_selection(F.col("spec"), F.col("n")), ",").alias("pages")),
    "pdf_dates": lambda s, d: _rows(s, [(x,) for x in DATES], "value string").select("value", T.pdf_date_valid(F.col("value")).alias("valid"), T.pdf_date_iso(F.col("value")).alias("iso")),
    "version_order": lambda s, d: _rows(s, [(x,) for x in VERSIONS], "version string").select("version", F.array_join(T.version_order(F.col("version")), ".").alias("numbers")),
}


def _resize(w: float, h: float, sx: str, sy: str) -> str:
    rx, ry = f"({w} / width)", f"({h} / height)"
    sx, sy = sx.format(rx=rx, ry=ry), sy.format(rx=rx, ry=ry)
    return sql(f"select doc_id, page_num, round({sx}, 9) as sx, round({sy}, 9) as sy, round(({w} - width * {sx}) / 2, 6) as tx, round(({h} - height * {sy}) / 2, 6) as ty from sizes where width > 0 and height > 0", _SIZES)


def _values(rows: list[tuple], names: str) -> str:
    return "(values " + ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + f") as v({names})"


_EACH = "each as (select doc_id, source, page_count, unnest(range(1, page_count + 1)) as page from docs)"
_PART = r"""part as (select spec, n, unnest(string_split(regexp_replace(lower(spec), '\s', '', 'g'), ',')) as p, generate_subscripts(string_split(spec, ','), 1) as i from s),
ranged as (select *, case when p = 'all' then range(1, n + 1) when p = 'odd' then range(1, n + 1, 2) when p = 'even' then range(2, n + 1, 2)
  when regexp_full_match(p, '[0-9]+-[0-9]+') then case when cast(split_part(p, '-', 1) as bigint) >= 1 and cast(split_part(p, '-', 2) as bigint) <= n and cast(split_part(p, '-', 1) as bigint) <= cast(split_part(p, '-', 2) as bigint) then range(cast(split_part(p, '-', 1) as bigint), cast(split_part(p, '-', 2) as bigint) + 1) end
  when regexp_full_match(p, '[0-9]+') then case when cast(p as bigint) between 1 and n then [cast(p as bigint)] end end as r from part),
bad as (select spec, n, bool_or(r is null) as bad from ranged group by all),
flat as (select spec, n, i, unnest(r) as page, generate_subscripts(r, 1) as j from ranged),
firsts as (select distinct on (spec, n, page) spec, n, page, i, j from flat order by spec, n, page, i, j),
joined as (select spec, n, string_agg(cast(page as varchar), ',' order by i, j) as pages from firsts group by all)"""

SQL = {
    "split_plan": sql("select doc_id, (page - 1) // 2 + 1 as part, format('{}-part{:03d}', doc_id, (page - 1) // 2 + 1) as name, page from each", _DOCS, _EACH),
    "extract_plan": sql("select doc_id, cast(row_number() over (partition by doc_id order by page) - 1 as int) as out_page, page from each where page % 2 = 1", _DOCS, _EACH),
    "reorder_plan": sql("select doc_id, cast(row_number() over (partition by doc_id order by page % 2, page) - 1 as int) as out_page, page from each where page % 2 = 0 or page = 1", _DOCS, _EACH),
    "delete_plan": sql("select doc_id, cast(page - 2 as int) as out_page, page from each where page > 1", _DOCS, _EACH),
    "rotate_plan": sql("select doc_id, page, 270 as rotation from each where page % 2 = 0", _DOCS, _EACH),
    "merge_plan": sql("select source, doc_id, page, row_number() over (partition by source order by doc_id, page) as out_page from each where source is not null", _DOCS, _EACH),
    "booklet_plan": sql(
        "select doc_id, sheet, cast(i - 1 as int) as slot, case when o < page_count then o + 1 end as page from (select doc_id, page_count, sheet, unnest([n - s - 1, s, s + 1, n - s - 2]) as o, unnest([1, 2, 3, 4]) as i from (select doc_id, page_count, n, unnest(range(0, n // 4)) as sheet, unnest(range(0, n // 4)) * 4 as s from (select *, cast(ceil(page_count / 4) * 4 as bigint) as n from docs)))",
        _DOCS,
    ),
    "two_up_plan": sql("select doc_id, (page - 1) // 2 as sheet, cast((page - 1) % 2 as int) as slot, page from each", _DOCS, _EACH),
    "resize_contain": _resize(595.0, 842.0, "least({rx}, {ry})", "least({rx}, {ry})"),
    "resize_cover": _resize(612.0, 792.0, "greatest({rx}, {ry})", "greatest({rx}, {ry})"),
    "resize_stretch": _resize(595.0, 842.0, "{rx}", "{ry}"),
    "crop_plan": sql("select doc_id, page_num, 36.0::double as x0, 36.0::double as y0, 500.0::double as x1, 700.0::double as y1 from sizes", _SIZES),
    "page_selection": f"with s as (select spec, cast(n as bigint) as n from {_values(SELECTIONS, 'spec, n')}), {_PART} select bad.spec, bad.n, case when bad then null else pages end as pages from bad left join joined using (spec, n)",
    "pdf_dates": "select value, regexp_full_match(value, $$D:[0-9]{14}(?:Z|[+-][0-9]{2}'[0-9]{2}'?)?$$) as valid, case when regexp_full_match(value, $$D:[0-9]{14}(?:Z|[+-][0-9]{2}'[0-9]{2}'?)?$$) then value[3:6] || '-' || value[7:8] || '-' || value[9:10] || 'T' || value[11:12] || ':' || value[13:14] || ':' || value[15:16] || (case when length(value) <= 17 then 'Z' else value[17:19] || ':' || value[21:22] end) end as iso from "
    + _values([(x,) for x in DATES], "value"),
    "version_order": r"select version, array_to_string(list_transform(string_split(regexp_replace(version, '^v', ''), '.'), lambda p: coalesce(try_cast(nullif(regexp_extract(p, '^([0-9]+)', 1), '') as bigint), 0)), '.') as numbers from " + _values([(x,) for x in VERSIONS], "version"),
}
