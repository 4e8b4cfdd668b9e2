"""Queries of the page-local joins with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import predicates as P
from docloom.functions import text as T
from docloom.operators import base, facts, nested, spatial
from docloom.operators.base import sql
from docloom.plans import facts as facts_plan
from docloom.plans import nested as nested_plan
from docloom.plans.scalars import _value, _words
from docloom.session import table

#: Column starts of the word grid in points.
CENTRES = [72.0 + 38.0 * k for k in range(12)]

_FURN = "furn as (select distinct doc_id, page_num, line_idx, x0, y0, x1, y1 from furniture_lines)"
_INTER = "(greatest(least(a.x1, r.x1) - greatest(a.x0, r.x0), 0.0) * greatest(least(a.y1, r.y1) - greatest(a.y0, r.y0), 0.0))"
_AREA_A, _AREA_R = "((a.x1 - a.x0) * (a.y1 - a.y0))", "((r.x1 - r.x0) * (r.y1 - r.y0))"
_FIRST = f"({_INTER} / greatest({_AREA_A}, 1.0))"
_SMALLER = f"({_INTER} / greatest(least({_AREA_A}, {_AREA_R}), 1.0))"
_SAME = "r.doc_id = a.doc_id and r.page_num = a.page_num"
_DATA = f"(len({_words('text')}) >= 4 and (len(list_filter({_words('text')}, lambda w: {_value('w')})) * 100 // greatest(len({_words('text')}), 1) >= 55 or (len(list_filter({_words('text')}, lambda w: length(regexp_replace(w, '[^0-9]', '', 'g')) >= 6)) > 0 and len(list_filter({_words('text')}, lambda w: {_value('w')})) >= 4)))"
_TABLES = f"tables as (select doc_id, page_num, block_id, x0 - 5 as x0, y0 - 5 as y0, x1 + 5 as x1, y1 + 5 as y1, 0.8::double as confidence from blocks where block_id < 1000000 and {_DATA})"
_RUNS = "runs as (select doc_id, page_num, block_id, line_id, cast(font_size as varchar) as run, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from words group by doc_id, page_num, block_id, line_id, font_size)"
_FORMULA_SIZES = "fs as (select f.*, coalesce(p.width, 612.0) as w, coalesce(p.height, 792.0) as h from formulas f left join pages p using (doc_id, page_num))"
_CLS = (facts_plan._PAGE, facts_plan._BODY, facts_plan._BASE, facts_plan._LEVEL)


def furniture(spark, d):
    return table(spark, d, "furniture_lines").select("doc_id", "page_num", "line_idx", "x0", "y0", "x1", "y1").distinct()


def tables(spark, d):
    """Blocks that read as table rows, their box grown by 5 points, as table regions."""
    rows = base.body_blocks(spark, d).where(P.is_data_row(T.words(F.col("text"))))
    grown = [(F.col(k) + s * 5).alias(k) for k, s in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))]
    return rows.select("doc_id", "page_num", *grown, F.array("block_id").alias("source_block_ids"), F.lit(0.8).alias("confidence"))


def font_runs(spark, d):
    """Runs of one font size in a line, with their box."""
    w = base.words(spark, d)
    return w.groupBy("doc_id", "page_num", "block_id", "line_id", "font_size").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).withColumn("run", F.col("font_size").cast("string"))


def _classified(spark, d):
    return facts_plan._classified(spark, d)


def _padded(s, d):
    sized = facts.with_page(base.formulas(s, d), base.pages(s, d))
    grown = G.pad_and_clamp(G.box(), 40.0, F.col("width"), F.col("height"))
    return sized.select("doc_id", "page_num", "formula_index", *[c.alias(n) for c, n in zip(grown, ("x0", "y0", "x1", "y1"), strict=True)])


KEYS = base.BLOCK_KEYS
QUERIES = {
    "anti_furniture": lambda s, d: spatial.outside(base.blocks(s, d), furniture(s, d)).select(*KEYS),
    "words_outside_formulas": lambda s, d: spatial.outside(base.words(s, d), base.formulas(s, d), 0.5, "smaller").select(*KEYS, "widx"),
    "formulas_outside_furniture": lambda s, d: spatial.outside(base.formulas(s, d), furniture(s, d), 0.5).select("doc_id", "page_num", "formula_index"),
    "anti_formulas": lambda s, d: spatial.outside(base.blocks(s, d), base.formulas(s, d)).select(*KEYS),
    "anti_tables": lambda s, d: spatial.outside_tables(_classified(s, d), tables(s, d)).select(*KEYS, "kind"),
    "formulas_reindexed": lambda s, d: spatial.reindexed(base.formulas(s, d), tables(s, d)).select("doc_id", "page_num", "formula_index", "source_text"),
    "block_font_runs": lambda s, d: spatial.best_overlap(base.blocks(s, d), font_runs(s, d), KEYS, "run", 0.1),
    "block_tags": lambda s, d: spatial.best_overlap(base.blocks(s, d), furniture(s, d), KEYS, "line_idx", 0.5),
    "formula_area_in_blocks": lambda s, d: spatial.overlap_area(base.blocks(s, d), base.formulas(s, d), KEYS),
    "captioned_media": lambda s, d: spatial.near_captions(base.formulas(s, d), _classified(s, d).where("kind = 'Caption'"), base.pages(s, d), ["doc_id", "page_num", "formula_index"]),
    "region_iou_pairs": lambda s, d: spatial.iou_pairs(nested.fixture_table_regions(table(s, d, "fixture_files")).where("x0 is not null"), ["fixture_id", "page_idx"], "region_idx", 0.05),
    "nearest_column": lambda s, d: spatial.nearest(base.words(s, d), CENTRES).select(*KEYS, "widx", "column"),
    "column_range": lambda s, d: spatial.column_interval(base.words(s, d), CENTRES).select(*KEYS, "widx", "column"),
    "interleave_merge": lambda s, d: spatial.merged_order(base.body_blocks(s, d), base.formulas(s, d).withColumn("id", F.col("formula_index"))),
    "repeated_text_blocks": lambda s, d: _repeated(s, d),
    "padded_boxes": lambda s, d: _padded(s, d),
    "significant_images": lambda s, d: facts.with_page(base.formulas(s, d), base.pages(s, d)).where(P.is_significant_image(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height")])).select("doc_id", "page_num", "formula_index"),
}


def _repeated(s, d):
    """Blocks whose text is repeated edge text and stands on a page after its first."""
    b = base.blocks(s, d)
    seen = facts.repeated_edge_text(b, base.pages(s, d))
    keyed = b.withColumn("key", T.furniture_token(F.col("text")))
    return keyed.join(seen, ["doc_id", "key"]).where(F.col("page_num") > F.col("first_page")).select(*KEYS, "key")


def _anti(items: str, keys: str, regions: str, test: str, *ctes: str) -> str:
    return sql(f"select {keys} from {items} a where not exists (select 1 from {regions} r where {_SAME} and {test})", *ctes)


def _best(items: str, regions: str, value: str, least: float, *ctes: str) -> str:
    return sql(
        f"select a.doc_id, a.page_num, a.block_id, b.v as {value} from {items} a left join best b using (doc_id, page_num, block_id)",
        *ctes,
        f"best as (select distinct on (a.doc_id, a.page_num, a.block_id) a.doc_id, a.page_num, a.block_id, r.{value} as v from {items} a join {regions} r on {_SAME} and {_SMALLER} > {least}::double"
        f" order by a.doc_id, a.page_num, a.block_id, round({_SMALLER}, 9) desc, round({_AREA_R}, 6), r.{value})",
    )


SQL = {
    "padded_boxes": sql("select doc_id, page_num, formula_index, greatest(x0 - 40, 0.0) as x0, greatest(y0 - 40, 0.0) as y0, least(x1 + 40, w) as x1, least(y1 + 40, h) as y1 from fs", _FORMULA_SIZES),
    "significant_images": sql(
        "select doc_id, page_num, formula_index from fs where ((x1 - x0) / greatest(w, 1.0) >= 0.10::double or (y1 - y0) / greatest(h, 1.0) >= 0.06::double) and (x1 - x0) * (y1 - y0) / (greatest(w, 1.0) * greatest(h, 1.0)) >= 0.004::double and x1 - x0 > 8 and y1 - y0 > 8",
        _FORMULA_SIZES,
    ),
    "anti_furniture": _anti("blocks", "doc_id, page_num, block_id", "furn", f"{_FIRST} > 0.55::double", _FURN),
    "words_outside_formulas": _anti("words", "doc_id, page_num, block_id, widx", "formulas", f"{_SMALLER} > 0.5::double"),
    "formulas_outside_furniture": _anti("formulas", "doc_id, page_num, formula_index", "furn", f"{_FIRST} > 0.5::double", _FURN),
    "anti_formulas": _anti("blocks", "doc_id, page_num, block_id", "formulas", f"{_FIRST} > 0.55::double"),
    "anti_tables": sql(f"select doc_id, page_num, block_id, kind from cl3 a where kind = 'Heading' or not exists (select 1 from tables r where {_SAME} and (r.block_id = a.block_id or {_FIRST} > 0.55::double))", *_CLS, _TABLES),
    "formulas_reindexed": sql(
        f"select doc_id, page_num, row_number() over (partition by doc_id, page_num order by formula_index) - 1 as formula_index, source_text from formulas a where not exists (select 1 from tables r where {_SAME} and confidence >= 0.7 and {_FIRST} > 0.55::double)",
        _TABLES,
    ),
    "block_font_runs": _best("blocks", "runs", "run", 0.1, _RUNS),
    "block_tags": _best("blocks", "furn", "line_idx", 0.5, _FURN),
    "formula_area_in_blocks": sql(f"select a.doc_id, a.page_num, a.block_id, coalesce(round(sum(case when r.doc_id is not null then {_INTER} end), 6), 0.0) as covered from blocks a left join formulas r on {_SAME} and {_INTER} > 0 group by all"),
    "captioned_media": sql(
        f"select a.doc_id, a.page_num, a.formula_index from formulas a left join pages p using (doc_id, page_num) where exists (select 1 from cl3 r where r.kind = 'Caption' and {_SAME} and least(a.x1, r.x1) - greatest(a.x0, r.x0) > 0"
        " and greatest(r.y0 - a.y1, a.y0 - r.y1, 0.0) <= coalesce(p.height, 792.0) * 0.06::double)",
        *_CLS,
    ),
    "region_iou_pairs": nested_plan._SQL_BASE
    + f""", reg as (select fixture_id, cast(page_idx as int) as page_idx, cast(child_idx as int) as i, try_cast(c ->> '$.x0' as double) as x0, try_cast(c ->> '$.y0' as double) as y0,
  try_cast(c ->> '$.x1' as double) as x1, try_cast(c ->> '$.y1' as double) as y1 from t)
select a.fixture_id, a.page_idx, a.i as left_idx, r.i as right_idx, round({_INTER} / ({_AREA_A} + {_AREA_R} - {_INTER}), 9) as iou from reg a join reg r on r.fixture_id = a.fixture_id and r.page_idx = a.page_idx and a.i < r.i
where {_AREA_A} + {_AREA_R} - {_INTER} > 0 and {_INTER} / ({_AREA_A} + {_AREA_R} - {_INTER}) >= 0.05::double""",
    "nearest_column": sql(f"select doc_id, page_num, block_id, widx, case when {{d}} <= 40 then cast({{k}} as int) end as column from words".replace("{d}", "abs(x0 - (72 + 38 * {k}))").replace("{k}", "greatest(0, least(11, cast(ceil((x0 - 72) / 38 - 0.5) as int)))").replace("as column", 'as "column"')),
    "column_range": sql('select doc_id, page_num, block_id, widx, cast(greatest(0, least(11, floor((x0 + 20 - 72) / 38))) as int) as "column" from words'),
    "interleave_merge": sql(
        "select doc_id, page_num, origin, id, row_number() over (partition by doc_id, page_num order by pos, rank, y0, x0, id) - 1 as reading_order from u",
        "m as (select f.doc_id, f.page_num, f.formula_index as id, f.x0, f.y0, min(b.reading_order) as pos from formulas f left join body_blocks b on b.doc_id = f.doc_id and b.page_num = f.page_num and f.y0 < b.y0 group by all)",
        "u as (select doc_id, page_num, 'media' as origin, id, coalesce(pos, 4611686018427387904) as pos, 0 as rank, y0, x0 from m union all select doc_id, page_num, 'text', block_id, reading_order, 1, y0, 0.0 from body_blocks)",
    ),
    "repeated_text_blocks": sql(
        f"select b.doc_id, b.page_num, b.block_id, r.key from (select *, {facts_plan._TOKEN} as key from blocks) b join r using (doc_id, key) where b.page_num > r.first_page",
        facts_plan._PAGE,
        f"r as (select doc_id, {facts_plan._TOKEN} as key, min(page_num) as first_page from sized where (y1 <= height * 0.18::double or y0 >= height * 0.84::double) and length({facts_plan._TOKEN}) >= 4 and strlen(text) <= 120 group by 1, 2 having count(distinct page_num) >= 3)",
    ),
}
