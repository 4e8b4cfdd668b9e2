"""Queries of document and page facts with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import predicates as P
from docloom.functions import text as T
from docloom.operators import base, facts, media, pagefolds, visual
from docloom.operators.base import sql
from docloom.plans.scalars import _collapse, _title, _trim, _value, _words
from docloom.session import table

NEEDLE = "checklist"

_PAGE = "sized as (select b.*, coalesce(p.width, 612.0) as width, coalesce(p.height, 792.0) as height from blocks b left join pages p using (doc_id, page_num))"
_WORDS = "wsized as (select w.*, coalesce(p.width, 612.0) as width, coalesce(p.height, 792.0) as height from words w left join pages p using (doc_id, page_num))"
_TOKEN = r"lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))"
_BODY = "bins as (select doc_id, round(font_size * 2) as bin, count(*) as n from blocks where font_size > 0 group by all), body as (select d.doc_id, coalesce(b.bin / 2, 10.0) as body_size from (select distinct doc_id from blocks) d left join (select distinct on (doc_id) doc_id, bin from bins order by doc_id, n desc, bin) b using (doc_id))"
_BASE = rf"hb as (select doc_id, case when bool_or(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches({_trim('l')}, '^[0-9]+\s+\S'))) > 0) then 1 else 2 end as base_level from blocks group by 1)"
_DATA_ROWS = f"dr as (select doc_id, page_num from blocks where block_id < 1000000 and len({_words('text')}) >= 4 and (len(list_filter({_words('text')}, lambda w: {_value('w')})) * 100 // greatest(len({_words('text')}), 1) >= 55 or (len(list_filter({_words('text')}, lambda w: length(regexp_replace(w, '[^0-9]', '', 'g')) >= 6)) > 0 and len(list_filter({_words('text')}, lambda w: {_value('w')})) >= 4)))"
_FACTS = rf"""pf0 as (select doc_id, page_num, count(*) as n_blocks, sum((x1 - x0) * (y1 - y0)) as text_area, bool_or({_trim('text')} <> '') as readable,
  sum(length(text) - length(replace(text, chr(65533), ''))) as reps, sum(length(regexp_replace(text, '{facts.MATH_CHARS}', '', 'g'))) as maths from blocks group by all),
pf as (select p.doc_id, p.page_num, coalesce(n_blocks, 0) as n_blocks, round(coalesce(text_area, 0.0) / greatest(width * height, 1.0), 9) as text_area_fraction, coalesce(readable, false) as readable_text,
  (not coalesce(readable, false) and images > 0) as image_only, (n_blocks is null or coalesce(text_area, 0.0) / greatest(width * height, 1.0) < 0.02) as low_density,
  cast(coalesce(reps, 0) as bigint) as replacements, cast(coalesce(maths, 0) as bigint) as math_chars from pages p left join pf0 using (doc_id, page_num))"""
_MARGIN = rf"""mw as (select *, {_TOKEN} as token, coalesce(baseline_y, y1) as base from wsized where y0 < height * 0.08::double or y1 > height * (1 - 0.08::double)),
mg as (select *, case when base - lag(base) over w <= least(greatest(font_size * 0.8::double, 3.0), 10.0) then 0 else 1 end as isnew from mw where token <> '' window w as (partition by doc_id, page_num order by base, x0, block_id, widx)),
ml as (select *, sum(isnew) over (partition by doc_id, page_num order by base, x0, block_id, widx rows unbounded preceding) as line from mg),
mlines as (select doc_id, page_num, string_agg(token, ' ' order by x0, block_id, widx) as signature, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from ml group by doc_id, page_num, line),
sw as (select doc_id, page_num, {_TOKEN} as signature, x0, y0, x1, y1 from wsized where (x1 <= width * 0.1::double or x0 >= width * 0.9::double) and strlen({_TOKEN}) >= 4),
ff as (select * from mlines union all select * from sw)"""
_LEVEL = rf"""cl0 as (select s.*, body_size, base_level, {_trim('text')} as t, font_size / greatest(body_size, 0.1) as ratio from sized s join body using (doc_id) join hb using (doc_id)),
cl1 as (select *, regexp_extract(t, '{P.NUMBERED}', 1) as label, regexp_extract(t, '{P.NUMBERED}', 2) as sep, regexp_extract(t, '{P.NUMBERED}', 3) as title, not contains(t, chr(10)) and regexp_matches(t, '{P.PAGE_NUMBER}') as num from cl0),
cl2 as (select *, case when not contains(t, chr(10)) and title <> '' and strlen(title) <= 100 and not ends_with(title, '.') and (ratio >= 1.05 or {_title('title')})
  then least(greatest(len(string_split(label, '.')) + (case when len(string_split(label, '.')) = 1 and sep = '.' then 2 else base_level end) - 1, 1), 6) end as lv,
  regexp_matches(t, '{P.ORDERED}') as ol, regexp_matches(t, '{P.UNORDERED}') as ul from cl1),
cl3 as (select *, case when t = '' then 'Paragraph' when y1 <= height * 0.07::double and num then 'PageNumber' when y1 <= height * 0.07::double then 'RunningHeader'
  when y0 >= height * 0.93::double and num then 'PageNumber' when y0 >= height * 0.93::double then 'RunningFooter' when num then 'PageNumber'
  when regexp_matches(t, '{P.CAPTION}') then 'Caption' when regexp_matches(t, '{P.CODE}') then 'CodeBlock' when lower(t) = 'abstract' then 'Heading' when lv is not null then 'Heading'
  when ol or ul then 'ListItem' when regexp_matches(t, '{P.SCHOLARLY}') or regexp_matches(t, '{P.NOTE}') then 'Paragraph' when ratio >= 1.15 then 'Heading' else 'Paragraph' end as kind from cl2)"""


def _classified(spark, d):
    b = base.blocks(spark, d)
    return facts.classified(b, base.pages(spark, d), facts.body_font_size(b), facts.heading_base(b))


def _boxes(spark, d):
    """Formula boxes stand in for figures: the tables hold no images."""
    return base.formulas(spark, d).select("doc_id", "page_num", F.col("formula_index").alias("id"), F.lit("Figure").alias("kind"), F.col("equation_number").alias("caption"), "x0", "y0", "x1", "y1")


def _rows(spark, d):
    """Blocks that read as table rows stand for table cells."""
    return base.body_blocks(spark, d).where(P.is_data_row(T.words(F.col("text"))))


def _tags(spark, d):
    """Furniture lines as artifact tags and formula boxes as captions: the tables hold no structure tags."""
    lines = table(spark, d, "furniture_lines").select("doc_id", "page_num", F.lit("/Artifact").alias("role"), "x0", "y0", "x1", "y1").distinct()
    return lines.unionByName(base.formulas(spark, d).select("doc_id", "page_num", F.lit("Caption").alias("role"), "x0", "y0", "x1", "y1"))


def _pixels(boxes, ink: float = 0.4):
    """Pixel lines as if each box were inked to a share: a stand-in for a rasteriser."""
    w = boxes.select("doc_id", "page_num", "x0", "x1", F.explode(F.sequence(F.floor("y0").cast("int"), F.floor("y1").cast("int"))).alias("y"))
    wide = F.col("x1") - F.col("x0")
    lines = w.groupBy("doc_id", "page_num", "y").agg(F.sum(F.floor(wide * F.lit(ink))).alias("dark"), F.floor(F.min("x0")).alias("min_x"), F.floor(F.max("x1")).alias("max_x"), F.max(F.floor(wide)).alias("max_run"))
    return lines.where("dark > 0")


def _visual(spark, d):
    """Formulas as pictures: the boxes of the formulas without a number are inked, those with one are known already."""
    b, f = base.blocks(spark, d), base.formulas(spark, d)
    lines = base.lines(spark, d).select("doc_id", "page_num", F.col("line").alias("text"))
    bands = visual.dark_bands(_pixels(f.where("equation_number is null")), 612)
    known = f.where("equation_number is not null")
    return visual.visual_formulas(bands, base.words(spark, d), b, base.pages(spark, d), known, _tags(spark, d).where("role = '/Artifact'"), visual.reference_pages(lines))


def _warnings(spark, d):
    found = facts.page_facts(base.blocks(spark, d), base.pages(spark, d))
    return media.warnings(found, base.formulas(spark, d), facts.scan_like(found))


def _cells(spark, d):
    return pagefolds.page_grid_cells(base.body_blocks(spark, d), facts.body_font_size(base.blocks(spark, d)))


QUERIES = {
    "reference_pages": lambda spark, d: visual.reference_pages(base.lines(spark, d).select("doc_id", "page_num", F.col("line").alias("text"))),
    "inspect_pages": lambda spark, d: facts.page_facts(base.blocks(spark, d), base.pages(spark, d)),
    "inspect_documents": lambda spark, d: facts.scan_like(facts.page_facts(base.blocks(spark, d), base.pages(spark, d))),
    "ocr_triage_report": lambda spark, d: facts.ocr_triage(facts.page_facts(base.blocks(spark, d), base.pages(spark, d))).withColumn("pages_needing_ocr", F.array_join("pages_needing_ocr", ",")),
    "route_pages": lambda spark, d: facts.routed_pages(facts.page_facts(base.blocks(spark, d), base.pages(spark, d)), _rows(spark, d), base.formulas(spark, d)),
    "density_ratio": lambda spark, d: facts.density_ratio(base.body_blocks(spark, d), base.pages(spark, d)),
    "tagged_blocks": lambda spark, d: facts.tagged_blocks(_classified(spark, d), _tags(spark, d)).select(*base.BLOCK_KEYS, "kind", "level", "ordered", "depth"),
    "dark_bands": lambda spark, d: visual.dark_bands(_pixels(base.words(spark, d)), 612),
    "visual_formulas": lambda spark, d: _visual(spark, d),
    "conversion_warnings": lambda spark, d: _warnings(spark, d),
    "kept_text": lambda spark, d: media.kept_text(_classified(spark, d), facts.repeated_edge_text(base.blocks(spark, d), base.pages(spark, d))).select(*base.BLOCK_KEYS),
    "repeated_media": lambda spark, d: media.repeated_media(_boxes(spark, d), base.pages(spark, d)).select("doc_id", "fingerprint.*", "n_pages"),
    "media_plan": lambda spark, d: media.media_plan(_boxes(spark, d), _classified(spark, d), base.pages(spark, d)),
    "body_font_size": lambda spark, d: facts.body_font_size(base.blocks(spark, d)),
    "block_font_size": lambda spark, d: facts.dominant_font_size(base.words(spark, d)),
    "heading_base": lambda spark, d: facts.heading_base(base.blocks(spark, d)),
    "margin_lines": lambda spark, d: facts.margin_lines(base.words(spark, d), base.pages(spark, d)),
    "furniture_mask": lambda spark, d: facts.furniture(base.words(spark, d), base.pages(spark, d)),
    "repeated_edge_text": lambda spark, d: facts.repeated_edge_text(base.blocks(spark, d), base.pages(spark, d)),
    "classified_blocks": lambda spark, d: _classified(spark, d).select(*base.BLOCK_KEYS, "kind", "level", "ordered", "depth"),
    "search_boxes": lambda spark, d: facts.search_boxes(base.blocks(spark, d), NEEDLE),
    "search_hits": lambda spark, d: facts.search_hits(base.blocks(spark, d), NEEDLE),
}

SQL = {
    "inspect_pages": sql("select * from pf", _FACTS),
    "inspect_documents": sql(
        "select *, (page_count > 0 and (image_only_pages = page_count or (readable_pages = 0 and low_density_pages > 0))) as likely_scan_like from t",
        _FACTS,
        "t as (select doc_id, count(*) as page_count, count_if(readable_text) as readable_pages, count_if(image_only) as image_only_pages, count_if(low_density) as low_density_pages from pf group by 1)",
    ),
    "ocr_triage_report": sql(
        "select doc_id, count(*) as pages_total, count_if(readable_text) as pages_with_readable_text, count_if(image_only) as image_only_pages, count_if(low_density) as low_density_pages, cast(sum(replacements) as bigint) as suspicious_replacement_chars,"
        " coalesce(string_agg(cast(page_num + 1 as varchar), ',' order by page_num) filter (where image_only or (not readable_text and low_density) or replacements >= 8), '') as pages_needing_ocr from pf group by 1",
        _FACTS,
    ),
    "route_pages": sql(
        "select * from (select pf.doc_id, pf.page_num, r.doc_id is not null as has_table, f.doc_id is not null as has_formula, math_chars >= 4 as math_heavy, low_density from pf left join (select distinct doc_id, page_num from formulas) f on f.doc_id = pf.doc_id and f.page_num = pf.page_num"
        " left join (select distinct doc_id, page_num from dr) r on r.doc_id = pf.doc_id and r.page_num = pf.page_num) where has_table or has_formula or math_heavy or low_density",
        _FACTS,
        _DATA_ROWS,
    ),
    "reference_pages": sql(
        rf"select doc_id, page_num from block_lines group by all having bool_or({_trim('line')} in ('References', 'Bibliography', 'REFERENCES', 'BIBLIOGRAPHY')) or count_if(regexp_matches({_trim('line')}, '^/[0-9]{{1,4}}/|^\[[0-9]{{1,4}}\]\s*\S|^\([0-9]{{1,4}}\)\s*\S')) * 10 >= count(*) * 4"
    ),
    "density_ratio": sql(
        "select doc_id, page_num, round(case when (max(x1) - min(x0)) * (max(y1) - min(y0)) > 0 then least(sum((x1 - x0) * (y1 - y0)) / ((max(x1) - min(x0)) * (max(y1) - min(y0))), 1.0) else 0.0 end, 9) as density from body_blocks group by all"
    ),
    "dark_bands": sql(
        "select doc_id, page_num, min(y0) as y0, max(y1) as y1, min(x0) as x0, max(x1) as x1, cast(sum(dark) as bigint) as dark, max(run) as run from (select *, sum(case when y0 - py <= 6 then 0 else 1 end) over (partition by doc_id, page_num order by y0 rows unbounded preceding) as band from (select *, lag(y1) over (partition by doc_id, page_num order by y0) as py from isl where x0 < x1)) group by doc_id, page_num, band",
        "px0 as (select doc_id, page_num, x0, x1, unnest(generate_series(cast(floor(y0) as int), cast(floor(y1) as int))) as y from words)",
        "px as (select * from (select doc_id, page_num, cast(y as int) as y, cast(sum(floor((x1 - x0) * 0.4::double)) as bigint) as dark, cast(floor(min(x0)) as bigint) as min_x, cast(floor(max(x1)) as bigint) as max_x, cast(max(floor(x1 - x0)) as bigint) as max_run from px0 group by 1, 2, 3) where dark > 0)",
        "sm as (select *, case when lag(y) over w = y - 1 then lag(dark) over w end as b, case when lead(y) over w = y + 1 then lead(dark) over w end as a from px window w as (partition by doc_id, page_num order by y))",
        "kept as (select *, y - row_number() over (partition by doc_id, page_num order by y) as island from sm where (dark + coalesce(b, 0) + coalesce(a, 0)) // (1 + (case when b is null then 0 else 1 end) + (case when a is null then 0 else 1 end)) >= 6)",
        "isl as (select doc_id, page_num, island, min(y) as y0, max(y) + 1 as y1, min(min_x) as x0, max(max_x) as x1, sum(dark) as dark, max(max_run) as run from kept group by all)",
    ),
    "conversion_warnings": sql(
        "select doc_id, 'pages-without-text' as warning, count_if(n_blocks = 0) as n, count(*) as of, null::varchar as advice from pf group by 1 having count_if(n_blocks = 0) > 0"
        " union all select f.doc_id, 'formula-candidates', n, of, 'backend' from (select doc_id, count(*) as n from formulas group by 1) f join (select doc_id, count(*) as of from pf group by 1) p using (doc_id)"
        " union all select doc_id, 'scan-heavy', count_if(low_density), count(*), 'ocr' from pf group by 1 having bool_and(image_only) or (not bool_or(readable_text) and bool_or(low_density))",
        _FACTS,
    ),
    "kept_text": sql(
        f"select c.doc_id, c.page_num, c.block_id from cl3 c left join (select doc_id, {_TOKEN} as key, min(page_num) as first_page from sized where (y1 <= height * 0.18::double or y0 >= height * 0.84::double) and length({_TOKEN}) >= 4 and strlen(text) <= 120 group by 1, 2 having count(distinct page_num) >= 3) r"
        f" on r.doc_id = c.doc_id and c.kind in ('Heading', 'Paragraph') and r.key = {_TOKEN.replace('text', 'c.text')} where r.doc_id is null or c.page_num <= r.first_page",
        _PAGE,
        _BODY,
        _BASE,
        _LEVEL,
    ),
    "repeated_media": sql(
        "select doc_id, x, y, w, h, band, count(distinct page_num) as n_pages from (select f.doc_id, f.page_num, " + ", ".join(f"cast(round(least(greatest({v}, 0.0), 1.0) * 10) as int) as {n}" for n, v in (("x", "(x0 + x1) / 2 / greatest(pw, 1.0)"), ("y", "(y0 + y1) / 2 / greatest(ph, 1.0)"), ("w", "(x1 - x0) / greatest(pw, 1.0)"), ("h", "(y1 - y0) / greatest(ph, 1.0)")))
        + ", case when y1 <= ph * 0.18::double then 0 when y0 >= ph * 0.84::double then 1 else 2 end as band from (select f.*, coalesce(p.width, 612.0) as pw, coalesce(p.height, 792.0) as ph from formulas f left join pages p using (doc_id, page_num)) f) group by all having count(distinct page_num) >= 2"
    ),
    "body_font_size": sql("select * from body", _BODY),
    "block_font_size": sql("select distinct on (doc_id, page_num, block_id) doc_id, page_num, block_id, size as font_size from s order by doc_id, page_num, block_id, n desc, size", "s as (select doc_id, page_num, block_id, round(font_size, 1) as size, count(*) as n from words group by all)"),
    "heading_base": sql("select * from hb", _BASE),
    "margin_lines": sql("select * from mlines", _WORDS, _MARGIN),
    "furniture_mask": sql(
        "select ff.* from ff where exists (select 1 from often o where o.doc_id = ff.doc_id and o.signature = ff.signature)",
        _WORDS,
        _MARGIN,
        "np as (select doc_id, count(distinct page_num) as n_pages from words group by 1)",
        "often as (select f.doc_id, f.signature from ff f join np using (doc_id) where n_pages >= 2 group by f.doc_id, f.signature, n_pages having count(distinct f.page_num) >= greatest(ceil(n_pages * 0.5), 2))",
    ),
    "repeated_edge_text": sql(
        f"select doc_id, {_TOKEN} as key, count(distinct page_num) as n_pages, min(page_num) as first_page from sized where (y1 <= height * 0.18::double or y0 >= height * 0.84::double) and length({_TOKEN}) >= 4 and strlen(text) <= 120 group by 1, 2 having count(distinct page_num) >= 3",
        _PAGE,
    ),
    "classified_blocks": sql(
        "select doc_id, page_num, block_id, kind, cast(case when kind = 'Heading' then (case when lower(t) = 'abstract' then 2 when lv is not null then lv when ratio >= 2 then 1 when ratio >= 1.6 then 2 when ratio >= 1.35 then 3 when ratio >= 1.15 then 4 else 5 end) end as int) as level,"
        " case when kind = 'ListItem' then ol end as ordered, case when kind = 'ListItem' then (case when x0 / width < 0.15 then 0 when x0 / width < 0.25 then 1 else 2 end) end as depth from cl3",
        _PAGE,
        _BODY,
        _BASE,
        _LEVEL,
    ),
    "search_boxes": sql(
        f"select doc_id, page_num + 1 as page, block_id, x0, y0, x1, y1, cast((length(l) - length(replace(l, '{NEEDLE}', ''))) / {len(NEEDLE)} as bigint) as hit_count from (select *, lower({_collapse('text')}) as l from blocks) where contains(l, '{NEEDLE}')"
    ),
    "search_hits": sql(
        f"select doc_id, page_num + 1 as page, cast(sum((length(l) - length(replace(l, '{NEEDLE}', ''))) / {len(NEEDLE)}) as bigint) as hit_count from (select doc_id, page_num, lower({_collapse('text')}) as l from blocks) where contains(l, '{NEEDLE}') group by 1, 2"
    ),
}
