"""Queries of the page-local algorithms, the rendering and the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import base, convert, enrich, facts, pagefolds, policy, render
from docloom.operators.base import sql
from docloom.plans import facts as facts_plan
from docloom.plans.scalars import _trim
from docloom.session import table
from docloom.sources import synthetic


def _convert(s, d):
    return convert.convert(base.words(s, d), base.blocks(s, d), base.pages(s, d), base.formulas(s, d))


def _images(s, d):
    """Formula boxes stand in for images: the tables hold none."""
    return base.formulas(s, d).select("doc_id", "page_num", F.col("formula_index").alias("image_index"), "x0", "y0", "x1", "y1")


def _rules(s, d):
    """The lower edge of every furniture line and the left edge of every block stand in for ruling lines."""
    level = table(s, d, "furniture_lines").select("doc_id", "page_num", F.lit("h").alias("orientation"), F.col("y1").alias("pos"), F.lit(60.0).alias("lo"), F.lit(552.0).alias("hi"))
    upright = base.body_blocks(s, d).select("doc_id", "page_num", F.lit("v").alias("orientation"), F.col("x0").alias("pos"), F.col("y0").alias("lo"), F.col("y1").alias("hi"))
    return level.unionByName(upright).distinct()


QUERIES = {
    "reading_order": lambda s, d: pagefolds.page_reading_order(base.body_blocks(s, d)),
    "formula_word_lines": lambda s, d: pagefolds.page_lines(base.words(s, d)),
    "coordinate_tables": lambda s, d: pagefolds.page_tables(base.words(s, d), base.pages(s, d)),
    "emitted_tables": lambda s, d: policy.emitted_tables(pagefolds.page_tables(base.words(s, d), base.pages(s, d))).select("doc_id", "page_num", "table_no", "source", "confidence"),
    "ruled_tables": lambda s, d: pagefolds.page_ruled_tables(base.words(s, d), _rules(s, d), base.pages(s, d)),
    "geometric_latex": lambda s, d: pagefolds.page_formulas(base.words(s, d), base.formulas(s, d)),
    "figure_candidates": lambda s, d: pagefolds.page_figures(facts_plan._classified(s, d), _images(s, d), base.pages(s, d)),
    "grid_cells": lambda s, d: facts_plan._cells(s, d),
    "word_grid_cells": lambda s, d: pagefolds.page_grid_cells(base.words(s, d).withColumn("block_id", F.col("block_id") * 10_000 + F.col("widx")), facts.body_font_size(base.blocks(s, d))),
    "illustrated_documents": lambda s, d: convert.convert(base.words(s, d), base.blocks(s, d), base.pages(s, d), base.formulas(s, d), convert.Options(pages=(1, 2)), _images(s, d))["documents"],
    "front_matter": lambda s, d: render.front_matter(facts_plan._classified(s, d)),
    "markdown_pages": lambda s, d: _convert(s, d)["pages"],
    "markdown_documents": lambda s, d: _convert(s, d)["documents"],
    "written_markdown": lambda s, d: base.rendered(s, d).where("markdown is not null").select("doc_id", render.without_markers(F.regexp_replace("markdown", "\r\n?", "\n")).alias("markdown")),
    "synthetic_layout": lambda s, d: synthetic.layout(table(s, d, "documents")).groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("words"), F.sum("x1").alias("x1"), F.max("y1").alias("y1")),
    "backend_results": lambda s, d: enrich.enriched(base.formulas(s, d).select("doc_id", "page_num", "formula_index", "source_text"), "source_text", _upper).select("doc_id", "page_num", "formula_index", "status", "output"),
}


def _upper(text: str) -> enrich.Result:
    """A backend for tests: the text in capitals."""
    return ("ok", text.upper(), 0, None) if text.strip() else ("empty", None, 0, None)


SQL = {
    "written_markdown": sql(
        "select doc_id, " + _trim(r"regexp_replace(regexp_replace(m, '(?m)^<!-- page:[0-9]+ -->\n?', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + " as markdown from md0"
    ),
    "backend_results": sql("select doc_id, page_num, formula_index, case when source_text is null or trim(source_text) = '' then 'empty' else 'ok' end as status, nullif(upper(source_text), '') as output from formulas"),
    "synthetic_layout": """
with b0 as (select doc_id, unnest(string_split(text, chr(10))) as para, generate_subscripts(string_split(text, chr(10)), 1) - 1 as block_id from documents where text is not null),
b1 as (select doc_id, block_id, list_filter(string_split_regex(trim(para), ' +'), lambda w: w <> '') as ws from b0),
b2 as (select *, cast(ceil(len(ws) / 12) as bigint) as n_lines, case when len(ws) <= 6 then 14.0 else 10.0 end as font_size from b1 where len(ws) > 0),
b3 as (select *, coalesce(sum(n_lines + 1) over (partition by doc_id order by block_id rows between unbounded preceding and 1 preceding), 0) as line0 from b2),
w0 as (select doc_id, font_size, line0, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as widx from b3),
w as (select *, cast(line0 + widx // 12 as bigint) as line from w0)
select doc_id, line // 50 as page_num, count(*) as words, cast(sum(72 + (widx % 12) * 38 + least(length(word), 7) * 5) as double) as x1, cast(max(72 + (line % 50) * 13 + font_size) as double) as y1 from w group by 1, 2""",
}
