"""The conversion pipeline: words and blocks of files to Markdown, as one chain of DataFrames.

Document-wide facts (font size, heading base, furniture) are aggregated first and joined by doc_id;
everything after runs by page. Tables and geometric formulas are the only steps in Python. Tables,
formulas and kept text are each used by several later branches, so they are written to the shared
folder once instead of being computed anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import facts, media, pagefolds, policy, render, spatial
from docloom.operators.base import MARGIN
from docloom.session import written

PAGE = ["doc_id", "page_num"]


@dataclass(frozen=True)
class Options:
    """What comes out: tables and formulas on or off, the formula policy, a floor for tables, the 1-based pages (all where none is named)."""

    tables: bool = True
    formulas: str = "auto"
    emit: str = "auto"
    table_confidence: float = 0.0
    pages: tuple[int, ...] = ()


def selected(df: DataFrame, options: Options) -> DataFrame:
    """The rows of the chosen pages. Facts of a file are of all its pages, so this comes after them."""
    return df.where((F.col("page_num") + 1).isin(*options.pages)) if options.pages else df


def kept_blocks(blocks: DataFrame, pages: DataFrame, furniture: DataFrame, tables: DataFrame, formulas: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Classified body blocks outside furniture, tables and formulas, leading headings as blocks of their own; ``tags`` come before all tests."""
    sizes, bases = facts.body_font_size(blocks), facts.heading_base(blocks)
    kinds = facts.headings_split(blocks.where(F.col("block_id") < MARGIN), pages, sizes, bases)
    if tags is not None:
        kinds = facts.tagged_blocks(kinds, tags)
    return spatial.outside(spatial.outside_tables(spatial.outside(kinds, furniture), tables), formulas)


def with_latex(words: DataFrame, formulas: DataFrame) -> DataFrame:
    """Formulas with ``text_latex``: given LaTeX, else from the formula's own words, else symbol by symbol."""
    unread = policy.tagged(formulas.where("latex is null and source_text is not null"))
    return policy.formula_kind(formulas, pagefolds.source_formulas(words, unread))


def placed_figures(text: DataFrame, images: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, id, kind, caption, box, text): figures that the page's media plan keeps, as image links."""
    found = pagefolds.page_figures(text, images, pages)
    listed = found.select(*PAGE, F.col("figure_no").cast("bigint").alias("id"), F.lit("Figure").alias("kind"), "caption", "x0", "y0", "x1", "y1")
    plan = media.media_plan(listed, text, pages).where("kept").select(*PAGE, "id")
    link = F.format_string("![%s](page%d_fig%d.png)", F.coalesce(F.regexp_replace("caption", r"[\[\]\s]+", " "), F.lit("")), F.col("page_num") + 1, F.col("id"))
    return listed.join(plan, [*PAGE, "id"]).withColumn("text", link)


def convert(words: DataFrame, blocks: DataFrame, pages: DataFrame, formulas: DataFrame, options: Options = Options(), images: DataFrame | None = None, rules: DataFrame | None = None, tags: DataFrame | None = None) -> dict[str, DataFrame]:  # noqa: B008
    """DataFrames ``blocks``, ``tables``, ``formulas``, ``figures``, ``pages``, ``documents`` and ``warnings`` of the conversion.

    What only some files have is optional: ``images`` (image_index and box) give figures, ``rules`` (ruling
    lines) tables between them, ``tags`` (role and box) kinds of blocks.
    """
    furniture = facts.furniture(words, pages)
    found = pagefolds.page_tables(words, pages, rules)
    gated = policy.emitted_tables(found.where(F.col("confidence") >= F.lit(options.table_confidence)))
    found = written(selected(gated, options) if options.tables else found.limit(0), "tables")
    decided = policy.emission(with_latex(words, selected(formulas, options)), options.formulas, options.emit).where("emit")
    decided = written(spatial.outside(decided, found), "formulas")
    text = written(selected(kept_blocks(blocks, pages, furniture, found, decided, tags), options), "text")
    columns = [*PAGE, "id", "kind", "x0", "y0", "text"]
    t_media = found.select(*PAGE, F.col("table_no").cast("bigint").alias("id"), F.lit("Table").alias("kind"), "x0", "y0", F.when(F.col("render") == "Markdown", render.gfm_table(F.col("rows"))).otherwise(F.concat(F.lit("```\n"), F.col("layout_text"), F.lit("\n```"))).alias("text"))
    f_media = decided.select(*PAGE, (F.col("formula_index") + 1000).alias("id"), F.lit("Formula").alias("kind"), "x0", "y0", F.col("text_latex").alias("text"))
    parts = t_media.unionByName(f_media)
    figures = None
    if images is not None:
        figures = written(placed_figures(text, selected(images, options), pages), "figures")
        parts = parts.unionByName(figures.withColumn("id", F.col("id") + 1_000_000).select(*columns))
    # A leading heading and its rest share their reading order: the heading comes first, media between them stay there.
    order = spatial.merged_order(text.withColumn("reading_order", F.col("reading_order") * 2 + F.col("sub")), parts.select(*PAGE, "id", "x0", "y0"))
    place = lambda origin: order.where(F.col("origin") == origin).select(*PAGE, "id", F.col("reading_order").alias("position"))
    shown = text.withColumn("id", F.col("block_id")).join(place("text"), [*PAGE, "id"]).select(*PAGE, "position", F.lit(0).alias("sub"), "kind", "level", "text", "ordered", "depth")
    placed = parts.join(place("media"), [*PAGE, "id"]).select(*PAGE, "position", F.lit(0).alias("sub"), "kind", F.lit(None).cast("int").alias("level"), "text", F.lit(None).cast("boolean").alias("ordered"), F.lit(None).cast("int").alias("depth"))
    rendered = render.page_markdown(shown.unionByName(placed))
    facts_ = facts.page_facts(blocks, pages)
    warned = media.warnings(facts_, formulas, facts.scan_like(facts_))
    out = {"blocks": text, "tables": found, "formulas": decided, "pages": rendered, "documents": render.document_markdown(rendered), "warnings": warned}
    return out if figures is None else out | {"figures": figures}
