"""Blocks to Markdown: one text per block, then one ordered concatenation per page and per document.

All in the JVM. A document's text is gathered by doc_id, the unit of the result, so its size is the
document's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

PAGE = ["doc_id", "page_num"]
HIDDEN = ("PageNumber", "RunningHeader", "RunningFooter", "Artifact")


def gfm_table(rows: Column) -> Column:
    """An array of rows of cells as a pipe table with its first row as header; two columns of labels as a list.

    Rows are filled up to the widest one and cells escaped.
    """
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))), T.table_cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width.cast("int")))
    grid = F.concat_ws("\n", line(F.coalesce(F.get(rows, 0), F.array().cast("array<string>"))), rule, F.array_join(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)).cast("int")), line), "\n"))
    return F.when(F.size(rows) > 0, F.regexp_replace(grid, r"\n$", ""))


def key_values(rows: Column) -> Column:
    """Rows of a label and a value as list lines."""
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("- "), T.field_label(F.coalesce(F.get(r, 0), F.lit(""))), F.lit(": "), T.trim(F.coalesce(F.get(r, 1), F.lit(""))))), "\n")


def block_markdown(kind: Column, level: Column, text: Column, ordered: Column, depth: Column, number: Column) -> Column:
    """The Markdown of one block without its trailing blank line; null for what is never shown."""
    t = T.trim(text)
    item = T.paragraph_text(F.regexp_replace(T.strip_list_number(t), r"^[•·▪▸►\-*]\s+", ""))
    indent = F.repeat(F.lit("  "), F.coalesce(depth, F.lit(0)).cast("int"))
    return (
        F.when(kind.isin(*HIDDEN) | (t == ""), None)
        .when(kind == "Heading", F.concat(F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(6)).cast("int")), F.lit(" "), T.section_label_spacing(T.collapse(t))))
        .when(kind == "ListItem", F.concat(indent, F.when(ordered, F.concat(number.cast("string"), F.lit("."))).otherwise("-"), F.lit(" "), item))
        .when(kind == "Caption", F.concat(F.lit("*"), t, F.lit("*")))
        .when(kind == "CodeBlock", F.concat(F.lit("```\n"), t, F.lit("\n```")))
        .when(kind == "Formula", F.concat(F.lit("$$ "), t, F.lit(" $$")))
        .when(kind.isin("Table", "Figure"), t)
        .otherwise(T.paragraph_text(t))
    )


def page_markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_num, markdown): the blocks of each page in order under the page's marker.

    Neighbouring list items form a run; ordered ones are numbered within run and depth. ``blocks``
    has kind, level, text, ordered, depth, position and sub (order among equal positions).
    """
    w = Window.partitionBy(*PAGE).orderBy("position", "sub")
    item = F.col("kind") == "ListItem"
    b = blocks.withColumn("_starts", F.when(item & (F.lag("kind").over(w) == "ListItem"), 0).otherwise(1)).withColumn("_run", F.sum("_starts").over(w))
    number = F.row_number().over(Window.partitionBy(*PAGE, "_run", "ordered", "depth").orderBy("position", "sub"))
    b = b.withColumn("number", number).withColumn("_last", F.lead("kind").over(w))
    md = block_markdown(F.col("kind"), F.col("level"), F.col("text"), F.col("ordered"), F.col("depth"), F.col("number"))
    gap = F.when(item & (F.col("_last") == "ListItem"), "\n").otherwise("\n\n")
    parts = F.array_sort(F.collect_list(F.when(md.isNotNull(), F.struct("position", "sub", F.concat(md, gap).alias("md")))))
    pages = b.groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda p: p["md"]), "").alias("body"))
    return pages.select(*PAGE, F.concat(F.format_string("<!-- page:%d -->\n\n", F.col("page_num") + 1), F.col("body")).alias("markdown"))


def document_markdown(pages: DataFrame) -> DataFrame:
    """(doc_id, markdown): pages in order."""
    parts = F.array_sort(F.collect_list(F.struct("page_num", "markdown")))
    return pages.groupBy("doc_id").agg(T.trim(F.array_join(F.transform(parts, lambda p: p["markdown"]), "")).alias("markdown"))


def without_markers(markdown: Column) -> Column:
    """Markdown as it is written to a file: page markers dropped, blank lines thinned."""
    bare = F.regexp_replace(markdown, r"(?m)^<!-- page:[0-9]+ -->\n?", "")
    return T.trim(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def front_matter(classified: DataFrame) -> DataFrame:
    """(doc_id, position, role): roles of first-page blocks: title, author, affiliation, abstract, note, body.

    The title is the first heading; what stands between it and the abstract or first section are
    authors and affiliations.
    """
    from docloom.functions import predicates as P

    first = classified.where((F.col("page_num") == 0) & ~F.col("kind").isin(*HIDDEN))
    w = Window.partitionBy("doc_id").orderBy("reading_order", "block_id")
    t = T.trim(F.col("text"))
    p = first.withColumn("position", F.row_number().over(w) - 1)
    title = F.min(F.when(F.col("kind") == "Heading", F.col("position"))).over(Window.partitionBy("doc_id"))
    starts = F.min(F.when(F.lower(t).startswith("abstract") | P.is_main_section(t), F.col("position"))).over(Window.partitionBy("doc_id"))
    p = p.withColumns({"_title": title, "_start": starts})
    between = (F.col("position") > F.col("_title")) & (F.col("position") < F.coalesce("_start", F.col("_title") + 3))
    role = (
        F.when(F.col("position") == F.col("_title"), "title").when(F.lower(t).startswith("abstract"), "abstract").when(P.is_scholarly(t), "note")
        .when(between & P.is_affiliation(t), "affiliation").when(between & P.is_author_line(t), "author").otherwise("body")
    )
    return p.select("doc_id", "block_id", "position", role.alias("role"))


def scholarly_pages(classified: DataFrame, within: int = 16) -> DataFrame:
    """(doc_id, page_num, blocks, abstract_at, metadata): first pages of papers.

    A first page of 3 blocks or more counts with a block that is or begins the abstract (the first gives
    ``abstract_at``) or with metadata lines among its first blocks.
    """
    from docloom.functions import predicates as P

    first = classified.where((F.col("page_num") == 0) & ~F.col("kind").isin(*HIDDEN))
    t = T.trim(F.col("text"))
    p = first.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("reading_order", "block_id")) - 1)
    starts = (F.lower(t) == "abstract") | T.abstract_text(t).isNotNull()
    per = p.groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("blocks"), F.min(F.when(starts, F.col("position"))).alias("abstract_at"), F.count_if(P.is_scholarly(t) & (F.col("position") < within)).alias("metadata"))
    return per.where("blocks >= 3 and (abstract_at is not null or metadata > 0)")
