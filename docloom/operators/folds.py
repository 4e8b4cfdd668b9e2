"""Ordered folds as windows: gaps, runs, sections, list numbers, words from glyph runs, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import predicates as P
from docloom.functions import text as T
from docloom.operators import policy

PAGE = ["doc_id", "page_num"]


def largest_gap(blocks: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(doc_id, page_num, gap, cut): the widest horizontal gap between blocks of a page, the upper one of equals."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "block_id").rowsBetween(Window.unboundedPreceding, -1)
    gaps = blocks.withColumn("above", F.max("y1").over(w)).where(F.col("y0") - F.col("above") > F.lit(tolerance))
    gap = F.round(F.col("y0") - F.col("above"), 6)
    best = gaps.groupBy(*PAGE).agg(F.max_by(F.struct(gap.alias("gap"), F.round((F.col("y0") + F.col("above")) / 2, 6).alias("cut")), F.struct(gap, -F.col("y0"))).alias("b"))
    return best.select(*PAGE, "b.gap", "b.cut")


def word_builder(words: DataFrame, share: float = 0.55) -> DataFrame:
    """(doc_id, page_num, block_id, line_id, word_no, text, x0, x1): neighbours closer than a share of the font size joined."""
    line = [*PAGE, "block_id", "line_id"]
    w = Window.partitionBy(*line).orderBy("x0", "widx")
    apart = F.col("x0") - F.lag("x1").over(w) > F.lit(share) * F.greatest(F.col("font_size"), F.lag("font_size").over(w))
    built = words.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("word_no", F.sum("new").over(w))
    parts = F.array_sort(F.collect_list(F.struct("x0", "widx", "text")))
    return built.groupBy(*line, "word_no").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def baseline_rows(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Words with ``row``: the number of their baseline group on the page; a new one beyond the tolerance."""
    base = F.coalesce("baseline_y", "y1")
    w = Window.partitionBy(*PAGE).orderBy(base, "x0", "block_id", "widx")
    new = F.coalesce(base - F.lag(base).over(w) > F.lit(tolerance), F.lit(True)).cast("int")
    return words.withColumn("base", base).withColumn("_new", new).withColumn("row", F.sum("_new").over(w)).drop("_new")


def row_width_mode(words: DataFrame) -> DataFrame:
    """(doc_id, page_num, columns, hits, rows): the most frequent number of words in a row of 2 or more; the larger of equals."""
    rows = baseline_rows(words).groupBy(*PAGE, "row").agg(F.count(F.lit(1)).alias("n"))
    counted = rows.where("n >= 2").groupBy(*PAGE, "n").agg(F.count(F.lit(1)).alias("hits"))
    best = counted.groupBy(*PAGE).agg(F.max(F.struct("hits", "n")).alias("b"), F.sum("hits").alias("rows"))
    return best.select(*PAGE, F.col("b.n").alias("columns"), F.col("b.hits").alias("hits"), "rows")


def column_centres(words: DataFrame) -> DataFrame:
    """(doc_id, page_num, ordinal, centre, n): mean centre of the k-th word over rows of the modal width."""
    w = Window.partitionBy(*PAGE, "row").orderBy("x0", "block_id", "widx")
    placed = baseline_rows(words).withColumn("ordinal", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "row")))
    modal = row_width_mode(words).select(*PAGE, F.col("columns").alias("n"))
    return placed.join(modal, [*PAGE, "n"]).groupBy(*PAGE, "ordinal").agg(F.round(F.avg((F.col("x0") + F.col("x1")) / 2), 6).alias("centre"), F.count(F.lit(1)).alias("n"))


def table_evidence(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, rows, row_consistency, column_alignment, numeric_density, prose_penalty, score): how much a page's rows look like a table.

    The rows of a page are scored as one candidate of aligned text: alignment leans on the modal width of
    the rows and on the widest row's share of the page, and is at most 0.68 where rows differ.
    """
    value = P.is_value_token(F.col("text")).cast("int")
    w = baseline_rows(words).withColumn("value", value)
    rows = w.groupBy(*PAGE, "row").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("values"), (F.max("x1") - F.min("x0")).alias("wide"),
        F.bool_or(F.lower("text").isin(*P.STOPWORDS)).alias("stop"),
    )
    prose = (F.col("n") >= 6) & F.col("stop") & (F.col("values") == 0)
    per = rows.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("words"), F.sum("values").alias("values"), F.max("wide").alias("wide"), F.count_if(prose).alias("prose"))
    counted = rows.groupBy(*PAGE, "n").agg(F.count(F.lit(1)).alias("hits")).groupBy(*PAGE).agg(F.max(F.struct("hits", "n")).alias("m"))
    size = pages.groupBy(*PAGE).agg(F.max("width").alias("width"))
    j = per.join(counted.select(*PAGE, "m.hits", F.col("m.n").alias("columns")), PAGE).join(size, PAGE, "left")
    consistency = F.col("hits") / F.col("rows")
    reach = F.least(F.col("wide") / F.greatest(F.coalesce("width", F.lit(612.0)), F.lit(1.0)), F.lit(1.0))
    alignment = consistency * F.lit(0.70) + reach * F.lit(0.30) + F.when(F.col("columns") >= 6, F.lit(0.05)).otherwise(F.lit(0.0))
    alignment = F.least(alignment, F.when(F.col("hits") < F.col("rows"), F.lit(0.68)).otherwise(F.lit(1.0)))
    features = j.select(
        *PAGE, "rows", consistency.alias("row_consistency"), F.greatest(alignment, F.lit(0.0)).alias("column_alignment"), (F.col("values") / F.col("words")).alias("numeric_density"),
        (F.col("prose") / F.col("rows") * F.lit(0.25)).alias("prose_penalty"), F.lit("TextAlignment").alias("source"), F.lit(0.0).alias("caption_score"), F.lit(0.0).alias("broad_page_penalty"),
    )
    scored = policy.evidence_score(features)
    return scored.select(*PAGE, "rows", *[F.round(c, 9).alias(c) for c in ("row_consistency", "column_alignment", "numeric_density", "prose_penalty", "score")])


def upper_median_font(words: DataFrame) -> DataFrame:
    """(doc_id, page_num, font_size): the upper median of the words' sizes, at least 1."""
    sizes = F.sort_array(F.collect_list("font_size"))
    return words.groupBy(*PAGE).agg(F.greatest(F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")), F.lit(1.0)).alias("font_size"))


def adaptive_tolerance(words: DataFrame) -> DataFrame:
    """(doc_id, page_num, tolerance): the 70 % gap between sorted x positions over 5 points, in 25 to 50; 35 with under 3 gaps."""
    xs = F.array_sort(F.collect_list("x0"))
    per = words.groupBy(*PAGE).agg(xs.alias("xs"))
    gaps = F.expr("array_sort(filter(transform(sequence(2, greatest(size(xs), 2)), i -> try_element_at(xs, greatest(least(i, size(xs)), 1)) - try_element_at(xs, i - 1)), g -> g > 5))")
    at = F.least(F.floor(F.size("gaps") * F.lit(0.7)), F.size("gaps") - 1).cast("int")
    picked = F.when(F.size("gaps") >= 3, F.least(F.greatest(F.get("gaps", at), F.lit(25.0)), F.lit(50.0))).otherwise(F.lit(35.0))
    return per.withColumn("gaps", gaps).select(*PAGE, F.round(picked, 6).alias("tolerance"))


def data_runs(lines: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """keys + (first_line, n_lines): runs of at least 3 neighbouring lines that are data rows."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    rows = lines.where(P.is_data_row(T.words(F.col("line")))).withColumn("island", F.col("line_no") - F.row_number().over(w))
    return rows.groupBy(*keys, "island").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines")).where(F.col("n_lines") >= least).drop("island")


def sections(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, section_no, title, level, content, page_start, page_end) of Markdown lines.

    Page markers set the page, a heading starts a section; text before the first heading is the
    section ``Document`` when it isn't blank. The last section ends on the document's last page.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumns({"marker": T.page_marker(F.col("line")), "level": T.heading_level(F.col("line")), "title": T.heading_title(F.col("line"))})
    x = x.withColumn("page", F.coalesce(F.last("marker", ignorenulls=True).over(upto), F.lit(1))).withColumn("section_no", F.count("level").over(upto))
    body = F.when(F.col("marker").isNull() & F.col("level").isNull(), F.struct("line_no", "line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda s: s["line"]), "\n")
    grouped = x.groupBy("doc_id", "section_no").agg(
        F.max("title").alias("title"), F.max("level").alias("level"), T.trim(text).alias("content"), F.min_by("page", "line_no").alias("page_start"), F.max("page").alias("last_page"),
    )
    kept = grouped.where("title is not null or content <> ''")
    after = F.lead("page_start").over(Window.partitionBy("doc_id").orderBy("section_no"))
    out = kept.withColumn("page_end", F.coalesce(after, F.col("last_page")))
    return out.select("doc_id", F.col("section_no").cast("bigint").alias("section_no"), F.coalesce("title", F.lit("Document")).alias("title"), F.coalesce("level", F.lit(1)).alias("level"), "content", "page_start", "page_end")


def list_numbering(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, run, ordered, depth, number): list items in runs of neighbouring items, ordered ones numbered by depth within the run.

    The depth of a line is its indent: two blanks or a tab a level.
    """
    item = P.is_ordered_item(F.col("line")) | P.is_unordered_item(F.col("line"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    indent = F.length(F.replace(F.regexp_extract("line", r"^([ \t]*)", 1), F.lit("\t"), F.lit("  ")))
    rows = lines.where(item).withColumn("island", F.col("line_no") - F.row_number().over(w)).withColumns({"ordered": P.is_ordered_item(F.col("line")), "depth": F.floor(indent / 2).cast("int")})
    first = F.min("line_no").over(Window.partitionBy("doc_id", "island"))
    number = F.when(F.col("ordered"), F.row_number().over(Window.partitionBy("doc_id", "island", "ordered", "depth").orderBy("line_no")))
    return rows.select("doc_id", "line_no", first.alias("run"), "ordered", "depth", number.alias("number"))


def adjacent_distinct(lines: DataFrame) -> DataFrame:
    """Lines that differ from the line before."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.withColumn("_last", F.lag("line").over(w)).where(~F.col("line").eqNullSafe(F.col("_last"))).drop("_last")


def merged_paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, paragraph, n_blocks, text): neighbouring prose lines joined as clean-style paragraphs.

    A hyphen at the end of a line that is continued is closed up. Fences and what they enclose are no prose.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    fence = T.trim(F.col("line")).startswith("```")
    fenced = F.count_if(fence).over(w.rowsBetween(Window.unboundedPreceding, -1)) % 2 == 1
    kept = lines.withColumn("_fenced", fence | fenced).where((T.trim(F.col("line")) != "") & ~P.is_structural(F.col("line")) & ~F.col("_fenced")).drop("_fenced")
    joins = (F.lag("line_no").over(w) == F.col("line_no") - 1) & P.merges_with_previous(F.lag("line").over(w), F.col("line"))
    marked = kept.withColumn("new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("paragraph", F.sum("new").over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: T.trim(s["line"]))
    text = F.regexp_replace(F.array_join(parts, "\n"), r"-\n", "")
    return marked.groupBy("doc_id", "paragraph").agg(F.count(F.lit(1)).alias("n_blocks"), F.replace(text, F.lit("\n"), F.lit(" ")).alias("text"))


def grid_pivot(cells: DataFrame) -> DataFrame:
    """(doc_id, page_num, row, cells): the texts of a page's rows in column order."""
    ordered = F.array_sort(F.collect_list(F.struct("x0", "block_id", "widx", "text")))
    rows = baseline_rows(cells).groupBy(*PAGE, "row").agg(ordered.alias("c"))
    return rows.select(*PAGE, F.col("row").cast("bigint").alias("row"), F.array_join(F.transform("c", lambda x: T.table_cell(x["text"])), " | ").alias("cells"))


def title_candidates(classified: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, block_id, score): the likeliest title on the first page by size, place and wording; the first of equals."""
    t = T.trim(F.col("text"))
    page0 = classified.where("page_num = 0").join(pages.where("page_num = 0").select("doc_id", "height"), "doc_id", "left").withColumn("height", F.coalesce("height", F.lit(792.0)))
    barred = F.col("kind").isin("PageNumber", "RunningHeader", "RunningFooter") | P.is_scholarly(t) | P.is_main_section(t) | P.is_affiliation(t) | F.lower(t).startswith("abstract")
    ok = page0.where((t != "") & (F.col("y0") <= F.col("height") * F.lit(0.38)) & ~barred & ((F.size(T.words(t)) >= 3) | (F.octet_length(t) >= 24)))
    score = (
        F.col("font_size") * 6 - F.col("y0") * F.lit(0.03) + F.when(F.col("kind") == "Heading", 20).otherwise(0) + F.when(P.has_title_stopword(t), 6).otherwise(0)
        - F.when(F.octet_length(t) > 140, 8).otherwise(0) - F.when(F.length(F.regexp_replace(t, "[^0-9]", "")) > 8, 12).otherwise(0)
    )
    best = ok.withColumn("score", F.round(score, 6)).groupBy("doc_id").agg(F.max_by(F.struct("block_id", "score"), F.struct("score", -F.col("reading_order"), -F.col("block_id"))).alias("b"))
    return best.select("doc_id", "b.block_id", "b.score")


def top_per_page(items: DataFrame, keys: list[str], score: str, k: int) -> DataFrame:
    """The k highest-scored items of each page; smaller keys first among equals."""
    w = Window.partitionBy(*PAGE).orderBy(F.desc(score), *keys)
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def implicit_tables(blocks: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, page_num, first_order, n_rows, n_values, rows): runs of blocks that read as label and numbers.

    Rows with another number of values than the run's most frequent one (the larger of equals) are
    left out; a run needs 3 rows that stay.
    """
    w = Window.partitionBy(*PAGE).orderBy("reading_order", "block_id")
    row = T.numeric_row(F.col("text"))
    numbered = blocks.withColumn("_n", F.row_number().over(w)).withColumn("r", row).where("r is not null and size(r.values) > 0").withColumn("v", F.size("r.values"))
    runs = numbered.withColumn("island", F.col("_n") - F.row_number().over(w))
    keys = [*PAGE, "island"]
    mode = runs.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("hits")).groupBy(*keys).agg(F.max(F.struct("hits", "v")).alias("m")).select(*keys, F.col("m.v").alias("v"))
    kept = runs.join(mode, [*keys, "v"]).groupBy(*keys, "v").agg(
        F.min("reading_order").alias("first_order"), F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_list(F.struct("reading_order", "block_id", "r"))).alias("rs")
    )
    line = lambda x: F.concat(x["r"]["label"], F.lit("|"), F.array_join(x["r"]["values"], "|"))
    return kept.where(F.col("n_rows") >= least).select(*PAGE, "first_order", "n_rows", F.col("v").alias("n_values"), F.array_join(F.transform("rs", line), "\n").alias("rows"))


def text_runs(blocks: DataFrame, limit: int = 18) -> DataFrame:
    """Keys + run_length: how many paragraphs and list items follow from each such block on, itself included, up to a limit."""
    w = Window.partitionBy(*PAGE).orderBy("reading_order", "block_id")
    numbered = blocks.withColumn("_n", F.row_number().over(w)).where(F.col("kind").isin("Paragraph", "ListItem"))
    island = numbered.withColumn("_island", F.col("_n") - F.row_number().over(w))
    left = F.max("_n").over(Window.partitionBy(*PAGE, "_island")) - F.col("_n") + 1
    return island.select(*PAGE, "block_id", F.least(left, F.lit(limit)).alias("run_length"))


def form_fields(lines: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """keys + (line_no, label, value): labels with a colon and their value, inline or on the next line, in runs of 3."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    label = F.regexp_extract("line", "^([^:]*:)", 1)
    inline = T.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1))
    following = T.trim(F.lead("line").over(w))
    value = F.when(inline != "", F.when((F.octet_length(inline) <= 60) & ~inline.contains("."), inline)).when(P.is_choice_line(following), F.array_join(T.words(following), " | ")).when(P.is_field_value(following), following)
    found = lines.withColumns({"label": label, "value": value}).where(P.is_field_label(F.col("label")) & F.col("value").isNotNull())
    near = found.withColumn("new", F.coalesce(F.col("line_no") - F.lag("line_no").over(w) > 2, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "run"))
    return near.withColumn("size", size).where(F.col("size") >= least).select(*keys, "line_no", T.field_label(F.col("label")).alias("label"), "value")


def merged_rules(rules: DataFrame, across: float = 1.5, along: float = 2.0) -> DataFrame:
    """(doc_id, page_num, orientation, pos, lo, hi): ruling segments joined that lie in one line and touch.

    ``rules`` has orientation, pos, lo, hi and thickness; positions are weighted by thickness.
    """
    side = [*PAGE, "orientation"]
    w = Window.partitionBy(*side).orderBy("pos", "lo", "hi")
    banded = rules.withColumn("_n", F.coalesce(F.col("pos") - F.lag("pos").over(w) > F.lit(across), F.lit(True)).cast("int")).withColumn("band", F.sum("_n").over(w))
    v = Window.partitionBy(*side, "band").orderBy("lo", "hi", "pos")
    reach = F.max("hi").over(v.rowsBetween(Window.unboundedPreceding, -1))
    parted = banded.withColumn("_m", F.coalesce(F.col("lo") - reach > F.lit(along), F.lit(True)).cast("int")).withColumn("part", F.sum("_m").over(v))
    weight = F.greatest("thickness", F.lit(0.1))
    return parted.groupBy(*side, "band", "part").agg((F.sum(F.col("pos") * weight) / F.sum(weight)).alias("pos"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("band", "part")
