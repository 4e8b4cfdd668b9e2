"""Document and page facts: font sizes, heading base, furniture, repeated text, triage, inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import predicates as P
from docloom.functions import text as T
from docloom.functions.geometry import area, box
from docloom.operators.base import BLOCK_KEYS, HEIGHT, WIDTH
from docloom.session import written

#: Fixed values of the page tests.
MARGIN_SHARE, SIDE_SHARE, REPEAT_SHARE = 0.08, 0.10, 0.5
MIN_TEXT_AREA, REPLACEMENT_LIMIT, MATH_LIMIT = 0.02, 8, 4
TOP_BAND, BOTTOM_BAND = 0.18, 0.84
#: Added to the number of a block whose leading heading became a block of its own.
HEADING_ID = 1_400_000
#: Fixed pattern of characters that make a page mathematical.
MATH_CHARS = r"[^\x{03B1}-\x{03C9}\x{0391}-\x{03A9}\x{2100}-\x{214F}\x{2190}-\x{21FF}\x{2200}-\x{22FF}\x{27C0}-\x{27EF}\x{2A00}-\x{2AFF}]"


def body_font_size(blocks: DataFrame) -> DataFrame:
    """(doc_id, body_size): the most frequent font size in half points; the smallest of equally frequent ones."""
    sized = blocks.where("font_size > 0").groupBy("doc_id", F.round(F.col("font_size") * 2).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    best = sized.groupBy("doc_id").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"))
    return blocks.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce(F.col("bin") / 2, F.lit(10.0)).alias("body_size"))


def dominant_font_size(words: DataFrame) -> DataFrame:
    """(doc_id, page_num, block_id, font_size): the most frequent size of a block's words in tenths."""
    sized = words.groupBy(*BLOCK_KEYS, F.round("font_size", 1).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return sized.groupBy(*BLOCK_KEYS).agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("font_size"))


def heading_base(blocks: DataFrame) -> DataFrame:
    """(doc_id, base_level): 1 where a line is numbered without dot and separator, else 2."""
    undotted = F.exists(T.lines(F.col("text")), lambda x: x.rlike(r"^[0-9]+\s+\S") & x.rlike(P.NUMBERED))
    return blocks.groupBy("doc_id").agg(F.when(F.bool_or(undotted), 1).otherwise(2).alias("base_level"))


def page_sizes(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, width, height)."""
    return pages.groupBy("doc_id", "page_num").agg(F.max("width").alias("width"), F.max("height").alias("height"))


def with_page(df: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows with their page's size; a page without a report has the usual size.

    The sizes of a file's pages meet its rows as one map by doc_id, so rows that lie by file stay where they are.
    """
    entry = F.struct("page_num", F.struct("width", "height"))
    per = page_sizes(pages.where("page_num is not null")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_sizes"))
    joined = df.join(per.hint("shuffle_hash"), "doc_id", "left").withColumn("_size", F.try_element_at("_sizes", F.col("page_num")))
    return joined.withColumns({"width": F.coalesce("_size.width", F.lit(WIDTH)), "height": F.coalesce("_size.height", F.lit(HEIGHT))}).drop("_sizes", "_size")


def _union_box() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def margin_words(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Words in a margin of their page, with token, base and whether they stand in the top or bottom (``edge``) or a side margin (``side``).

    The test of the place comes first: only margin words get a token.
    """
    sized = with_page(words.select(*BLOCK_KEYS, "widx", "text", "font_size", "x0", "y0", "x1", "y1", "baseline_y"), pages)
    edge = (F.col("y0") < F.col("height") * F.lit(MARGIN_SHARE)) | (F.col("y1") > F.col("height") * F.lit(1 - MARGIN_SHARE))
    side = (F.col("x1") <= F.col("width") * F.lit(SIDE_SHARE)) | (F.col("x0") >= F.col("width") * F.lit(1 - SIDE_SHARE))
    placed = sized.where(edge | side).withColumns({"edge": edge, "side": side, "base": F.coalesce("baseline_y", "y1")})
    return placed.withColumn("token", T.furniture_token(F.col("text"))).drop("text", "baseline_y", "width", "height")


def _edge_lines(margin: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "page_num").orderBy("base", "x0", "block_id", "widx")
    tolerance = F.least(F.greatest(F.col("font_size") * F.lit(0.8), F.lit(3.0)), F.lit(10.0))
    inside = margin.where(F.col("edge") & (F.col("token") != ""))
    lined = inside.withColumn("new", F.when(F.col("base") - F.lag("base").over(w) <= tolerance, 0).otherwise(1)).withColumn("line", F.sum("new").over(w))
    tokens = F.array_sort(F.collect_list(F.struct("x0", "block_id", "widx", "token")))
    grouped = lined.groupBy("doc_id", "page_num", "line").agg(tokens.alias("ts"), *_union_box())
    return grouped.select("doc_id", "page_num", F.array_join(F.transform("ts", lambda t: t["token"]), " ").alias("signature"), "x0", "y0", "x1", "y1")


def _side_tokens(margin: DataFrame) -> DataFrame:
    return margin.where(F.col("side") & (F.octet_length("token") >= 4)).select("doc_id", "page_num", F.col("token").alias("signature"), "x0", "y0", "x1", "y1")


def margin_lines(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, signature, box): words in the top or bottom margin grouped by baseline.

    Words without baseline use the box's lower edge. Baselines within 0.8 of the font size (3 to
    10 points) of the line before belong to one line.
    """
    return _edge_lines(margin_words(words, pages))


def side_words(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, signature, box): words of at least 4 bytes in the left or right margin."""
    return _side_tokens(margin_words(words, pages))


def furniture(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, signature, box): margin text on at least half of a file's pages, and two.

    A file of one page has none. Margin text, a small part of the words, is found in one pass, written,
    and read to be counted and to be told; counts are per (file, signature) with map-side combining.
    """
    margin = margin_words(words, pages)
    found = written(_edge_lines(margin).unionByName(_side_tokens(margin)), "margins")
    n_pages = words.select("doc_id", "page_num").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages")).where("n_pages >= 2")
    seen = found.select("doc_id", "signature", "page_num").distinct().groupBy("doc_id", "signature").agg(F.count(F.lit(1)).alias("n"))
    often = seen.join(n_pages, "doc_id").where(F.col("n") >= F.greatest(F.ceil(F.col("n_pages") * F.lit(REPEAT_SHARE)), F.lit(2))).select("doc_id", "signature")
    return found.join(often, ["doc_id", "signature"], "left_semi").select("doc_id", "page_num", "signature", "x0", "y0", "x1", "y1")


def repeated_edge_text(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, key, n_pages, first_page): short text in the top or bottom band of at least 3 pages."""
    placed = with_page(blocks, pages).withColumn("key", T.furniture_token(F.col("text")))
    band = (F.col("y1") <= F.col("height") * F.lit(TOP_BAND)) | (F.col("y0") >= F.col("height") * F.lit(BOTTOM_BAND))
    kept = placed.where(band & (F.length("key") >= 4) & (F.octet_length("text") <= 120))
    return kept.groupBy("doc_id", "key").agg(F.count_distinct("page_num").alias("n_pages"), F.min("page_num").alias("first_page")).where("n_pages >= 3")


def page_facts(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per reported page: blocks, text area, readable, low density, image only, replacement and math characters."""
    per = blocks.groupBy("doc_id", "page_num").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.sum(area(box())).alias("text_area"),
        F.bool_or(T.trim(F.col("text")) != "").alias("readable"),
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))).alias("replacements"),
        F.sum(F.length(F.regexp_replace("text", MATH_CHARS, ""))).alias("math_chars"),
    )
    j = pages.select("doc_id", "page_num", "width", "height", "images").join(per, ["doc_id", "page_num"], "left")
    share = F.coalesce("text_area", F.lit(0.0)) / F.greatest(F.col("width") * F.col("height"), F.lit(1.0))
    readable = F.coalesce("readable", F.lit(False))
    return j.select(
        "doc_id", "page_num", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.round(share, 9).alias("text_area_fraction"), readable.alias("readable_text"),
        (~readable & (F.col("images") > 0)).alias("image_only"), ((F.coalesce("n_blocks", F.lit(0)) == 0) | (share < F.lit(MIN_TEXT_AREA))).alias("low_density"),
        F.coalesce("replacements", F.lit(0)).cast("bigint").alias("replacements"), F.coalesce("math_chars", F.lit(0)).cast("bigint").alias("math_chars"),
    )


def ocr_triage(facts: DataFrame) -> DataFrame:
    """(doc_id, totals, pages_needing_ocr): what a file's pages say about scanning."""
    needs = F.col("image_only") | (~F.col("readable_text") & F.col("low_density")) | (F.col("replacements") >= REPLACEMENT_LIMIT)
    listed = F.array_sort(F.collect_list(F.when(needs, F.col("page_num") + 1)))
    return facts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages_total"), F.count_if("readable_text").alias("pages_with_readable_text"), F.count_if("image_only").alias("image_only_pages"),
        F.count_if("low_density").alias("low_density_pages"), F.sum("replacements").alias("suspicious_replacement_chars"), listed.alias("pages_needing_ocr"),
    )


def scan_like(facts: DataFrame) -> DataFrame:
    """(doc_id, counts, likely_scan_like): all pages are images, or none is readable and one is of low density."""
    t = facts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"), F.count_if("readable_text").alias("readable_pages"), F.count_if("image_only").alias("image_only_pages"), F.count_if("low_density").alias("low_density_pages"))
    like = (F.col("page_count") > 0) & ((F.col("image_only_pages") == F.col("page_count")) | ((F.col("readable_pages") == 0) & (F.col("low_density_pages") > 0)))
    return t.withColumn("likely_scan_like", like)


def routed_pages(facts: DataFrame, cells: DataFrame, formulas: DataFrame) -> DataFrame:
    """(doc_id, page_num, has_table, has_formula, math_heavy, low_density): pages for an external backend.

    ``cells`` has a row for each block that is a table cell (``pagefolds.page_grid_cells``).
    """
    page = ["doc_id", "page_num"]
    has = lambda df, name: df.select(*page).distinct().withColumn(name, F.lit(True))
    j = facts.join(has(cells, "has_table"), page, "left").join(has(formulas, "has_formula"), page, "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    out = j.select(*page, flag("has_table"), flag("has_formula"), (F.col("math_chars") >= MATH_LIMIT).alias("math_heavy"), "low_density")
    return out.where("has_table or has_formula or math_heavy or low_density")


def search_hits(blocks: DataFrame, needle: str) -> DataFrame:
    """(doc_id, page, hit_count): pages that contain a phrase; case and white space ignored; 1-based pages."""
    low = F.lower(T.collapse(F.col("text")))
    wanted = " ".join(needle.lower().split())
    n = (F.length(low) - F.length(F.replace(low, F.lit(wanted), F.lit("")))) / len(wanted)
    hit = blocks.where(low.contains(wanted)).select("doc_id", (F.col("page_num") + 1).alias("page"), n.cast("bigint").alias("n"))
    return hit.groupBy("doc_id", "page").agg(F.sum("n").alias("hit_count"))


def search_boxes(blocks: DataFrame, needle: str) -> DataFrame:
    """(doc_id, page, block_id, box, hit_count): the blocks that contain a phrase, with their place."""
    low, wanted = F.lower(T.collapse(F.col("text"))), " ".join(needle.lower().split())
    n = (F.length(low) - F.length(F.replace(low, F.lit(wanted), F.lit("")))) / len(wanted)
    return blocks.where(low.contains(wanted)).select("doc_id", (F.col("page_num") + 1).alias("page"), "block_id", "x0", "y0", "x1", "y1", n.cast("bigint").alias("hit_count"))


def classified(blocks: DataFrame, pages: DataFrame, sizes: DataFrame, bases: DataFrame) -> DataFrame:
    """Blocks with kind, level, ordered and depth: one chain of tests, the first that holds decides.

    ``sizes`` and ``bases`` are one row per file (body font size, heading base).
    """
    return _judged(blocks, pages, sizes, bases).drop("body_size", "base_level")


def _judged(blocks: DataFrame, pages: DataFrame, sizes: DataFrame, bases: DataFrame) -> DataFrame:
    """The classified blocks with their file's body_size and base_level."""
    j = with_page(blocks, pages).join(sizes, "doc_id").join(bases, "doc_id")
    t, ratio = T.trim(F.col("text")), F.col("font_size") / F.greatest(F.col("body_size"), F.lit(0.1))
    level = P.numbered_heading_level(t, ratio, F.col("base_level"))
    number = P.is_page_number(t)
    chain = [
        (t == "", "Paragraph"),
        (P.in_header_zone(F.col("y1"), F.col("height")) & number, "PageNumber"),
        (P.in_header_zone(F.col("y1"), F.col("height")), "RunningHeader"),
        (P.in_footer_zone(F.col("y0"), F.col("height")) & number, "PageNumber"),
        (P.in_footer_zone(F.col("y0"), F.col("height")), "RunningFooter"),
        (number, "PageNumber"),
        (P.is_caption(t), "Caption"),
        (P.is_code(t), "CodeBlock"),
        (F.lower(t) == "abstract", "Heading"),
        (level.isNotNull(), "Heading"),
        (P.is_ordered_item(t) | P.is_unordered_item(t), "ListItem"),
        (P.is_scholarly(t), "Paragraph"),
        (ratio >= F.lit(1.15), "Heading"),
    ]
    kind = F.coalesce(*[F.when(c, k) for c, k in chain], F.lit("Paragraph"))
    head = F.when(F.lower(t) == "abstract", 2).when(level.isNotNull(), level).otherwise(P.size_level(ratio))
    k = j.withColumn("kind", kind)
    return k.select(
        *BLOCK_KEYS, "reading_order", "text", "x0", "y0", "x1", "y1", "font_size", "kind", F.when(F.col("kind") == "Heading", head).alias("level"),
        F.when(F.col("kind") == "ListItem", P.is_ordered_item(t)).alias("ordered"), F.when(F.col("kind") == "ListItem", P.indent_depth(F.col("x0"), F.col("width"))).alias("depth"), "body_size", "base_level",
    )


def headings_split(blocks: DataFrame, pages: DataFrame, sizes: DataFrame, bases: DataFrame) -> DataFrame:
    """The classified blocks with ``sub``; a block whose first line is a numbered heading gives that heading and its rest.

    The heading (sub 0) has the block's id plus HEADING_ID and 1.35 of the font size (8 points at
    least) as its height; the rest (sub 1) starts below it. Both keep the block's reading order.
    """
    j = _judged(blocks, pages, sizes, bases)
    lines = T.lines(F.coalesce("text", F.lit("")))
    first = F.coalesce(F.get(lines, 0), F.lit(""))
    level = P.numbered_heading_level(first, F.col("font_size") / F.greatest(F.col("body_size"), F.lit(0.1)), F.col("base_level"))
    j = j.withColumns({"_level": level, "_head": F.regexp_replace(T.collapse(first), r"[_^]\{([^}]*)\}?", "$1"), "_rest": F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n")})
    edge = F.least(F.col("y0") + F.greatest("font_size", F.lit(8.0)) * F.lit(1.35), F.col("y1"))
    both = F.col("_level").isNotNull() & (F.col("_rest") != "")
    j = j.withColumns({"_edge": edge, "sub": F.explode(F.when(both, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))})
    head, body = F.col("_level").isNotNull() & ((F.col("sub") == 0) | ~both), both & (F.col("sub") == 1)
    return j.withColumns({
        "block_id": F.when(F.col("sub") == 0, F.col("block_id") + HEADING_ID).otherwise(F.col("block_id")),
        "text": F.when(head, F.col("_head")).when(body, F.col("_rest")).otherwise(F.col("text")),
        "y0": F.when(body, F.col("_edge")).otherwise(F.col("y0")), "y1": F.when(F.col("sub") == 0, F.col("_edge")).otherwise(F.col("y1")),
        "kind": F.when(head, "Heading").when(body & (F.col("kind") == "Heading"), "Paragraph").otherwise(F.col("kind")),
        "level": F.when(head, F.col("_level")).when(~body, F.col("level")),
        "ordered": F.when(~head, F.col("ordered")), "depth": F.when(~head, F.col("depth")),
    }).drop("_level", "_head", "_rest", "_edge", "body_size", "base_level")


#: What structure roles make of a block.
ROLE_KINDS = {"artifact": "Artifact", "li": "ListItem", "lbody": "ListItem", "lbl": "ListItem", "caption": "Caption", "td": "TableCell", "th": "TableCell"}
ROLE_LEVELS = {"h1": 1, "title": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}


def tagged_blocks(classified_: DataFrame, tags: DataFrame, share: float = 0.5) -> DataFrame:
    """The classified blocks with the kind and level of the structure tag that covers most of them, where one says something.

    ``tags`` has role and box. Tags come before all other tests, so their kinds replace the others.
    """
    from docloom.operators import spatial

    role = spatial.best_overlap(classified_, tags, BLOCK_KEYS, "role", share)
    name = F.lower(F.regexp_replace(F.trim("role"), "^/+", ""))
    looked = lambda table: F.coalesce(*[F.when(name == k, v) for k, v in table.items()])
    j = classified_.join(role, BLOCK_KEYS, "left").withColumns({"_level": looked(ROLE_LEVELS), "_kind": looked(ROLE_KINDS)})
    told = F.coalesce(F.col("_kind"), F.when(F.col("_level").isNotNull(), "Heading"))
    item = told == "ListItem"
    return j.withColumns({
        "kind": F.coalesce(told, F.col("kind")), "level": F.when(told.isNull(), F.col("level")).otherwise(F.col("_level")),
        "ordered": F.when(told.isNull(), F.col("ordered")).when(item, F.lit(False)), "depth": F.when(told.isNull() | item, F.col("depth")),
    }).drop("role", "_level", "_kind")


def density_ratio(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, density): text area over the area of the region that holds it, at most 1."""
    per = blocks.groupBy("doc_id", "page_num").agg(F.sum(area(box())).alias("inked"), *_union_box())
    region = area(box())
    return per.select("doc_id", "page_num", F.round(F.when(region > 0, F.least(F.col("inked") / region, F.lit(1.0))).otherwise(F.lit(0.0)), 9).alias("density"))
