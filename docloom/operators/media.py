"""Which images and figures of a page come out, and what a conversion warns of.

Everything is a join by page or file and a window over a page's media, of which there are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.geometry import area, box, media_fingerprint
from docloom.operators import spatial
from docloom.operators.facts import with_page

PAGE = ["doc_id", "page_num"]


def repeated_media(media: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, n_pages): media of one place and size on at least 2 pages of a file."""
    told = with_page(media, pages).select("doc_id", "page_num", media_fingerprint(box(), F.col("width"), F.col("height")).alias("fingerprint"))
    return told.groupBy("doc_id", "fingerprint").agg(F.count_distinct("page_num").alias("n_pages")).where("n_pages >= 2")


def kept_text(blocks: DataFrame, repeated: DataFrame) -> DataFrame:
    """Blocks but for edge text that an earlier page of the file has; ``repeated`` is ``facts.repeated_edge_text``."""
    first = repeated.select("doc_id", F.col("key").alias("_key"), F.col("first_page").alias("_first"))
    told = blocks.withColumn("_key", F.when(F.col("kind").isin("Heading", "Paragraph"), T.furniture_token(F.col("text"))))
    return told.join(first, ["doc_id", "_key"], "left").where(F.col("_first").isNull() | (F.col("page_num") <= F.col("_first"))).drop("_key", "_first")


def media_plan(media: DataFrame, blocks: DataFrame, pages: DataFrame, front: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_num, id, score, dropped, rank, kept): which media of a page come out.

    ``media`` has id, kind (Figure or Image), caption and box; ``blocks`` are the page's text as it comes
    out, with kind. ``front`` names scholarly first pages. Scores are whole numbers; captioned media
    outside the bottom band always have room.
    """
    text = blocks.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("_texts"), F.count_if((F.col("kind") == "Heading") & (F.size(T.words(F.col("text"))) <= 12)).alias("_heads"))
    near = spatial.near_captions(media, blocks.where("kind = 'Caption'"), pages, [*PAGE, "id"]).distinct().withColumn("_near", F.lit(True))
    again = repeated_media(media, pages).select("doc_id", F.col("fingerprint").alias("_print"), F.lit(True).alias("_again"))
    m = with_page(media, pages).withColumn("_print", media_fingerprint(box(), F.col("width"), F.col("height")))
    m = m.join(text, PAGE, "left").join(near, [*PAGE, "id"], "left").join(again, ["doc_id", "_print"], "left")
    m = m.join(front.select(*PAGE).distinct().withColumn("_front", F.lit(True)), PAGE, "left") if front is not None else m.withColumn("_front", F.lit(None).cast("boolean"))
    on_page = Window.partitionBy(*PAGE)
    m = m.withColumns({"_n": F.count(F.lit(1)).over(on_page), "_front": F.coalesce("_front", F.lit(False)), "_again": F.coalesce("_again", F.lit(False))})
    m = m.withColumn("captioned", F.coalesce(F.trim("caption") != "", F.lit(False)) | F.coalesce("_near", F.lit(False)))
    heavy = (F.col("_n") >= 6) | ((F.col("_n") >= 4) & (F.coalesce("_texts", F.lit(0)) <= 10)) | (F.coalesce("_heads", F.lit(0)) >= 4)
    m = m.withColumn("_heavy", heavy).withColumns(_measures())
    m = m.withColumns({"score": _score(), "dropped": _dropped()})
    m = m.withColumn("_sure", F.count_if(F.col("captioned") & ~F.col("_bottom") & ~F.col("dropped")).over(on_page))
    room = F.when(F.col("_front") | (F.col("_n") >= 10), 1).when(F.col("_heavy"), 2).when(F.col("_n") >= 4, 3).otherwise(F.col("_n"))
    rank = F.row_number().over(Window.partitionBy(*PAGE, "dropped").orderBy(F.desc("score"), "id"))
    return m.withColumn("rank", rank).select(*PAGE, "id", "score", "dropped", "rank", (~F.col("dropped") & (F.col("rank") <= F.greatest(room, F.col("_sure")))).alias("kept"))


def _measures() -> dict[str, Column]:
    """Shares and places of a medium on its page."""
    w, h = F.greatest("width", F.lit(1.0)), F.greatest("height", F.lit(1.0))
    share = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    part, wide, high = share(area(box()) / (w * h)), share((F.col("x1") - F.col("x0")) / w), share((F.col("y1") - F.col("y0")) / h)
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    aspect = F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)) / F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    low = F.col("y0") >= F.col("height") * F.lit(0.84)
    return {
        "_part": part, "_tiny": (part < F.lit(0.015)) | ((wide < F.lit(0.12)) & (high < F.lit(0.12))), "_bottom": low,
        "_edge": low | (F.col("y1") <= F.col("height") * F.lit(0.18)) | (F.col("x0") <= F.col("width") * F.lit(0.06)) | (F.col("x1") >= F.col("width") * F.lit(0.94)),
        "_long": (aspect >= F.lit(5.5)) | (aspect <= F.lit(0.22)), "_upper": y <= F.col("height") * F.lit(0.55),
        "_middle": (y > F.col("height") * F.lit(0.18)) & (y < F.col("height") * F.lit(0.82)) & (x > F.col("width") * F.lit(0.12)) & (x < F.col("width") * F.lit(0.88)),
    }


def _score() -> Column:
    """The points of a medium."""
    alone = ~F.col("captioned")
    #: Points by what holds.
    points = [
        (F.col("kind") == "Figure", 15), (F.col("captioned"), 55), (F.col("_part") >= F.lit(0.12), 20), (F.col("_middle"), 8), (F.col("_tiny"), -30), (F.col("_edge"), -20), (F.col("_again"), -30),
        (F.col("_long") & (F.col("_part") < F.lit(0.08)), -20), (F.col("_heavy") & alone, -12), (F.col("_front") & F.col("_upper") & alone, -55),
    ]
    total = F.round(F.col("_part") * 100).cast("int")
    for test, n in points:
        total = total + F.when(test, n).otherwise(0)
    return total


def _dropped() -> Column:
    """Media that never come out: without caption and small at an edge, repeated, or above a front page's text."""
    small = F.col("_tiny") & F.col("_edge")
    again = F.col("_again") & (F.col("_edge") | F.col("_front") | (F.col("_heavy") & (F.col("_part") < F.lit(0.06))))
    front = F.col("_front") & F.col("_upper") & (F.col("_part") < F.lit(0.16))
    return ~F.col("captioned") & (small | again | front)


def warnings(facts: DataFrame, formulas: DataFrame, scan_like: DataFrame, hybrid: bool = False, formula_mode: str = "auto", ocr_mode: str = "off") -> DataFrame:
    """(doc_id, warning, n, of, advice): pages without text, formula candidates nobody looked at, files that look scanned.

    ``facts`` are pages with n_blocks, ``scan_like`` the files with their counts.
    """
    pages = facts.groupBy("doc_id").agg(F.count_if(F.col("n_blocks") == 0).alias("n"), F.count(F.lit(1)).alias("of"))
    none = F.lit(None).cast("string")
    out = pages.where("n > 0").select("doc_id", F.lit("pages-without-text").alias("warning"), "n", "of", none.alias("advice"))
    if not hybrid and formula_mode in ("auto", "hybrid"):
        found = formulas.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(pages.select("doc_id", "of"), "doc_id")
        out = out.unionByName(found.select("doc_id", F.lit("formula-candidates").alias("warning"), "n", "of", F.lit("backend").alias("advice")))
    if not hybrid:
        scans = scan_like.where("likely_scan_like").select("doc_id", F.lit("scan-heavy").alias("warning"), F.col("low_density_pages").alias("n"), F.col("page_count").alias("of"), F.lit("ocr" if ocr_mode == "off" else "language").alias("advice"))
        out = out.unionByName(scans)
    return out


def density_warnings(quality: DataFrame, headings: float = 2.5, images: float = 10.0) -> DataFrame:
    """(doc_id, warning, per_page): rendered files with unusually many headings or images a page; ``quality`` is ``evaluate.markdown_quality``."""
    per = lambda c: F.col(c) / F.greatest("pages", F.lit(1))
    kinds = F.array(*[F.struct(F.lit(w).alias("warning"), F.round(per(c), 6).alias("per_page"), F.lit(most).alias("most")) for w, c, most in (("heading-density", "headings", headings), ("image-density", "images", images))])
    return quality.select("doc_id", F.explode(kinds).alias("k")).where("k.per_page > k.most").select("doc_id", "k.warning", "k.per_page")
