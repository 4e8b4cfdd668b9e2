"""Joins by page and bounding box. Every join is an equi-join on the page with a residual test.

Catalyst plans them as hash or sort-merge joins on (doc_id, page_num); a page holds a bounded number
of boxes, so no key gets hot and nothing is compared across pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G

PAGE = ["doc_id", "page_num"]


def _right(regions: DataFrame, *carried: str) -> DataFrame:
    """Regions with their columns renamed for a join."""
    return regions.select(*[F.col(k).alias(f"r_{k}") for k in (*PAGE, "x0", "y0", "x1", "y1", *carried)])


def _on(test: Column) -> Column:
    return (F.col("doc_id") == F.col("r_doc_id")) & (F.col("page_num") == F.col("r_page_num")) & test


def outside(items: DataFrame, regions: DataFrame, share: float = 0.55, of: str = "first") -> DataFrame:
    """Items that no region covers by more than a share of the item (``first``) or of the smaller box."""
    ratio = {"first": G.overlap_of_first, "smaller": G.overlap_of_smaller}[of]
    return items.join(_right(regions), _on(ratio(G.box(), G.box("r_")) > F.lit(share)), "left_anti")


def outside_tables(blocks: DataFrame, tables: DataFrame, share: float = 0.55) -> DataFrame:
    """Blocks that aren't headings and belong to a table, by id or by overlap, are dropped.

    ``tables`` has source_block_ids besides its box.
    """
    claimed = F.array_contains("r_source_block_ids", F.col("block_id")) | (G.overlap_of_first(G.box(), G.box("r_")) > F.lit(share))
    return blocks.join(_right(tables, "source_block_ids"), _on((F.col("kind") != "Heading") & claimed), "left_anti")


def reindexed(formulas: DataFrame, tables: DataFrame, confidence: float = 0.7, share: float = 0.55) -> DataFrame:
    """Formulas outside confident tables, numbered anew within their page."""
    kept = outside(formulas, tables.where(F.col("confidence") >= F.lit(confidence)), share)
    w = Window.partitionBy(*PAGE).orderBy("formula_index")
    return kept.withColumn("formula_index", (F.row_number().over(w) - 1).cast("bigint"))


def best_overlap(items: DataFrame, regions: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """keys + (value): of each item the region that covers most of its smaller box, beyond a least share.

    Equal shares go to the smaller region, then to the smaller value.
    """
    ratio = G.overlap_of_smaller(G.box(), G.box("r_"))
    hit = items.join(_right(regions, value), _on(ratio > F.lit(least)))
    rank = F.struct(F.round(ratio, 9), -F.round(G.area(G.box("r_")), 6))
    best = hit.groupBy(*keys).agg(F.max(rank).alias("rank"))
    ties = hit.withColumn("rank", rank).join(best, [*keys, "rank"]).groupBy(*keys).agg(F.min(f"r_{value}").alias(value))
    return items.select(*keys).join(ties, keys, "left")


def overlap_area(items: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (covered): the summed area that regions cover of each item, 0 where none does."""
    both = G.intersection(G.box(), G.box("r_"))
    hit = items.join(_right(regions), _on(both > 0)).groupBy(*keys).agg(F.round(F.sum(both), 6).alias("covered"))
    return items.select(*keys).join(hit, keys, "left").fillna(0.0, ["covered"])


def near_captions(media: DataFrame, captions: DataFrame, pages: DataFrame, keys: list[str], share: float = 0.06) -> DataFrame:
    """Media that share x with a caption at most a share of the page height above or below."""
    gap = F.greatest(F.col("r_y0") - F.col("y1"), F.col("y0") - F.col("r_y1"), F.lit(0.0))
    aside = G.overlap_1d(F.col("x0"), F.col("x1"), F.col("r_x0"), F.col("r_x1")) > 0
    sized = media.join(pages.select(*PAGE, "height"), PAGE, "left").withColumn("height", F.coalesce("height", F.lit(792.0)))
    return sized.join(_right(captions), _on(aside & (gap <= F.col("height") * F.lit(share))), "left_semi").select(*keys)


def iou_pairs(regions: DataFrame, keys: list[str], index: str, least: float = 0.5) -> DataFrame:
    """keys + (left_idx, right_idx, iou): pairs of regions of one page with enough intersection over union."""
    right = regions.select(*[F.col(k).alias(f"r_{k}") for k in (*keys, index, "x0", "y0", "x1", "y1")])
    same = [F.col(k) == F.col(f"r_{k}") for k in keys]
    ratio = G.iou(G.box(), G.box("r_"))
    test = (F.col(index) < F.col(f"r_{index}")) & (ratio >= F.lit(least))
    for s in same:
        test = s & test
    return regions.join(right, test).select(*keys, F.col(index).alias("left_idx"), F.col(f"r_{index}").alias("right_idx"), F.round(ratio, 9).alias("iou"))


def nearest(items: DataFrame, centres: list[float], x: str = "x0", limit: float = 40.0) -> DataFrame:
    """Items with the column whose centre is nearest, none beyond the limit; the left one of equally near."""
    rank = F.array(*[F.struct(F.abs(F.col(x) - F.lit(c)).alias("d"), F.lit(k).alias("column")) for k, c in enumerate(centres)])
    best = F.array_min(rank)
    return items.withColumn("column", F.when(best["d"] <= F.lit(limit), best["column"]))


def column_interval(items: DataFrame, starts: list[float], x: str = "x0", slack: float = 20.0) -> DataFrame:
    """Items with the interval they fall in: the last start that isn't more than the slack to their right."""
    passed = [F.when(F.col(x) >= F.lit(s - slack), 1).otherwise(0) for s in starts[1:]]
    return items.withColumn("column", sum(passed[1:], passed[0]) if passed else F.lit(0))


def merged_order(text: DataFrame, media: DataFrame) -> DataFrame:
    """(doc_id, page_num, origin, id, reading_order): media put before the first text block further down.

    ``text`` has block_id, reading_order and y0; ``media`` has id, x0 and y0. Equal to merging both
    in order: a media item's place is the least reading order of text with a larger y0.
    """
    t = text.select(*PAGE, F.col("block_id").alias("id"), "reading_order", "y0")
    after = media.join(t.select(*[F.col(k).alias(f"t_{k}") for k in (*PAGE, "reading_order", "y0")]), (F.col("doc_id") == F.col("t_doc_id")) & (F.col("page_num") == F.col("t_page_num")) & (F.col("y0") < F.col("t_y0")), "left")
    place = after.groupBy(*PAGE, "id", "x0", "y0").agg(F.min("t_reading_order").alias("pos"))
    both = place.select(*PAGE, F.lit("media").alias("origin"), "id", F.coalesce("pos", F.lit(2**62)).alias("pos"), F.lit(0).alias("rank"), "y0", "x0")
    both = both.unionByName(t.select(*PAGE, F.lit("text").alias("origin"), "id", F.col("reading_order").cast("bigint").alias("pos"), F.lit(1).alias("rank"), "y0", F.lit(0.0).alias("x0")))
    w = Window.partitionBy(*PAGE).orderBy("pos", "rank", "y0", "x0", "id")
    return both.select(*PAGE, "origin", "id", (F.row_number().over(w) - 1).cast("bigint").alias("reading_order"))
