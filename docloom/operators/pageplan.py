"""Page operations as plans over (doc_id, page_count): which output page comes from which input page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.session import written

#: Paper sizes in points.
PAPERS = {"a4": (595.0, 842.0), "letter": (612.0, 792.0)}


def _every() -> Column:
    return F.sequence(F.lit(1).cast("bigint"), F.col("page_count"))


def _selected(spec: str) -> Column:
    return T.page_selection(F.lit(spec), F.col("page_count"))


def extract(docs: DataFrame, spec: str) -> DataFrame:
    """(doc_id, out_page, page): selected pages in source order; files for which the selection is invalid give none."""
    picked = F.array_sort(_selected(spec))
    return docs.where("page_count > 0").select("doc_id", F.posexplode(picked).alias("out_page", "page"))


def reorder(docs: DataFrame, spec: str) -> DataFrame:
    """(doc_id, out_page, page): selected pages in the order of the selection."""
    return docs.where("page_count > 0").select("doc_id", F.posexplode(_selected(spec)).alias("out_page", "page"))


def delete(docs: DataFrame, spec: str) -> DataFrame:
    """(doc_id, out_page, page): the pages that stay; a file that would lose all pages gives none."""
    left = F.array_except(_every(), _selected(spec))
    return docs.where("page_count > 0").select("doc_id", F.posexplode(left).alias("out_page", "page"))


def split(docs: DataFrame, every: int) -> DataFrame:
    """(doc_id, part, name, page): parts of so many pages."""
    pages = docs.where("page_count > 0").select("doc_id", F.explode(_every()).alias("page"))
    part = F.floor((F.col("page") - 1) / every) + 1
    return pages.select("doc_id", part.alias("part"), F.format_string("%d-part%03d", "doc_id", part).alias("name"), "page")


def merge(docs: DataFrame, group: str) -> DataFrame:
    """(group, doc_id, page, out_page): the pages of a group's files one after another, by doc_id.

    The running page number is a sum of two: files are written in ranges of (group, doc_id), the ranges'
    totals are added up (a few rows a group), and within a range its files. A group that holds most files
    is many ranges, so none is one task.
    """
    files = docs.where("page_count > 0").select(group, "doc_id", "page_count")
    ranged = written(files.repartitionByRange(F.col(group), F.col("doc_id")).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(group, "_range").agg(F.sum("page_count").alias("_total"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    within = Window.partitionBy(group, "_range").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranged.join(totals.drop("_total"), [group, "_range"]).withColumn("ahead", F.col("_before") + F.coalesce(F.sum("page_count").over(within), F.lit(0)))
    return ahead.select(group, "doc_id", F.explode(_every()).alias("page"), "ahead").select(group, "doc_id", "page", (F.col("ahead") + F.col("page")).alias("out_page"))


def rotate(docs: DataFrame, spec: str, degrees: int) -> DataFrame:
    """(doc_id, page, rotation): selected pages turned; a multiple of 90, within 0 to 270."""
    if degrees % 90:
        raise ValueError("rotation must be a multiple of 90")
    return docs.where("page_count > 0").select("doc_id", F.explode(_selected(spec)).alias("page"), F.lit(degrees % 360).alias("rotation"))


def booklet(docs: DataFrame) -> DataFrame:
    """(doc_id, sheet, slot, page): booklet order over a multiple of 4 pages; null is a blank page."""
    padded = docs.where("page_count > 0").withColumn("padded", (F.ceil(F.col("page_count") / 4) * 4).cast("bigint"))
    sheets = padded.select("doc_id", "page_count", "padded", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("padded") / 4 - 1).cast("bigint"))).alias("sheet"))
    s, n = F.col("sheet") * 4, F.col("padded")
    order = F.array(n - s - 1, s, s + 1, n - s - 2)
    slots = sheets.select("doc_id", "page_count", "sheet", F.posexplode(order).alias("slot", "index"))
    return slots.select("doc_id", "sheet", "slot", F.when(F.col("index") < F.col("page_count"), F.col("index") + 1).alias("page"))


def two_up(docs: DataFrame) -> DataFrame:
    """(doc_id, sheet, slot, page): two pages side by side."""
    pages = docs.where("page_count > 0").select("doc_id", F.explode(_every()).alias("page"))
    return pages.select("doc_id", F.floor((F.col("page") - 1) / 2).alias("sheet"), ((F.col("page") - 1) % 2).cast("int").alias("slot"), "page")


def resize_matrix(pages: DataFrame, paper: str, fit: str) -> DataFrame:
    """(doc_id, page_num, sx, sy, tx, ty): the matrix that puts a page on a paper: contain, cover or stretch, centred."""
    w, h = PAPERS[paper.lower()]
    rx, ry = F.lit(w) / F.col("width"), F.lit(h) / F.col("height")
    one = {"contain": F.least(rx, ry), "cover": F.greatest(rx, ry)}.get(fit.lower())
    if one is None and fit.lower() != "stretch":
        raise ValueError(f"unknown fit mode {fit}")
    sx, sy = (one, one) if one is not None else (rx, ry)
    shift = lambda size, side, s: F.round((F.lit(size) - F.col(side) * s) / 2, 6)
    return pages.where("width > 0 and height > 0").select("doc_id", "page_num", F.round(sx, 9).alias("sx"), F.round(sy, 9).alias("sy"), shift(w, "width", sx).alias("tx"), shift(h, "height", sy).alias("ty"))


def crop(pages: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """(doc_id, page_num, box): the crop box of each page; it must have an area."""
    if not (x1 > x0 and y1 > y0):
        raise ValueError("a crop box needs x1 > x0 and y1 > y0")
    return pages.select("doc_id", "page_num", *[F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


#: Names of the document information fields as users write them.
METADATA_FIELDS = ("title", "author", "subject", "keywords", "creator", "producer", "created", "modified")


def metadata_fields(requests: DataFrame, key: str, column: str) -> DataFrame:
    """(key, field): the fields that an array of names stands for; ``all`` is every one, repeats count once, unknown names none."""
    every = F.array(*map(F.lit, METADATA_FIELDS))
    name = F.lower(F.trim(F.col("_name")))
    named = requests.select(key, F.explode(column).alias("_name")).select(key, F.explode(F.when(name == "all", every).otherwise(F.array(name))).alias("field"))
    return named.where(F.col("field").isin(*METADATA_FIELDS)).distinct()
