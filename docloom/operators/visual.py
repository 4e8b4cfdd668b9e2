"""Formula regions from what a page looks like: dark bands of pixel rows, and the text around them.

A rasteriser is a plug-in: it gives one row for each pixel line of a page. From there on bands are
islands of dark lines, and their neighbourhood is a join on the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.geometry import box, overlap_of_smaller
from docloom.operators import spatial
from docloom.operators.facts import with_page

PAGE = ["doc_id", "page_num"]
#: Phrases that announce a formula.
CUES = r"(?i)hence|where:|given by|calculated as|formula|equation|shall be taken as"
#: Pixels a point at the usual resolution of 72 to the inch.
SCALE = 1.0


def dark_bands(lines: DataFrame, width: int, together: int = 6) -> DataFrame:
    """(doc_id, page_num, y0, y1, x0, x1, dark, run): bands of dark pixel lines.

    ``lines`` has y, dark (pixels), min_x, max_x and max_run for each pixel line of a page ``width``
    pixels wide. A line counts when it and its neighbours have enough dark pixels on average; bands at most
    ``together`` lines apart are one.
    """
    least = max(width // 90, 4)
    w = Window.partitionBy(*PAGE).orderBy("y")
    near = lambda f: F.when(F.abs(f("y").over(w) - F.col("y")) == 1, f("dark").over(w))
    before, after = near(F.lag), near(F.lead)
    n = F.lit(1) + before.isNotNull().cast("int") + after.isNotNull().cast("int")
    smooth = F.floor((F.col("dark") + F.coalesce(before, F.lit(0)) + F.coalesce(after, F.lit(0))) / n)
    kept = lines.withColumn("_smooth", smooth).where(F.col("_smooth") >= least).withColumn("_island", F.col("y") - F.row_number().over(w))
    inked = lambda c: F.when(F.col("dark") > 0, F.col(c))
    bands = kept.groupBy(*PAGE, "_island").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min(inked("min_x")).alias("x0"), F.max(inked("max_x")).alias("x1"), F.sum("dark").alias("dark"), F.max(inked("max_run")).alias("run"))
    v = Window.partitionBy(*PAGE).orderBy("y0")
    bands = bands.where("x0 < x1").withColumn("_new", F.coalesce(F.col("y0") - F.lag("y1").over(v) > together, F.lit(True)).cast("int")).withColumn("_band", F.sum("_new").over(v))
    return bands.groupBy(*PAGE, "_band").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum("dark").alias("dark"), F.max("run").alias("run")).drop("_band")


def band_surroundings(bands: DataFrame, words: DataFrame, blocks: DataFrame) -> DataFrame:
    """Bands (in points, with ``band``) with ``n_words`` they cover, ``gap`` to the nearest word above or below, and ``cue``: the first phrase within 140 points that announces a formula."""
    keys = [*PAGE, "band"]
    over = lambda df, *cols: df.select(*[F.col(c).alias(f"r_{c}") for c in (*PAGE, "x0", "y0", "x1", "y1", *cols)])
    same = (F.col("doc_id") == F.col("r_doc_id")) & (F.col("page_num") == F.col("r_page_num"))
    away = F.greatest(F.col("y0") - F.col("r_y1"), F.col("r_y0") - F.col("y1"), F.lit(0.0))
    beside = (F.col("r_x1") >= F.col("x0")) & (F.col("r_x0") <= F.col("x1"))
    near = bands.join(over(words), same & beside).groupBy(*keys).agg(F.count_if(overlap_of_smaller(box(), box("r_")) > F.lit(0.20)).alias("n_words"), F.min(away).alias("gap"))
    cues = blocks.where(F.col("text").rlike(CUES))
    told = bands.join(over(cues, "text", "reading_order"), same & (away <= 140)).groupBy(*keys).agg(F.min_by(F.left(T.trim(F.col("r_text")), F.lit(48)), "r_reading_order").alias("cue"))
    return bands.join(near, keys, "left").join(told, keys, "left").withColumn("n_words", F.coalesce("n_words", F.lit(0)))


def visual_formulas(bands: DataFrame, words: DataFrame, blocks: DataFrame, pages: DataFrame, existing: DataFrame, excluded: DataFrame, reference_pages: DataFrame, scale: float = SCALE) -> DataFrame:
    """(doc_id, page_num, formula_index, box, confidence, status, reason): dark bands that look like formulas.

    Only pages with an announcing phrase or a formula already found are looked at, reference pages
    never. ``existing`` are formulas, ``excluded`` regions of tables and furniture.
    """
    worth = blocks.where(F.col("text").rlike(CUES)).select(*PAGE).unionByName(existing.select(*PAGE)).distinct().join(reference_pages, PAGE, "left_anti")
    b = with_page(bands.join(worth, PAGE, "left_semi"), pages)
    area = F.greatest(F.col("x1") - F.col("x0"), F.lit(1)) * F.greatest(F.col("y1") - F.col("y0"), F.lit(1))
    b = b.withColumns({"_high": F.col("y1") - F.col("y0"), "_density": F.col("dark") / area, "band": F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0"))})
    b = b.withColumns({c: F.greatest(F.lit(0.0), F.col(c) / scale) for c in ("x0", "y0", "x1", "y1")})
    b = b.withColumns({"x1": F.least("x1", "width"), "y1": F.least("y1", "height")})
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    shaped = (F.col("_high") >= 4 * scale) & high.between(8.0, 90.0) & (wide >= F.col("width") * F.lit(0.12)) & ~((wide > F.col("width") * F.lit(0.92)) & (high > 45)) & F.col("_density").between(0.015, 0.55)
    known = band_surroundings(b.where(shaped), words, blocks)
    rule = F.col("run") >= F.col("width") * F.lit(0.12)
    centred = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("width") / 2) < F.col("width") * F.lit(0.30)
    alone = F.coalesce(F.col("gap") > 12.0, F.lit(True))
    cue = F.col("cue").isNotNull()
    parts = F.array(F.lit("visual-isolated-equation-band"), F.when(cue, F.concat(F.lit("cue:"), "cue")), F.when(centred, "centered"), F.when(alone, "text-gap"), F.when(rule, "horizontal-rule"))
    found = known.where(((F.col("n_words") <= 3) | rule) & (cue | (centred & (alone | rule)))).withColumn("reason", F.array_join(F.filter(parts, lambda r: r.isNotNull()), "+"))
    found = spatial.outside(spatial.outside(found, excluded, 0.45, "smaller"), existing.select(*PAGE, "x0", "y0", "x1", "y1"), 0.45, "smaller")
    index = F.row_number().over(Window.partitionBy(*PAGE).orderBy("band")) - 1
    return found.select(*PAGE, index.cast("bigint").alias("formula_index"), "x0", "y0", "x1", "y1", F.lit(68).alias("confidence"), F.lit("needs-review").alias("status"), "reason")


def reference_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, page_num): pages with a line that is the heading of a bibliography, or of which 40 % of the lines are entries.

    ``lines`` has text for each line of a page.
    """
    from docloom.functions import predicates as P

    t = T.trim(F.col("text"))
    heading = t.isin("References", "Bibliography", "REFERENCES", "BIBLIOGRAPHY")
    per = lines.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"), F.count_if(P.is_reference_line(F.col("text"))).alias("marked"), F.bool_or(heading).alias("headed"))
    return per.where(F.col("headed") | (F.col("marked") * 10 >= F.col("n") * 4)).select(*PAGE)
