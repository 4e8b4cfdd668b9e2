"""A deterministic page layout for plain texts: words, lines and pages, without any PDF.

Each text line is a block of 12 words a visual line and 50 visual lines a page, one blank after each
block; blocks of up to 6 words are set in 14 points, others in 10.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_LINE, PER_PAGE = 12, 50


def layout(documents: DataFrame) -> DataFrame:
    """(doc_id, page_num, block_id, line_id, widx, text, font_size, box, baseline_y) of documents' texts."""
    paras = documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_id", "para"))
    b = paras.withColumn("ws", F.filter(F.split(F.trim("para"), " +"), lambda w: w != "")).where(F.size("ws") > 0)
    b = b.withColumn("n_lines", F.ceil(F.size("ws") / PER_LINE)).withColumn("font_size", F.when(F.size("ws") <= 6, 14.0).otherwise(10.0))
    w = Window.partitionBy("doc_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("line0", F.coalesce(F.sum(F.col("n_lines") + 1).over(w), F.lit(0)))
    x = b.select("doc_id", "block_id", "font_size", "line0", F.posexplode("ws").alias("widx", "text"))
    line = F.col("line0") + F.floor(F.col("widx") / PER_LINE)
    x0 = (72 + (F.col("widx") % PER_LINE) * 38).cast("double")
    y0 = (72 + (line % PER_PAGE) * 13).cast("double")
    return x.select(
        "doc_id", F.floor(line / PER_PAGE).cast("bigint").alias("page_num"), F.col("block_id").cast("bigint").alias("block_id"), line.cast("bigint").alias("line_id"), F.col("widx").cast("bigint").alias("widx"),
        "text", "font_size", x0.alias("x0"), y0.alias("y0"), (x0 + F.least(F.length("text"), F.lit(7)) * 5.0).alias("x1"), (y0 + F.col("font_size")).alias("y1"), (y0 + F.col("font_size")).alias("baseline_y"),
    )
