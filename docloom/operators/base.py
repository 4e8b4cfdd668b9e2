"""The layout tables as the operators read them: newest delivery, each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import latest, newest_files, table

#: First block number of page margins.
MARGIN = 1_000_000
#: Page size where a report has none.
WIDTH, HEIGHT = 612.0, 792.0

BLOCK_KEYS = ["doc_id", "page_num", "block_id"]


def newest_keys(df: DataFrame, keys: list[str], at: str = "extracted_at") -> DataFrame:
    """Rows of each file's newest extraction, each key once; the rows move once, by doc_id."""
    return newest_files(df, at).drop(at).dropDuplicates(keys)


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return newest_keys(table(spark, d, "raw_blocks"), BLOCK_KEYS)


def words(spark: SparkSession, d: str) -> DataFrame:
    return newest_keys(table(spark, d, "raw_words"), [*BLOCK_KEYS, "widx"])


def body_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).where(F.col("block_id") < MARGIN)


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of blocks: keys, line_no and line."""
    split = blocks(spark, d).select(*BLOCK_KEYS, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.withColumn("line_no", F.col("line_no").cast("bigint"))


def reports(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "inspect_reports"), ["doc_id"], "inspected_at")


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the reports: doc_id, page_num, width, height and their figures."""
    p = reports(spark, d).select("doc_id", F.explode("pages").alias("p"))
    return p.select("doc_id", (F.col("p.page") - 1).alias("page_num"), *[F.col(f"p.{k}").alias(k) for k in ("width", "height", "text_blocks", "images", "text_area_fraction", "readable_text", "image_only", "low_density")])


def rendered(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "rendered_documents"), ["doc_id"], "rendered_at", "markdown", "sections")


def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, line_no and line of each markdown, line ends unified."""
    text = F.replace(F.replace("markdown", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    split = rendered(spark, d).where("markdown is not null").select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return split.withColumn("line_no", F.col("line_no").cast("bigint"))


def formulas(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "formula_candidates"), ["doc_id", "page_num", "formula_index"], "detected_at")


def triage(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "ocr_triage"), ["doc_id"], "triaged_at")


#: The same tables for the SQL side.
SQL = r"""
blocks as (select distinct on (doc_id, page_num, block_id) * from raw_blocks order by doc_id, page_num, block_id, extracted_at desc),
words as (select distinct on (doc_id, page_num, block_id, widx) * from raw_words order by doc_id, page_num, block_id, widx, extracted_at desc),
body_blocks as (select * from blocks where block_id < 1000000),
block_lines as (select doc_id, page_num, block_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from blocks),
reports as (select distinct on (doc_id) * from inspect_reports order by doc_id, inspected_at desc),
pages0 as (select doc_id, unnest(pages) as p from reports),
pages as (select doc_id, p.page - 1 as page_num, p.width as width, p.height as height, p.text_blocks as text_blocks, p.images as images, p.text_area_fraction as text_area_fraction,
  p.readable_text as readable_text, p.image_only as image_only, p.low_density as low_density from pages0),
rendered as (select distinct on (doc_id) * from rendered_documents order by doc_id, rendered_at desc),
md0 as (select doc_id, replace(replace(markdown, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as m from rendered where markdown is not null),
markdown_lines as (select doc_id, unnest(string_split(m, chr(10))) as line, generate_subscripts(string_split(m, chr(10)), 1) - 1 as line_no from md0),
formulas as (select distinct on (doc_id, page_num, formula_index) * from formula_candidates order by doc_id, page_num, formula_index, detected_at desc),
triage as (select distinct on (doc_id) * from ocr_triage order by doc_id, triaged_at desc)
"""


def sql(body: str, *extra: str) -> str:
    """SQL over the base tables: ``extra`` CTEs, then the body."""
    return "with " + ",\n".join([SQL.strip(), *extra]) + "\n" + body
