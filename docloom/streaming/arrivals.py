"""Files as they arrive: stateless per-document work on a stream, and running counters per source.

Document-wide facts need all pages of a document, so the stream's unit is the document, not the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import nested


def arriving(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def arrival_counts(stream: DataFrame, at: str, by: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window, by, n): arrivals per window and key; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count(F.lit(1)).alias("n"))


def stream_fixture_rows(spark: SparkSession, path: str, sink: str, checkpoint: str, schema: str = "fixture_id bigint, file_name string, body string, received_at timestamp"):
    """Runs all arrived fixture files through the nested operators into a Parquet sink; gives the finished query.

    Each micro-batch is written under its number, so a repeated batch replaces itself: exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        nested.fixture_rows(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = arriving(spark, path, schema).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
