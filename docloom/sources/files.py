"""Sources and sinks: input files, fixtures, vocabularies, Markdown files, JSON reports."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import ship


def input_files(spark: SparkSession, path: str, glob: str = "*.[pP][dD][fF]", first: int = 0) -> DataFrame:
    """(path, name, length, modified): files of a folder that match a pattern, in order, contents not read; the first so many, 0 for all."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    listed = read.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.col("modificationTime").alias("modified")).orderBy("path")
    return listed.limit(first) if first > 0 else listed


def fixture_folder(spark: SparkSession, path: str) -> DataFrame:
    """(fixture_id, file_name, body, received_at) of a folder of JSON files, as the nested operators read them."""
    ship(spark)
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return read.select(F.xxhash64("path").alias("fixture_id"), name.alias("file_name"), F.decode("content", "UTF-8").alias("body"), F.col("modificationTime").alias("received_at"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, token): one token per line of one file, numbered by line."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("token_id", "token"))


def write_markdown(documents: DataFrame, folder: str, nested: bool = False) -> DataFrame:
    """Writes <doc_id>.md for each document into a folder all executors share, or (``nested``) into one of its own there; gives (doc_id, path, n_bytes).

    A file is written beside its place and renamed, so a repeated task leaves whole files.
    """
    schema = "doc_id bigint, path string, n_bytes bigint"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["markdown"], strict=True):
                target = Path(folder) / str(doc) if nested else Path(folder)
                target.mkdir(parents=True, exist_ok=True)
                data = (text or "").encode()
                path, draft = target / f"{doc}.md", target / f".{doc}-{uuid.uuid4().hex}"
                draft.write_bytes(data)
                os.replace(draft, path)
                rows.append((doc, str(path), len(data)))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "n_bytes"])

    return documents.select("doc_id", "markdown").mapInPandas(write, schema)


def write_reports(reports: DataFrame, folder: str, by: str) -> None:
    """Reports as JSON lines, one folder for each value of a column with few values."""
    reports.write.mode("overwrite").partitionBy(by).json(folder)


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Writes page<n>_img<m>.<format> of each decoded image into a folder by file; gives the image rows with ``image_path``.

    ``images`` is the ``images`` table of PDF files. Pages and images are numbered from 1.
    """
    import re

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        for pdf in batches:
            paths = []
            for path, page, n, kind, content in zip(pdf["path"], pdf["page_num"], pdf["image_index"], pdf["format"], pdf["content"], strict=True):
                target = Path(folder) / re.sub(r"\.pdf$", "", path.rsplit("/", 1)[-1], flags=re.IGNORECASE)
                target.mkdir(parents=True, exist_ok=True)
                place, draft = target / f"page{page + 1}_img{n + 1}.{kind}", target / f".{uuid.uuid4().hex}"
                draft.write_bytes(content)
                os.replace(draft, place)
                paths.append(str(place))
            yield pdf.drop(columns=["content", "error"]).assign(image_path=paths)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in images.schema.fields if f.name not in ("content", "error")) + ", image_path string"
    return images.where("error is null and content is not null").mapInPandas(write, schema)


def write_debug_formulas(formulas: DataFrame, folder: str) -> None:
    """Formula candidates with their decision as JSON lines, a folder for each page number (1-based)."""
    formulas.withColumn("page", F.col("page_num") + 1).write.mode("overwrite").partitionBy("page").json(folder)


def debug_formulas(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """keys + page + (candidates, emitted, latex_values) of written formula candidates, as labelled evaluation reads them."""
    rows = spark.read.json(folder)
    value = F.when(F.trim("latex") != "", F.col("latex")).when(F.trim("source_text") != "", F.col("source_text"))
    return rows.groupBy(*keys, F.col("page").cast("bigint").alias("page")).agg(F.count(F.lit(1)).alias("candidates"), F.count_if("emit").alias("emitted"), F.array_sort(F.collect_list(value)).alias("latex_values"))
