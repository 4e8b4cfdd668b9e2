"""External enrichment: commands and services called from the executors, failures kept as columns.

A backend is any callable from a batch of inputs to a batch of outputs; the ready ones run a command
per item or post to a URL. Results are keyed by the content's hash, so a cache table of earlier runs
is an equi-join away and survives lost executors.
"""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One result: status (ok, failed, timed-out, empty), output, milliseconds, error.
Result = tuple[str, str | None, int, str | None]
SCHEMA = "status string, output string, duration_ms bigint, error string"


def command(argv: list[str], timeout: float = 30.0) -> Callable[[str], Result]:
    """A backend that runs a command with the input on its standard input."""

    def run(text: str) -> Result:
        began = time.monotonic()
        taken = lambda: int((time.monotonic() - began) * 1000)
        try:
            done = subprocess.run(argv, input=text, capture_output=True, text=True, timeout=timeout, check=False)
        except subprocess.TimeoutExpired:
            return "timed-out", None, taken(), f"no answer in {timeout:g} s"
        except OSError as e:
            return "failed", None, taken(), str(e)
        if done.returncode:
            return "failed", None, taken(), done.stderr.strip()[:500]
        out = done.stdout.strip()
        return ("ok", out, taken(), None) if out else ("empty", None, taken(), None)

    return run


def http(url: str, timeout: float = 600.0, keys: tuple[str, ...] = ("markdown", "md_content", "text", "content")) -> Callable[[str], Result]:
    """A backend that posts the input as JSON and takes the first of some keys of the answer."""

    def run(text: str) -> Result:
        import json
        import urllib.error
        import urllib.request

        began = time.monotonic()
        try:
            request = urllib.request.Request(url, json.dumps({"text": text}).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                body = json.load(answer)
            out = next((body[k] for k in keys if body.get(k)), None)
            took = int((time.monotonic() - began) * 1000)
            return ("ok", out, took, None) if out else ("empty", None, took, None)
        except (OSError, ValueError, urllib.error.URLError) as e:
            return "failed", None, int((time.monotonic() - began) * 1000), str(e)[:500]

    return run


def enriched(items: DataFrame, column: str, backend: Callable[[str], Result], cache: DataFrame | None = None) -> DataFrame:
    """Items with ``content_hash``, status, output, duration_ms, error and ``cached``.

    Each distinct content is sent once; contents found in ``cache`` (content_hash and the result
    columns) aren't sent. Null contents get the status ``empty``.
    """
    hashed = items.withColumn("content_hash", F.sha2(F.col(column), 256))
    todo = hashed.where(F.col(column).isNotNull()).groupBy("content_hash").agg(F.first(column).alias("content"))
    if cache is not None:
        todo = todo.join(cache.select("content_hash"), "content_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(h, *backend(c)) for h, c in zip(pdf["content_hash"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["content_hash", "status", "output", "duration_ms", "error"])

    results = todo.mapInPandas(run, f"content_hash string, {SCHEMA}").withColumn("cached", F.lit(False))
    if cache is not None:
        results = results.unionByName(cache.select("content_hash", "status", "output", "duration_ms", "error").withColumn("cached", F.lit(True)))
    return hashed.join(results, "content_hash", "left").withColumn("status", F.coalesce("status", F.lit("empty")))


def summary(results: DataFrame) -> DataFrame:
    """One row: attempted, recovered, failed, timed out, cached and the mean latency."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return results.agg(F.count(F.lit(1)).alias("attempted"), is_("ok").alias("recovered"), is_("failed").alias("failed"), is_("timed-out").alias("timed_out"), F.count_if("cached").alias("cached"), F.avg("duration_ms").alias("mean_ms"))
