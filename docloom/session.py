"""Session helpers: table access, newest-delivery reading, shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Applications whose workers have the package.
_SHIPPED: set[str] = set()
#: Temporary folder of a local session, by application.
_TEMPORARY: dict[str, str] = {}
#: Intermediates written so far, by application.
_WRITTEN: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once per SparkContext."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="docloom-code-")) / "docloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"docloom/{path.relative_to(root)}")
    sc.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder (one file or a folder of parts)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], version: str | None = None, *values: str) -> DataFrame:
    """One row per key: the newest delivery; between equal versions a hash of the values decides.

    ``values`` names the columns to keep (default all). The newest row is an aggregate
    (``max_by``), so copies combine map-side. Null versions count as oldest.
    """
    keep = list(values) or [c for c in df.columns if c not in keys]
    order = ([F.col(version)] if version else []) + [F.xxhash64(*keep)]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_v"))
    return best.select(*keys, *[F.col("_v").getField(c).alias(c) for c in keep])


def newest_files(df: DataFrame, at: str = "extracted_at", delivered: DataFrame | None = None) -> DataFrame:
    """The rows of each file's newest delivery, of which a file is always delivered whole; copies of it stay.

    ``delivered`` is all that came where ``df`` is a part of it. The times are an aggregate of
    (doc_id, time) that is hashed per partition; the rows move once, by doc_id alone, so that what
    is grouped by doc_id and more afterwards needs no other exchange.
    """
    newest = (df if delivered is None else delivered).groupBy("doc_id").agg(F.max(at).alias("_newest"))
    same = F.coalesce(F.col(at) >= F.col("_newest"), F.col("_newest").isNull())  # no equality: it would become a join key
    return df.join(newest.hint("shuffle_hash"), "doc_id").where(same).drop("_newest")


def of_newest(found: DataFrame, delivered: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The rows of ``found`` that stem from the newest delivery of their key; drops ``version``.

    For operators that work row by row: they run over every delivery, and only the keys and
    versions, not the texts, are shuffled to tell which deliveries stand.
    """
    newest = delivered.groupBy(*keys).agg(F.max(version).alias("_newest"))
    same = F.col(version).eqNullSafe(F.col("_newest"))
    # Both sides grow with the data: sorted and merged, not broadcast.
    return found.hint("merge").join(newest, keys).where(same).select(*[c for c in found.columns if c != version]).distinct()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder; on a cluster, whose machines would
    each write to a disk of their own, that is an error.
    """
    sc = spark.sparkContext
    given = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    return given or temporary_dir(sc.master, sc.applicationId)


def temporary_dir(master: str, app: str) -> str:
    """A folder of this machine for a local session."""
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors of {master} share")
    if app not in _TEMPORARY:
        _TEMPORARY[app] = "file://" + tempfile.mkdtemp(prefix="docloom-")
    return _TEMPORARY[app]


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors.

    The files go with ``release``, at the latest when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    system, place = _place(spark, path)
    system.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of the JVM."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def release(spark: SparkSession) -> int:
    """Deletes the intermediates written so far; for when their results were read or stored. Gives their number."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        system, place = _place(spark, path)
        system.delete(place, True)
    return len(paths)


def lit_array(values: list) -> Column:
    """An array literal."""
    return F.array(*[F.lit(v) for v in values])
