"""What a session needs and whether it is there."""

from __future__ import annotations

import importlib.util
import platform
import uuid

from pyspark.sql import DataFrame, SparkSession

from docloom.session import shared_dir

#: Python packages by what needs them.
PACKAGES = {"pyarrow": "Python steps", "pandas": "Python steps", "numpy": "text preparation", "ahocorasick": "leakage search", "tiktoken": "packing"}


def checks(spark: SparkSession) -> DataFrame:
    """(check, ok, detail): versions, packages on the driver and on an executor, the shared folder."""
    rows = [("python", True, platform.python_version()), ("spark", spark.version >= "4.0", spark.version), ("icu", _icu(spark), "confusables data")]
    rows += [(f"package {name}", importlib.util.find_spec(name) is not None, use) for name, use in PACKAGES.items()]
    names = list(PACKAGES)

    def probe(batches):
        import importlib.util as util

        import pandas as pd

        for _ in batches:
            yield pd.DataFrame({"check": [f"executor package {n}" for n in names], "ok": [util.find_spec(n) is not None for n in names], "detail": [PACKAGES[n] for n in names]})

    try:
        place = f"{shared_dir(spark).rstrip('/')}/probe-{uuid.uuid4().hex}"
        spark.range(1).write.parquet(place)
        rows.append(("shared folder", spark.read.parquet(place).count() == 1, shared_dir(spark)))
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception as e:  # noqa: BLE001 - a check that fails is a row
        rows.append(("shared folder", False, str(e).splitlines()[0]))
    schema = "check string, ok boolean, detail string"
    return spark.createDataFrame(rows, schema).unionByName(spark.range(1).coalesce(1).mapInPandas(probe, schema))


def _icu(spark: SparkSession) -> bool:
    try:
        return spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build() is not None
    except TypeError:
        return False
