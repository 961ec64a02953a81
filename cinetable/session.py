"""Session defaults for local work, and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("cinetable")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Add the package's own source to the Python path of the executors, once.

    Spark's file server hands the archive out; it is written to the shared
    checkpoint folder where that is a mounted one, else beside the driver.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(here)
    shared = spark.conf.get("spark.checkpoint.dir", None) or ""
    mounted = shared.removeprefix("file://") if shared.startswith("file:///") else shared if shared.startswith("/") else None
    if mounted:
        os.makedirs(mounted, exist_ok=True)
    target = os.path.join(tempfile.mkdtemp(prefix="cinetable-", dir=mounted), "cinetable_src.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, root))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
