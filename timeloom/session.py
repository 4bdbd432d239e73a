"""Sessions for local work, and shipping this package to executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("timeloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package's source, once a session; needed where they don't have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_timeloom_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    where = tempfile.mkdtemp(prefix="timeloom-src-")  # the driver serves the archive from here while the session lasts
    shutil.copytree(root, os.path.join(where, "src", root.name), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(where, "timeloom"), "zip", os.path.join(where, "src")))
    sc._timeloom_shipped = True
    return spark
