"""Intermediate tables in the folder that the cluster shares.

An operator that reads something twice, or iterates, writes it as a Parquet table under ``spark.checkpoint.dir``: a lost
executor then costs the tasks it held and no lineage has to be replayed from the input.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Beyond so many, slices share partitions and are taken one after the other: what the driver keeps of a shuffle stays small.
MOST_PARTITIONS = 4096
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. A local folder stands in for it where it is unset and all runs on one machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        app = spark.sparkContext.applicationId
        if app not in _folders:
            _folders[app] = "file://" + tempfile.mkdtemp(prefix="timeloom-")
        where = _folders[app]
    return where.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Smaller batches between Spark and Python than by default: texts are long, and each copy of a batch takes memory."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if int(spark.conf.get(name).rstrip("b")) > most:
            spark.conf.set(name, str(most))


def freed(run: Callable) -> Callable:
    """``run``, for mapInArrow, after which its worker gives memory back to the system: workers stay for later steps, idle or not."""

    def call(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return call


class Scratch:
    """Names the tables of one operator call, and removes those no longer read."""

    def __init__(self, spark: SparkSession, what: str):
        small_batches(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/timeloom/{what}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a frame that reads it, with the path kept for :meth:`drop`.

        What was shuffled for it is no longer needed then, and Spark is told to remove it when the write ends.
        """
        where = self.path(name)
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(where)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where
        return out

    def drop(self, df: DataFrame) -> None:
        where = getattr(df, "_scratch_path", None)
        if where:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns, whatever they are called, take no part."""
    return df.select(*[df[n] for n in names])
