"""Timelines whose files are ranges of time, with a table of what each holds.

Events are dealt by sampled ranges of time, so that no task sorts more than its share, and events of one moment (or of none) go to
several files if they are many. A zone table beside the files has the first and the last time in each: a reader of a
range opens those files alone, and never the footers of the others.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ("timestamp", "source", "event_id")
ZONES = "file string, rows bigint, timeless bigint, first timestamp, last timestamp"
_ZONES = "_zones"


def write_indexed(events: DataFrame, root: str, files: int | None = None) -> DataFrame:
    """Writes events as Parquet below ``root`` (which must not exist) in about ``files`` ranges of time, and returns their zones.

    Times that are null come first. The zones are written last: a timeline without them was not finished.
    """
    spark, root = events.sparkSession, root.rstrip("/")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = events.repartitionByRange(files, F.asc_nulls_first("timestamp"), F.xxhash64("path", "event_id", "message")).sortWithinPartitions(F.asc_nulls_first("timestamp"), *ORDER[1:])
    ranged.write.parquet(f"{root}/events")
    found = spark.read.schema("timestamp timestamp").parquet(f"{root}/events").select("timestamp", F.col("_metadata.file_name").alias("file"))
    zones = found.groupBy("file").agg(F.count("*").alias("rows"), F.count_if(F.col("timestamp").isNull()).alias("timeless"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    zones.coalesce(1).write.parquet(f"{root}/{_ZONES}")  # a row a file
    return read_zones(spark, root)


def read_zones(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(ZONES).parquet(f"{root.rstrip('/')}/{_ZONES}")


def read_between(spark: SparkSession, root: str, since: datetime | None = None, until: datetime | None = None, timeless: bool = False) -> DataFrame:
    """The events from ``since`` on and before ``until``, of the files that may hold any; with ``timeless`` those without a time too."""
    root = root.rstrip("/")
    kept = F.lit(True)
    zone = F.col("first").isNotNull()
    if since is not None:
        kept, zone = kept & (F.col("timestamp") >= F.lit(since)), zone & (F.col("last") >= F.lit(since))
    if until is not None:
        kept, zone = kept & (F.col("timestamp") < F.lit(until)), zone & (F.col("first") < F.lit(until))
    kept = F.coalesce(kept & F.col("timestamp").isNotNull(), F.lit(False)) | (F.col("timestamp").isNull() if timeless else F.lit(False))
    zone = zone | (F.col("timeless") > 0 if timeless else F.lit(False))
    zones = read_zones(spark, root).where(zone).select("file")
    names = [r.file for r in zones.toLocalIterator()]  # names of the files that are read, which reading needs on the driver
    whole = spark.read.parquet(f"{root}/events")
    if not names:
        return whole.limit(0)
    return spark.read.schema(whole.schema).parquet(*[f"{root}/events/{n}" for n in names]).where(kept)
