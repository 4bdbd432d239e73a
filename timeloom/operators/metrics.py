"""Counts over files and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total * 100).otherwise(0.0)


def rate(events: Column, seconds: Column) -> Column:
    """Events a second, rounded."""
    return F.when(seconds > 0, F.round(events / seconds)).otherwise(0.0).cast("bigint")


def per_file(events: DataFrame) -> DataFrame:
    """(path, events, raw, parsed): raw events are those no pattern fitted."""
    raw = F.count_if(F.col("event_type").endswith("Raw"))
    return events.groupBy("path").agg(F.count("*").alias("events"), raw.alias("raw"), (F.count("*") - raw).alias("parsed"))


def progress(files: DataFrame, events: DataFrame) -> DataFrame:
    """One row: files, processed, errors, events, percent; ``files`` has path and error."""
    f = files.agg(F.count("*").alias("files"), F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    e = events.agg(F.count("*").alias("events"))
    return f.join(e, F.lit(True)).withColumn("percent", percent(F.col("processed"), F.col("files")))  # one row each
