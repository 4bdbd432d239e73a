"""Whole files as texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name
from .lines import local_path


def read_texts(spark: SparkSession, paths: list[str], up_to: int | None = None) -> DataFrame:
    """(path, source, text, modified): each file, of ``up_to`` bytes at most, decoded by its byte order mark, else as UTF-8."""
    raw = spark.read.format("binaryFile").load(paths)
    raw = raw if up_to is None else raw.where(F.col("length") <= up_to)
    mark = F.hex(F.substring("content", 1, 3))
    wide = mark.startswith("FFFE") | mark.startswith("FEFF")
    text = F.when(wide, F.call_function("decode", F.col("content"), F.lit("UTF-16"))).otherwise(F.regexp_replace(F.col("content").cast("string"), "^\ufeff", ""))
    return raw.select(local_path(F.col("path")).alias("path"), text.alias("text"), F.col("modificationTime").alias("modified")).withColumn("source", base_name(F.col("path")))
