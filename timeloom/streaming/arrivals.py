"""Structured Streaming over files that arrive: row-local formats as they are, the others file by file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import trimmed
from ..operators import filters, text_logs
from ..plans.timeline import build_timeline
from ..schema import Context
from ..sinks.batches import append_batch
from ..sources.lines import local_path, with_source

#: Parsers that need nothing but the line itself.
ROW_LOCAL: dict[str, Callable[[DataFrame, Context], DataFrame]] = {
    "web": text_logs.web_access, "windows_text": text_logs.windows_text, "windows_firewall": text_logs.windows_firewall, "iptables": text_logs.iptables,
    "cisco_asa": text_logs.cisco_asa, "macos_unified": text_logs.macos_unified, "macos_install": text_logs.macos_install,
}


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, source, line_no, line) of arriving files; a stream has no line numbers, so they are 0."""
    raw = spark.readStream.option("lineSep", "\n").text(folder).select(local_path(F.col("_metadata.file_path")).alias("path"), F.lit(0).cast("bigint").alias("line_no"), F.regexp_replace("value", r"\r\z", "").alias("line"))
    return with_source(raw.where(trimmed(F.col("line")) != ""))


def stream_events(spark: SparkSession, folder: str, parser: str, context: Context | None = None, pattern: str | None = None) -> DataFrame:
    """Events of a folder of one row-local format, as a streaming frame."""
    return filters.matching(ROW_LOCAL[parser](stream_lines(spark, folder), context or Context()), pattern)


def counts_by_window(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by window and type; those later than ``late`` are left out and their state is dropped."""
    return events.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "event_type").agg(F.count("*").alias("events"))


def stream_timeline(spark: SparkSession, folder: str, write: Callable[[DataFrame, int], None], checkpoint: str, context: Context | None = None) -> StreamingQuery:
    """A timeline of each batch of new files, of any format, handed to ``write(events, batch)``; stops when all are read."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder).select("path")

    def batch(new: DataFrame, number: int) -> None:
        paths = [r.path for r in new.collect()]
        if paths:
            write(build_timeline(new.sparkSession, *paths, context=context).events, number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_batches(spark: SparkSession, folder: str, root: str, kind: str, checkpoint: str, context: Context | None = None) -> StreamingQuery:
    """A timeline below ``root`` to which each batch of new files is added exactly once, whatever of the stream is repeated."""
    return stream_timeline(spark, folder, lambda events, number: append_batch(events, root, kind, number), checkpoint, context)
