"""The one relation: events."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()), T.StructField("source", T.StringType()), T.StructField("event_type", T.StringType()),
    T.StructField("event_id", T.LongType()), T.StructField("user", T.StringType()), T.StructField("host", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("path", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("score", T.DoubleType()), T.StructField("summary", T.StringType()),
    T.StructField("tz_offset_min", T.IntegerType()), T.StructField("ts_status", T.StringType()),
])

#: ts_status: the record's own time; none; the run's reference time; the file's modification time; the last time seen in the file.
PARSED, MISSING, INGEST, MTIME, CARRIED = "parsed", "missing", "ingest_default", "file_mtime", "carried"


@dataclass(frozen=True)
class Context:
    """What a parse depends on besides its input. ``reference_time`` stands for "now" wherever a format falls back to it."""

    reference_time: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    compat: bool = False

    @property
    def now(self) -> Column:
        return F.lit(self.reference_time.astimezone(timezone.utc).isoformat()).cast("timestamp")


def text(c: Column | str | None) -> Column:
    return F.lit("") if c is None else F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def event(df: DataFrame, *, timestamp: Column, event_type: Column | str, event_id: Column | str = "line_no", user: Column | None = None, host: Column | None = None, message: Column, default: Column | None = None, status: Column | None = None, offset: Column | None = None) -> DataFrame:
    """Rows of :data:`EVENT_SCHEMA` from a frame with ``source`` and ``path``.

    ``default`` replaces a time that is null; the status says so.
    """
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    fallback = F.lit(MISSING if default is None else INGEST)
    return df.select(
        (timestamp if default is None else F.coalesce(timestamp, default)).cast("timestamp").alias("timestamp"), text("source").alias("source"), kind.alias("event_type"),
        (F.col(event_id) if isinstance(event_id, str) else event_id).cast("bigint").alias("event_id"), text(user).alias("user"), text(host).alias("host"), text(message).alias("message"), text("path").alias("path"),
        F.array().cast("array<string>").alias("tags"), F.lit(0.0).alias("score"), F.lit("").alias("summary"),
        (F.lit(None) if offset is None else offset).cast("int").alias("tz_offset_min"), (F.when(timestamp.isNotNull(), F.lit(PARSED)).otherwise(fallback) if status is None else status).alias("ts_status"),
    )
