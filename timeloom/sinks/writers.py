"""CSV, JSON Lines, SQLite and Parquet."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("timestamp", "source", "event_type", "event_id", "user", "host", "message", "path", "tags", "score", "summary")
BATCH = 10_000
# Fixed value: the table that readers of such databases expect.
DDL = """CREATE TABLE IF NOT EXISTS events (
    id INTEGER PRIMARY KEY AUTOINCREMENT, timestamp TEXT NOT NULL, source TEXT, event_type TEXT, event_id INTEGER, user TEXT, host TEXT,
    message TEXT, path TEXT, tags TEXT, score REAL, summary TEXT)"""


def time_text(ts: Column, offset_min: Column | None = None, fraction: bool = False) -> Column:
    """RFC 3339 at the record's offset; year 1 where there is no time."""
    offset = F.coalesce(offset_min, F.lit(0)) if offset_min is not None else F.lit(0)
    local = F.timestamp_micros(F.unix_micros(F.coalesce(ts, F.lit("0001-01-01 00:00:00+00:00").cast("timestamp"))) + offset.cast("bigint") * 60_000_000)
    body = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.regexp_replace(F.date_format(local, ".SSSSSS"), r"\.?0+\z", "") if fraction else F.lit("")
    size = F.abs(offset)
    zone = F.when(offset == 0, "Z").otherwise(F.concat(F.when(offset < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0")))
    return F.concat(body, part, zone)


def _offset(events: DataFrame) -> Column | None:
    return F.col("tz_offset_min") if "tz_offset_min" in events.columns else None


def csv_columns(events: DataFrame) -> DataFrame:
    """All columns as text: times to the second, tags joined by commas, the score with two decimals."""
    own = {"timestamp": time_text(F.col("timestamp"), _offset(events)), "event_id": F.col("event_id").cast("string"), "tags": F.array_join("tags", ","), "score": F.format_string("%.2f", "score")}
    return events.select(*[own.get(c, F.col(c)).alias(c) for c in COLUMNS])


def json_lines(events: DataFrame) -> DataFrame:
    """One object a row; tags, score and summary only where there is something in them."""
    own = {
        "timestamp": time_text(F.col("timestamp"), _offset(events), fraction=True), "tags": F.when(F.size("tags") > 0, F.col("tags")),
        "score": F.when(F.col("score") != 0, F.col("score")), "summary": F.nullif(F.col("summary"), F.lit("")),
    }
    return events.select(F.to_json(F.struct(*[own.get(c, F.col(c)).alias(c) for c in COLUMNS])).alias("value"))


def write_csv(events: DataFrame, path: str) -> None:
    csv_columns(events).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def write_jsonl(events: DataFrame, path: str) -> None:
    json_lines(events).write.mode("overwrite").text(path)


def write_parquet(events: DataFrame, path: str) -> None:
    """Sorted by time within files, so that readers of a time range skip what is outside."""
    events.sortWithinPartitions("timestamp").write.mode("overwrite").parquet(path)


def write_sqlite(events: DataFrame, path: str) -> int:
    """Append to the events table of one database on the driver, a partition at a time; the index on time comes last."""
    rows = csv_columns(events).withColumn("event_id", F.col("event_id").cast("bigint")).withColumn("score", F.col("score").cast("double"))
    db = sqlite3.connect(path)
    try:
        for pragma in ("synchronous = OFF", "journal_mode = MEMORY", "cache_size = -64000", "temp_store = MEMORY"):
            db.execute(f"PRAGMA {pragma}")
        db.execute(DDL)
        n, batch = 0, []
        sql = f"INSERT INTO events ({', '.join(COLUMNS)}) VALUES ({', '.join('?' * len(COLUMNS))})"
        for row in rows.toLocalIterator():
            batch.append(tuple(row))
            if len(batch) == BATCH:
                db.executemany(sql, batch)
                db.commit()
                n, batch = n + len(batch), []
        db.executemany(sql, batch)
        db.execute("CREATE INDEX IF NOT EXISTS idx_events_timestamp ON events(timestamp)")
        db.commit()
        return n + len(batch)
    finally:
        db.close()


def single_file(write: Callable[[DataFrame, str], None], events: DataFrame, path: str) -> None:
    """The one part file of a local directory under the name ``path``; for results that one task can write."""
    folder = path + ".parts"
    write(events.coalesce(1), folder)
    part = next(f for f in sorted(os.listdir(folder)) if f.startswith("part-"))
    os.replace(os.path.join(folder, part), path)
    for f in os.listdir(folder):
        os.remove(os.path.join(folder, f))
    os.rmdir(folder)


SINKS: dict[str, Callable[[DataFrame, str], object]] = {"csv": write_csv, "jsonl": write_jsonl, "sqlite": write_sqlite, "parquet": write_parquet}
EXTENSIONS = {"csv": "csv", "jsonl": "jsonl", "sqlite": "db", "parquet": "parquet"}


def sink(name: str) -> Callable[[DataFrame, str], object]:
    try:
        return SINKS[name.lower()]
    except KeyError:
        raise ValueError(f"unsupported output format: {name}") from None


def output_name(folder: str, name: str, now: datetime | None = None) -> str:
    """timeline_YYYYMMDD_HHMMSS with the format's extension."""
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    return os.path.join(folder, f"timeline_{stamp}.{EXTENSIONS[name.lower()]}")
