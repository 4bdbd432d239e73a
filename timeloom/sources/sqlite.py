"""Browser history databases, read by the standard library in executors."""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import local_path

#: Per browser: pages (id, url, title, visits) and visits (page, time) as each database has them.
DIALECTS = {
    "chrome": ("SELECT id, url, title, visit_count FROM urls", "SELECT url, visit_time FROM visits"),
    "firefox": ("SELECT id, url, title, visit_count FROM moz_places", "SELECT place_id, visit_date FROM moz_historyvisits"),
    "safari": ("SELECT id, url, NULL, visit_count FROM history_items", "SELECT history_item, visit_time FROM history_visits"),
}
PAGES = "path string, id bigint, url string, title string, visit_count bigint"
VISITS = "path string, page bigint, visit_time double, visit_micros bigint"


def database_rows(content: bytes, sql: str):
    """The rows of a read-only query over a database's bytes; the copy goes when they are read."""
    folder = tempfile.mkdtemp(prefix="timeloom-db-")
    try:
        file = os.path.join(folder, "history.db")
        with open(file, "wb") as out:
            out.write(content)
        db = sqlite3.connect(f"file:{file}?mode=ro&immutable=1", uri=True)
        try:
            yield from db.execute(sql)
        finally:
            db.close()
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _rows(content: bytes, sql: str) -> list[tuple]:
    """All rows, or none of a database that can't be read, which the errors of a timeline list."""
    try:
        return list(database_rows(content, sql))
    except sqlite3.Error:
        return []


def read_history(spark: SparkSession, paths: list[str], browser: str) -> tuple[DataFrame, DataFrame]:
    """(pages, visits) of databases of one browser. Databases are read as bytes, so any store that Spark reads serves."""
    return history_in(spark.read.format("binaryFile").load(paths).select(local_path(F.col("path")).alias("path"), "content"), browser)


def history_in(raw: DataFrame, browser: str) -> tuple[DataFrame, DataFrame]:
    """The same from (path, content) rows that hold one database each."""
    pages_sql, visits_sql = DIALECTS[browser]

    def pages(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = [r for r in _rows(content, pages_sql) if isinstance(r[0], int)]
                cols = [[path] * len(got), [r[0] for r in got], *[[None if r[i] is None else str(r[i]) for r in got] for i in (1, 2)], [r[3] if isinstance(r[3], int) else None for r in got]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["path", "id", "url", "title", "visit_count"])

    def visits(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = [r for r in _rows(content, visits_sql) if isinstance(r[0], int) and isinstance(r[1], (int, float))]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(got), pa.string()), pa.array([r[0] for r in got], pa.int64()), pa.array([float(r[1]) for r in got]), pa.array([int(r[1]) for r in got], pa.int64())], ["path", "page", "visit_time", "visit_micros"])

    return raw.mapInArrow(pages, PAGES), raw.mapInArrow(visits, VISITS)
