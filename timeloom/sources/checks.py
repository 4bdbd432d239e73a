"""What is wrong with files that are held whole: a row for each that its reader gets nothing from, or not all of it."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Callable
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .evtx import records_in
from .lines import local_path
from .sqlite import DIALECTS, database_rows
from .whole import read_texts

ERRORS = "path string, error string"


def _xml_error(content: bytes) -> str | None:
    text = content.decode("utf-16" if content[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig", "replace")
    parser = expat.ParserCreate()
    try:  # without the declaration, which may name another encoding, as readers do
        parser.Parse(re.sub(r"^\s*<\?xml[^>]*\?>", "", text), True)
    except expat.ExpatError as e:
        return f"not well-formed XML: {e}"
    return None


def _database_error(browser: str) -> Callable[[bytes], str | None]:
    def check(content: bytes) -> str | None:
        try:
            for sql in DIALECTS[browser]:
                for _ in database_rows(content, sql):
                    pass
        except sqlite3.Error as e:
            return f"not a {browser} history: {e}"
        return None

    return check


def _event_log_error(content: bytes) -> str | None:
    if content[:8] != b"ElfFile\0":
        return "not a binary event log"
    return None if len(content) <= 4096 or next(records_in(content), None) else "no record can be read"


BYTES: dict[str, Callable[[bytes], str | None]] = {"scheduled_task": _xml_error, "generic_xml": _xml_error, "evtx": _event_log_error} | {f"browser_{b}": _database_error(b) for b in DIALECTS}
JSON = {"json": False, "cloudtrail": True, "azure": True, "gcp": True}


def unreadable(spark: SparkSession, paths: list[str], parser: str) -> DataFrame:
    """(path, error) of files of one parser that can't be read as what they are; empty for parsers of lines."""
    if parser in JSON:
        texts = read_texts(spark, paths)
        bad = F.try_parse_json("text").isNull()
        if JSON[parser]:  # lines of objects are fine as long as one of them is
            bad = bad & ~F.exists(F.split("text", "\n"), lambda x: F.try_parse_json(x).isNotNull() & F.ltrim(x).startswith("{"))
        return texts.where(bad).select("path", F.lit("not valid JSON").alias("error"))
    if parser not in BYTES:
        return spark.createDataFrame([], ERRORS)
    raw = spark.read.format("binaryFile").load(paths).select(local_path(F.col("path")).alias("path"), "content")

    def run(batches):
        check = BYTES[parser]
        for b in batches:
            got = [check(x.as_buffer().to_pybytes()) for x in b.column(1)]
            some = [i for i, e in enumerate(got) if e]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), pa.array([got[i] for i in some], pa.string())], ["path", "error"])

    return raw.mapInArrow(run, ERRORS)
