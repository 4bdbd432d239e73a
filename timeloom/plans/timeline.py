"""One timeline from many files."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import browser, csv_artifacts, filters, header_logs, json_logs, powershell, routing, text_logs, xml_logs
from ..functions.text import trimmed
from ..schema import EVENT_SCHEMA, Context
from ..sources.checks import BYTES, JSON, unreadable
from ..sources.evtx import read_evtx
from ..sources.lines import read_lines
from ..sources.manifest import first_lines, manifest
from ..sources.sqlite import read_history
from ..sources.whole import read_texts

#: Bytes that one row can hold.
MAX_WHOLE = (1 << 31) - 16
#: What begins a configuration of the monitor.
CONFIG = r"<Sysmon[\s>]"
Parser = Callable[[SparkSession, list[str], Context], DataFrame]


def _lines(parse, blank: bool = False) -> Parser:
    return lambda spark, paths, ctx: parse(read_lines(spark, paths, blank), ctx)


def _texts(parse) -> Parser:
    return lambda spark, paths, ctx: parse(read_texts(spark, paths), ctx)


def _sysmon(spark: SparkSession, paths: list[str], ctx: Context) -> DataFrame:
    texts = read_texts(spark, paths, MAX_WHOLE)  # events stream from files of any size
    is_config = F.col("text").rlike(CONFIG)
    config = xml_logs.monitor_config(texts.where(is_config), ctx)
    return config.union(xml_logs.monitor_events(xml_logs.read_events(spark, paths), ctx))


def _browser(kind: str) -> Parser:
    return lambda spark, paths, ctx: browser.visits(*read_history(spark, paths, kind), kind, ctx)


def _csv(spark: SparkSession, paths: list[str], ctx: Context) -> DataFrame:
    """Files of one header share a plan; headers are the files' first lines."""
    by: dict[str, list[str]] = defaultdict(list)
    for path, line in zip(paths, first_lines(spark, paths), strict=True):
        by[line].append(path)
    parts = []
    for line, own in sorted(by.items()):
        header, sep = csv_artifacts.parse_header(line)
        if header:
            parts.append(csv_artifacts.csv_events(csv_artifacts.read_csv(spark, own, header, sep, placed=True), header, ctx))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], EVENT_SCHEMA)


def _object_lines(parse) -> Parser:
    return lambda spark, paths, ctx: parse(json_logs.line_records(read_lines(spark, paths)), ctx)


PARSERS: dict[str, Parser] = {
    "log": _lines(text_logs.generic_log), "syslog": _lines(text_logs.syslog), "web": _lines(text_logs.web_access), "windows_text": _lines(text_logs.windows_text),
    "windows_firewall": _lines(text_logs.windows_firewall), "iptables": _lines(text_logs.iptables), "cisco_asa": _lines(text_logs.cisco_asa),
    "macos_unified": _lines(text_logs.macos_unified), "macos_install": _lines(text_logs.macos_install), "macos_asl": _lines(text_logs.macos_asl),
    "iis": _lines(header_logs.w3c), "zeek": _lines(header_logs.sensor), "transcript": _lines(powershell.transcript, blank=True), "script_block": _lines(powershell.script_blocks),
    "json": _texts(json_logs.json_events), "cloudtrail": _texts(json_logs.cloudtrail), "azure": _texts(json_logs.azure_activity), "gcp": _texts(json_logs.gcp_audit), "csv": _csv,
    "windows_xml": lambda spark, paths, ctx: xml_logs.windows_events(xml_logs.read_events(spark, paths), ctx), "scheduled_task": _texts(xml_logs.scheduled_tasks), "sysmon": _sysmon, "generic_xml": _texts(xml_logs.generic_xml),
    "browser_chrome": _browser("chrome"), "browser_firefox": _browser("firefox"), "browser_safari": _browser("safari"), "evtx": read_evtx,
}
#: For files that hold an object a line, which needn't be held whole.
BY_LINES: dict[str, Parser] = {"cloudtrail": _object_lines(json_logs.cloudtrail), "azure": _object_lines(json_logs.azure_activity), "gcp": _object_lines(json_logs.gcp_audit)}
#: Formats that are recognised and have no parser.
UNSUPPORTED = ("prefetch", "shellbags")
#: Parsers that hold a file in one row.
WHOLE = ("json", "cloudtrail", "azure", "gcp", "scheduled_task", "generic_xml", "browser_chrome", "browser_firefox", "browser_safari", "evtx")


@dataclass
class Timeline:
    events: DataFrame
    files: DataFrame
    errors: DataFrame


def build_timeline(spark: SparkSession, *inputs: str, pattern: str | None = None, context: Context | None = None, only: set[str] | None = None, max_size: int | None = None, ordered: bool = False) -> Timeline:
    """The events of all files at or below ``inputs``, which files there are, and what went wrong with them.

    A file that can't be read as what it is takes nothing from the others: it gives the events that its reader could get, and
    a row of ``errors``, for which such formats are read once more when ``errors`` is.

    ``only``: names of parsers; files of others aren't read at all. ``ordered``: by time, source and number. ``max_size``: larger
    files are only listed, with an error.
    """
    context = context or Context()
    if pattern:
        filters.check_pattern(spark, pattern)
    # A file is read by lines if its first line that isn't blank is an object of its own and no wrapper of an array.
    first = F.try_parse_json(F.try_element_at(F.filter("head_lines", lambda x: trimmed(x) != ""), F.lit(1)))
    wraps = reduce(lambda a, b: a | b, [(F.col("parser") == p) & F.try_variant_get(first, f"$.{w}", "array<variant>").isNotNull() for p, w in json_logs.WRAPPERS.items()])
    files = manifest(spark, *inputs, max_size=max_size).withColumn("parser", routing.route()).withColumn("by_lines", json_logs.is_object(first) & ~wraps).withColumn("config", F.col("head").rlike(CONFIG)).drop("head", "head_lines")
    by: dict[str, list[str]] = defaultdict(list)
    lined: dict[str, list[str]] = defaultdict(list)
    kept = []
    for r in files.collect():
        error = r.error or (f"{r.parser} files can't be parsed" if r.parser in UNSUPPORTED else None)
        by_lines = r.by_lines and r.parser in BY_LINES and not context.compat
        whole = r.parser in WHOLE or r.parser == "sysmon" and r.config  # the monitor's events stream, its configurations don't
        if error is None and whole and r.size > MAX_WHOLE and not by_lines:
            error = f"{r.size} bytes are more than the {MAX_WHOLE} that a {r.parser} file can have"
        kept.append((r.path, r.size, r.modified, r.parser, error))
        if error is None and (only is None or r.parser in only):
            (lined if by_lines else by)[r.parser].append(r.path)
    files = spark.createDataFrame(kept, "path string, size bigint, modified timestamp, parser string, error string")
    parts = [filters.matching(PARSERS[p](spark, sorted(paths), context), pattern) for p, paths in sorted(by.items())]
    parts += [filters.matching(BY_LINES[p](spark, sorted(paths), context), pattern) for p, paths in sorted(lined.items())]
    events = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], EVENT_SCHEMA)
    errors = files.where("error is not null").select("path", "parser", "error")
    for p in sorted(set(by) & (BYTES.keys() | JSON.keys())):
        errors = errors.union(unreadable(spark, sorted(by[p]), p).select("path", F.lit(p), "error"))
    return Timeline(events.orderBy("timestamp", "source", "event_id") if ordered else events, files, errors)
