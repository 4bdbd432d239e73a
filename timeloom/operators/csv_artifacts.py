"""CSV exports of forensic tools: columns get roles by their names."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..schema import Context, event
from ..sources.lines import is_blank, read_lines
from .segments import Records, Table, carried, stretch_of

# Column names by role, in order of preference of the columns, not of these lists.
TIMES = (
    "timestamp", "datetime", "time", "date", "eventtime", "event_time", "start_time", "end_time", "starttime", "endtime",
    "created0x10", "modified0x10", "lastrecordchange0x10", "lastaccess0x10", "created0x30", "modified0x30", "lastrecordchange0x30", "lastaccess0x30",
    "created", "modified", "lastaccess", "lastmodified", "last_modified", "visit_time", "last_visit_time", "lastvisittime", "visittime", "access_time", "accesstime",
    "date_time", "creationtime", "creation_time", "modificationtime", "modification_time", "lastaccesstime", "last_access_time", "writetime", "write_time",
    "timecreated", "time_created", "systemtime", "system_time", "lastwritetime", "last_write_time",
)
MESSAGES = (
    "message", "msg", "description", "desc", "data", "content", "details", "path", "filepath", "file_path", "fullpath", "full_path",
    "filename", "file_name", "name", "parentpath", "parent_path", "url", "title", "pagetitle", "page_title",
    "command", "commandline", "command_line", "cmd", "arguments", "args", "source_long", "display_name", "parser",
    "source_ip", "dest_ip", "destination", "source", "target", "valuename", "value_name", "keypath", "key_path", "valuedata", "value_data",
    "action", "operation", "event", "activity", "type", "status",
)
SOURCES = ("source", "source_long", "parser", "log_source", "logsource", "category", "type", "event_type", "eventtype")
USERS = ("user", "username", "user_name", "account", "accountname", "account_name", "owner", "sid", "usersid", "user_sid")
HOSTS = ("host", "hostname", "host_name", "computer", "computername", "computer_name", "machine", "machinename", "machine_name", "workstation", "server")

_DAY, _CLOCK = r"(?P<Y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)", r"(?P<H>\d{1,2}):(?P<M>\d\d):(?P<S>\d\d)(?:[.,](?P<f>\d+))?"
#: Forms of times in the order they are tried; month-first dates come before day-first ones.
FORMS = [re.compile(p + r"\Z", re.ASCII) for p in (
    rf"{_DAY}T{_CLOCK}(?P<z>Z|[+-]\d\d:\d\d)", rf"{_DAY}T{_CLOCK}", rf"{_DAY} {_CLOCK}",
    rf"(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}})/(?P<Y>\d{{4}}) {_CLOCK}", rf"(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}})/(?P<Y>\d{{4}}) {_CLOCK} (?P<p>AM|PM)",
    rf"(?P<d>\d{{1,2}})/(?P<m>\d{{1,2}})/(?P<Y>\d{{4}}) {_CLOCK}",
    _DAY, r"(?P<m>\d\d)/(?P<d>\d\d)/(?P<Y>\d{4})", r"(?P<d>\d\d)/(?P<m>\d\d)/(?P<Y>\d{4})",
    rf"{_DAY} {_CLOCK} (?P<z>[+-]\d\d:?\d\d)",
)]
FILETIME_FROM, FILETIME_TO = 116_444_736_000_000_000, 200_000_000_000_000_000
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def time_of(text: str, form: re.Pattern) -> datetime | None:
    hit = form.match(text)
    if not hit:
        return None
    g = hit.groupdict()
    hour = int(g.get("H") or 0)
    if g.get("p"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (g["p"] == "PM")
    try:
        t = datetime(int(g["Y"]), int(g["m"]), int(g["d"]), hour, int(g.get("M") or 0), int(g.get("S") or 0), int(((g.get("f") or "") + "000000")[:6]), timezone.utc)
        z = g.get("z")
        if z and z != "Z":
            shift = timedelta(hours=int(z[1:3]), minutes=int(z[-2:]))
            t = t - shift if z[0] == "+" else t + shift
        return t
    except (ValueError, OverflowError):
        return None


def epoch_time(v: int, compat: bool = False) -> datetime | None:
    """Seconds, milliseconds, microseconds or hundreds of nanoseconds since 1601, by magnitude."""
    try:
        if not compat and FILETIME_FROM < v < FILETIME_TO:
            return _EPOCH + timedelta(microseconds=(v - FILETIME_FROM) // 10)
        for least, unit in ((10**15, 1), (10**12, 1000), (10**9, 1_000_000)):
            if v > least:
                return _EPOCH + timedelta(microseconds=v * unit)
    except OverflowError:
        pass
    return None


def sticky_times(compat: bool = False) -> Table:
    """Times of rows by their candidates: the form that fitted last is tried first, which settles 1/2/2024. State 0 is no form."""

    def one(state: int, text: str) -> tuple[int, datetime | None]:
        if state and (t := time_of(text, FORMS[state - 1])):
            return state, t
        if text.isascii() and text.isdigit() and (t := epoch_time(int(text), compat)):
            return 0, t
        for i, form in enumerate(FORMS, 1):
            if t := time_of(text, form):
                return i, t
        return state, None

    def step(state: int, candidates: list[str | None] | None) -> tuple[int, datetime | None]:
        for c in candidates or ():
            if c not in (None, "", "-"):
                state, t = one(state, c)
                if t:
                    return state, t
        return state, None

    return Table("candidates", "timestamp", pa.timestamp("us", tz="UTC"), len(FORMS) + 1, step)


def columns_for(header: list[str], known: tuple[str, ...]) -> list[int]:
    """Places of the columns whose name is or contains one of ``known``."""
    return [i for i, h in enumerate(header) if any(k in h.strip().lower() for k in known)]


def parse_header(first_line: str) -> tuple[list[str], str]:
    """(column names, separator): a semicolon if there are more of them than commas."""
    import csv

    first_line = first_line.lstrip("\ufeff")
    sep = ";" if first_line.count(";") > first_line.count(",") else ","
    return next(csv.reader([first_line], delimiter=sep, skipinitialspace=True), []), sep


def _open_quotes(sep: str) -> tuple[Column, Column]:
    """Whether a quoted field is open at the end of ``line``, if none is at its beginning, and if one is.

    A quote opens a field only where the field begins; within it two are one, and another closes it, whatever follows up to the separator.
    """
    inside = r'(?:[^"]++|"")*+'
    field = rf'(?:[ \t]*+"{inside}"[^{sep}]*+|(?![ \t]*+")[^{sep}]*+)'
    opened = rf'(?:{field}{sep})*+[ \t]*+"{inside}\z'
    line = F.col("line")
    return line.rlike(rf"\A{opened}"), line.rlike(rf'\A{inside}(?:\z|"(?!")[^{sep}]*+{sep}{opened})')


def _joined(batches):
    """Lines (path, source, block, record, split, line_no, line), in order, as records (path, source, block, line_no, text)."""
    names, held = ["path", "source", "block", "line_no", "text"], []

    def whole(rows: pa.RecordBatch, begins: np.ndarray) -> pa.RecordBatch:
        line = rows.column(6)
        if len(begins) < len(rows):
            edges = pa.array(np.append(begins, len(rows)), pa.int64())
            line = pc.binary_join(pa.LargeListArray.from_arrays(edges, line), "\n")
            rows = rows.take(pa.array(begins))
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), rows.column(3), line], names)

    for batch in batches:
        begins = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False) > 0)
        if not len(begins):
            held += [batch] * bool(len(batch))
            continue
        last = int(begins[-1])
        if held or begins[0] > 0:  # what is held is one record, and goes on to the first that begins
            first = pa.concat_batches([*held, batch.slice(0, int(begins[0]))])
            yield whole(first, np.zeros(1, int))
        if last > begins[0]:
            yield whole(batch.slice(int(begins[0]), last - int(begins[0])), begins[:-1] - begins[0])
        held = [batch.slice(last)]  # it may go on in the next batch
    if held:
        yield whole(pa.concat_batches(held), np.zeros(1, int))


def records_of(lines: DataFrame, sep: str) -> DataFrame:
    """(path, source, block, line_no, text): the records of files of lines, numbered from 1, blank lines between them left out.

    Quoted fields may go on over lines and splits. Which lines go together is found in parallel; then lines are dealt by stretches
    of records (``block``), in whose order records come.
    """
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    opens, stays = _open_quotes(sep)
    quoted = F.col("line").contains('"')  # without a quote nothing opens, and nothing closes
    lines = lines.select("*", (quoted & opens).alias("opens"), (~quoted | stays).alias("stays"), (F.col("line") == "").alias("blank"))
    lines = carried(lines, Records(), "record").where("record <> 0")
    split = F.col("block") if "block" in lines.columns else F.lit(0).cast("bigint")
    rows = lines.select("path", "source", stretch_of(F.abs("record")).alias("block"), "record", split.alias("split"), "line_no", "line")
    rows = rows.repartition(n, "path", "block").sortWithinPartitions("path", "block", F.abs("record"), "split", "line_no")
    return rows.mapInArrow(_joined, "path string, source string, block bigint, line_no bigint, text string")


def fields_of(record: Column | str, schema: str, sep: str, **options: str) -> Column:
    """The fields of a record, null where empty.

    A quote alone escapes a quote. If nothing is said of what escapes that, the parser takes it to be NUL, and drops those in quoted fields.
    """
    return F.from_csv(record, schema, {"sep": sep, "escape": '"', "charToEscapeQuoteEscaping": '"', "mode": "PERMISSIVE", **options})


def read_csv(spark: SparkSession, paths: list[str], header: list[str], sep: str, placed: bool = False) -> DataFrame:
    """(path, source, line_no, c0, c1, ...) of files with one header: records from number 2 on; short ones are padded with nulls.

    Files are read in splits, one in many tasks, whatever their quoted fields hold. ``placed``: with ``block`` as records have it.
    """
    schema = ", ".join(f"c{i} string" for i in range(len(header)))
    rows = records_of(read_lines(spark, paths, blank=True, numbered=False), sep).where("line_no > 1")
    return rows.select("path", "source", "line_no", *["block"] * placed, F.inline(F.array(fields_of("text", schema, sep, ignoreLeadingWhiteSpace="true"))))


def csv_events(rows: DataFrame, header: list[str], ctx: Context, sticky: bool = True) -> DataFrame:
    """Events from (path, source, line_no, c0, ...) rows, which may have their ``block``. ``sticky``: times may need the form of the rows above."""
    placed = "block" in rows.columns
    value = lambda i: F.nullif(F.nullif(trimmed(F.col(f"c{i}")), F.lit("")), F.lit("-"))
    stamps = columns_for(header, TIMES)
    messages = columns_for(header, MESSAGES) or [i for i in range(len(header)) if i not in stamps]
    named = lambda i: F.concat(F.lit(header[i].strip() + "="), value(i)) if len(messages) > 1 else value(i)
    first = lambda names: F.coalesce(*[value(i) for i in columns_for(header, names)], F.lit(None))
    rows = rows.where(reduce(Column.__or__, [F.coalesce(~is_blank(F.col(f"c{i}")), F.lit(False)) for i in range(len(header))])) if header else rows
    rows = rows.select(
        "path", "source", "line_no", *["block"] * placed, F.array(*[value(i) for i in stamps]).cast("array<string>").alias("candidates"),
        F.concat_ws(" | ", *[named(i) for i in messages]).alias("message"), F.coalesce(first(SOURCES), F.lit("CSVRecord")).alias("kind"), first(USERS).alias("who"), first(HOSTS).alias("where"),
    )
    rows = carried(rows, sticky_times(ctx.compat), "ts", placed=placed) if sticky and stamps else rows.withColumn("ts", plain_time(F.col("candidates")))
    return event(rows, timestamp=F.col("ts"), event_type=F.col("kind"), user=F.col("who"), host=F.col("where"), message=F.col("message"))


def plain_time(candidates: Column) -> Column:
    """The first candidate that is a number of time units or an ISO time; for files where no form is ambiguous."""
    from ..functions import times

    iso = lambda c: F.coalesce(F.when(c.rlike(r"^\d+\z"), times.epoch_by_magnitude(c.try_cast("bigint"))), times.rfc3339(c), times.parsed(times.fraction_cut(c), "yyyy-MM-dd['T'][ ]HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd"))
    return F.try_element_at(F.filter(F.transform(candidates, iso), lambda t: t.isNotNull()), F.lit(1))
