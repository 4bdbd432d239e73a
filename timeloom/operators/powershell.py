"""Shell transcripts and logged script blocks. Both are read line by line with little state, so files stream."""

from __future__ import annotations

import re
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import MAX_REGEX_BYTES, cut_bytes, known
from ..schema import CARRIED, INGEST, Context, event

# The formats' patterns.
STARS = re.compile(r"^\*{20,}\Z")
START_MARK, END_MARK = re.compile(r"(?i)^Windows PowerShell transcript start"), re.compile(r"(?i)^Windows PowerShell transcript end")
HEADER = {
    "start": re.compile(r"(?i)^Start time:[\t\n\f\r ]*(\d{14})", re.ASCII), "end": re.compile(r"(?i)^End time:[\t\n\f\r ]*(\d{14})", re.ASCII),
    "username": re.compile(r"(?i)^Username:[\t\n\f\r ]*(.+)\Z"), "run_as": re.compile(r"(?i)^RunAs User:[\t\n\f\r ]*(.+)\Z"),
    "machine": re.compile(r"(?i)^Machine:[\t\n\f\r ]*([^\t\n\f\r (]+)"), "application": re.compile(r"(?i)^Host Application:[\t\n\f\r ]*(.+)\Z"),
}
PROMPT = re.compile(r"^PS[\t\n\f\r ]+([A-Za-z]:\\[^>]*|/)>[\t\n\f\r ]*(.*)\Z")
BLOCK = re.compile(r"(?i)<ScriptBlockText>(.+?)</ScriptBlockText>")
MESSAGE_NUMBER, MESSAGE_TOTAL = re.compile(r"(?i)MessageNumber[=:]\s*(\d+)", re.ASCII), re.compile(r"(?i)MessageTotal[=:]\s*(\d+)", re.ASCII)
STAMP_ISO = re.compile(r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)", re.ASCII)
STAMP_PLAIN = re.compile(r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})", re.ASCII)
SCRIPT_PATH = re.compile(r"""(?i)Path[=:]\s*["']?([^"'\s]+)["']?""", re.ASCII)
OPEN_TAG, CLOSE_TAG = "<ScriptBlockText>", "</ScriptBlockText>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#10;", "\n"), ("&#13;", "\r"), ("&#9;", "\t"), ("&amp;", "&"))
SCRIPT_EVENT_ID = 4104


def decode_entities(c: Column) -> Column:
    """The ampersand comes last: no entity before it can make a new one."""
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def machine(lines: DataFrame, make, schema: str) -> DataFrame:
    """Rows that a state machine gives for each file: ``make(path, source)`` has ``feed(line, number)`` and ``end()``."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches):
        path, now, out = None, None, []

        def table():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if " bigint" in f else pa.string()) for c, f in zip(cols, schema.split(","), strict=True)], names)

        for batch in batches:
            for p, source, number, line in zip(*[batch.column(c).to_pylist() for c in ("path", "source", "line_no", "line")], strict=True):
                if p != path:
                    if now is not None:
                        out += now.end()
                    path, now = p, make(p, source)
                out += now.feed(line, number)
            if len(out) > 1000:
                yield table()
                out = []
        if now is not None:
            out += now.end()
        if out:
            yield table()

    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.select("path", "source", "line_no", "line").repartition(n, "path").sortWithinPartitions("path", "line_no").mapInArrow(run, schema)


TRANSCRIPT = "path string, source string, kind string, number bigint, start string, stop string, username string, run_as string, machine string, application string, command string, output string"


class _Transcript:
    def __init__(self, path: str, source: str, compat: bool):
        self.path, self.source, self.compat = path, source, compat
        self.meta = dict.fromkeys(HEADER, "")
        self.in_header = self.header_done = False
        self.number, self.command, self.output = 0, "", []

    def row(self, kind: str, number: int, command: str = "", output: str = ""):
        m = self.meta
        return (self.path, self.source, kind, number, m["start"], m["end"], m["username"], m["run_as"], m["machine"], m["application"], command, output)

    def flush(self):
        if not self.command:
            return []
        self.number += 1
        done = [self.row("PowerShellCommand", self.number, self.command, "\n".join(self.output).strip())]
        self.output = []
        return done

    def feed(self, line: str, number: int):
        short = line if len(line) * 4 <= MAX_REGEX_BYTES else line.encode()[:MAX_REGEX_BYTES].decode("utf-8", "replace")
        if STARS.match(short):
            self.in_header = self.in_header or not self.header_done
            return []
        if self.in_header and not self.header_done:
            if START_MARK.match(short):
                return []
            if END_MARK.match(short):
                self.in_header = False
                return []
            for name, pattern in HEADER.items():
                if hit := pattern.match(short):
                    self.meta[name] = hit[1].strip()
                    return []
            if line != "" and not line.startswith("PS "):
                return []
            self.in_header, self.header_done = False, True
            if self.compat or line == "":
                return []
        if END_MARK.match(short):
            return []
        if hit := HEADER["end"].match(short):
            self.meta["end"] = hit[1]
            return []
        if hit := PROMPT.match(short):
            done = self.flush()
            self.command = hit[2].strip()
            return done
        if self.command and line != "":
            self.output.append(line)
        return []

    def end(self):
        done = self.flush()
        return done + [self.row("PowerShellTranscriptStart", 0)] * bool(self.meta["start"]) + [self.row("PowerShellTranscriptEnd", 0)] * bool(self.meta["end"])


def transcript(lines: DataFrame, ctx: Context) -> DataFrame:
    """Commands with their output, and the session's start and end. Needs blank lines, which end the header.

    A command right after the header counts, unless ``compat``.
    """
    compat = ctx.compat
    rows = machine(lines, lambda path, source: _Transcript(path, source, compat), TRANSCRIPT)
    start, stop = times.parsed(F.col("start"), "yyyyMMddHHmmss"), times.parsed(F.col("stop"), "yyyyMMddHHmmss")
    length = times.elapsed(F.unix_timestamp(stop) - F.unix_timestamp(start))
    output = F.when(F.octet_length("output") > 500, F.concat(cut_bytes(F.col("output"), 500, 500), F.lit("[truncated]"))).otherwise(F.col("output"))
    message = (
        F.when(F.col("kind") == "PowerShellCommand", F.concat_ws(" | ", F.concat(F.lit("Command: "), "command"), F.concat(F.lit("Output: "), known(output))))
        .when(F.col("kind") == "PowerShellTranscriptStart", F.concat(F.lit("PowerShell session started. Host: "), "application", F.lit(", RunAs: "), "run_as"))
        .otherwise(F.concat(F.lit("PowerShell session ended. Duration: "), F.coalesce(length, F.lit("unknown"))))
    )
    own = F.when((F.col("kind") == "PowerShellCommand") & (F.col("run_as") != "") & (F.col("run_as") != F.col("username")), F.concat("username", F.lit(" (RunAs: "), "run_as", F.lit(")"))).otherwise(F.col("username"))
    valid = F.when(F.col("kind") == "PowerShellCommand", True).when(F.col("kind") == "PowerShellTranscriptStart", start.isNotNull()).otherwise(stop.isNotNull())
    return event(rows.where(valid), timestamp=F.when(F.col("kind") == "PowerShellTranscriptEnd", stop).otherwise(start), event_type=F.col("kind"), event_id="number", user=own, host=F.col("machine"), message=message)


SCRIPT = "path string, source string, stamp string, number bigint, total bigint, script string, content string, encoded bigint"


class _Script:
    def __init__(self, path: str, source: str):
        self.path, self.source, self.stamp, self.block = path, source, "", None
        self.reset()

    def reset(self):
        self.number = self.total = 0
        self.script = ""

    def done(self, content: str, encoded: int):
        row = (self.path, self.source, self.stamp, self.number, self.total, self.script, content, encoded)
        self.reset()
        return [row]

    def feed(self, line: str, number: int):
        if not line.strip():
            return []
        short = line if len(line) * 4 <= MAX_REGEX_BYTES else line.encode()[:MAX_REGEX_BYTES].decode("utf-8", "replace")
        if hit := STAMP_ISO.search(short):
            try:
                if hit[1][-1] == "Z" or hit[1][-3:-2] == ":" and hit[1][-6] in "+-":
                    self.stamp = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", hit[1])).astimezone(timezone.utc).isoformat()
            except ValueError:
                pass
        elif hit := STAMP_PLAIN.search(short):
            try:
                self.stamp = datetime.strptime(hit[1], "%Y-%m-%d %H:%M:%S").replace(tzinfo=timezone.utc).isoformat()
            except ValueError:
                pass
        if hit := MESSAGE_NUMBER.search(short):
            self.number = int(hit[1])
        if hit := MESSAGE_TOTAL.search(short):
            self.total = int(hit[1])
        if hit := SCRIPT_PATH.search(short):
            self.script = hit[1]
        if hit := BLOCK.search(short):
            return self.done(hit[1], 1)
        if OPEN_TAG in line and CLOSE_TAG not in line:
            self.block = (self.block or "") + line[line.index(OPEN_TAG) + len(OPEN_TAG) :]
            return []
        if self.block is not None and CLOSE_TAG in line:
            content, self.block = self.block + line[: line.index(CLOSE_TAG)], None
            return self.done(content, 1)
        if self.block is not None:
            self.block += ("\n" if self.block else "") + line
            return []
        if line.strip().startswith("ScriptBlockText:"):
            return self.done(line.strip().removeprefix("ScriptBlockText:").strip(), 0)
        return []

    def end(self):
        return []


def script_message(number: Column, total: Column, script: Column, content: Column) -> Column:
    content = F.regexp_replace(content, r"^\s+|\s+\z", "")
    content = F.when(F.octet_length(content) > 1000, F.concat(cut_bytes(content, 1000, 1000), F.lit("[truncated]"))).otherwise(content)
    part = F.when(total > 1, F.concat(F.lit("[Part "), number, F.lit("/"), total, F.lit("] "))).otherwise("")
    return F.concat(part, F.coalesce(F.concat(F.lit("Path: "), known(script), F.lit(" | ")), F.lit("")), F.lit("Script: "), content)


def script_blocks(lines: DataFrame, ctx: Context) -> DataFrame:
    """Blocks in tags, on one line or several, and after a plain label. A block's time is the last one seen in the file."""
    rows = machine(lines, _Script, SCRIPT)
    content = F.when(F.col("encoded") == 1, decode_entities(F.col("content"))).otherwise(F.col("content"))
    stamp = known(F.col("stamp")).try_cast("timestamp")
    return event(rows, timestamp=stamp, event_type="PowerShellScriptBlock", event_id=F.lit(SCRIPT_EVENT_ID), message=script_message(F.col("number"), F.col("total"), F.col("script"), content), default=ctx.now, status=F.when(stamp.isNotNull(), CARRIED).otherwise(INGEST))
