"""XML: exported events, scheduled tasks, process-monitor configurations and events, and any other document."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import base_name, cut_bytes, evaluated, known, labelled, trimmed
from ..schema import INGEST, MTIME, Context, event
from ..sources.lines import local_path

ROW_SCHEMA = (
    "System struct<Provider: struct<_Name: string>, EventID: struct<_VALUE: string>, Level: string, TimeCreated: struct<_SystemTime: string>, "
    "Channel: string, Computer: string, Security: struct<_UserID: string>>, EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>"
)
# Names of levels and of process-monitor events, and the data that describe the latter.
LEVELS = {0: "LogAlways", 1: "Critical", 2: "Error", 3: "Warning", 4: "Information", 5: "Verbose"}
MONITOR_EVENTS = {
    1: "ProcessCreate", 2: "FileCreateTime", 3: "NetworkConnect", 4: "ServiceStateChange", 5: "ProcessTerminate", 6: "DriverLoad", 7: "ImageLoad", 8: "CreateRemoteThread",
    9: "RawAccessRead", 10: "ProcessAccess", 11: "FileCreate", 12: "RegistryCreate", 13: "RegistrySetValue", 14: "RegistryRename", 15: "FileCreateStreamHash", 16: "ConfigChange",
    17: "PipeCreated", 18: "PipeConnected", 19: "WmiFilter", 20: "WmiConsumer", 21: "WmiBinding", 22: "DnsQuery", 23: "FileDelete", 24: "ClipboardChange",
    25: "ProcessTampering", 26: "FileDeleteDetected", 27: "FileBlockExecutable", 28: "FileBlockShredding", 255: "Error",
}
MONITOR_FIELDS = (
    "Image", "CommandLine", "ParentImage", "ParentCommandLine", "TargetFilename", "DestinationIp", "DestinationPort", "DestinationHostname", "SourceIp", "SourcePort",
    "Hashes", "TargetObject", "QueryName", "QueryResults", "Signed", "Signature", "User", "ProcessGuid", "ProcessId", "SourceProcessGuid", "TargetProcessGuid",
)
GROUP_RULES = ("ProcessCreate", "NetworkConnect")
DIRECT_RULES = ("ProcessCreate", "NetworkConnect", "FileCreate", "RegistryEvent", "DnsQuery", "ImageLoad", "DriverLoad", "ProcessAccess", "CreateRemoteThread", "FileDelete")
MAX_ELEMENTS = 10_000


def read_events(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, source, System, EventData) of each event element; a file streams through one task. What follows an error in a file is lost."""
    rows = spark.read.format("xml").options(rowTag="Event", ignoreNamespace="true", mode="PERMISSIVE", attributePrefix="_", valueTag="_VALUE", ignoreSurroundingSpaces="false").schema(ROW_SCHEMA).load(paths)
    rows = rows.select("*", local_path(F.col("_metadata.file_path")).alias("path"))
    return rows.withColumn("source", base_name(F.col("path"))).where("System is not null")


def events_in(texts: DataFrame) -> DataFrame:
    """The same from (path, source, text) rows that hold one event each."""
    options = {"rowTag": "Event", "ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE"}
    return evaluated(texts, ["path", "source"], e=F.from_xml("text", ROW_SCHEMA, options)).select("path", "source", "e.*")


def _id() -> Column:
    return F.coalesce(trimmed(F.col("System.EventID._VALUE")).try_cast("bigint"), F.lit(0))


def level_name(level: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), level)


def monitor_type(event_id: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MONITOR_EVENTS.items() for x in kv])
    return F.concat(F.lit("Sysmon:"), F.coalesce(F.try_element_at(table, event_id.cast("int")), F.concat(F.lit("Event"), event_id)))


def _data(limit: int, only: tuple[str, ...] | None = None) -> Column:
    """``name=value`` of the named data with a value, in order."""
    some = F.filter(F.coalesce("EventData.Data", F.array().cast("array<struct<_Name: string, _VALUE: string>>")), lambda d: (F.coalesce(d["_Name"], F.lit("")) != "") & (F.coalesce(d["_VALUE"], F.lit("")) != "") & (d["_Name"].isin(*only) if only else F.lit(True)))
    return F.transform(some, lambda d: F.concat(d["_Name"], F.lit("="), cut_bytes(trimmed(d["_VALUE"]), limit, limit - 3)))


def _stamp() -> Column:
    return times.rfc3339(F.col("System.TimeCreated._SystemTime"))


def windows_events(rows: DataFrame, ctx: Context) -> DataFrame:
    """Exported events by channel, else provider."""
    data = _data(100)
    provider = known(F.col("System.Provider._Name"))
    level = level_name(F.coalesce(trimmed(F.col("System.Level")).try_cast("int"), F.lit(0)))
    message = F.concat_ws(" | ", F.concat(F.lit("EventID: "), _id()), labelled("Provider: ", provider), labelled("Level: ", level), known(F.array_join(data, ", ")))
    kind = F.coalesce(known(F.col("System.Channel")), provider, F.lit("WindowsEventXML"))
    return event(rows, timestamp=_stamp(), event_type=kind, event_id=_id(), user=F.col("System.Security._UserID"), host=F.col("System.Computer"), message=message, default=ctx.now, offset=times.offset_minutes(F.col("System.TimeCreated._SystemTime")))


def monitor_events(rows: DataFrame, ctx: Context) -> DataFrame:
    """Events of the process monitor alone."""
    rows = rows.where(F.col("System.Provider._Name").contains("Sysmon"))
    user = F.filter("EventData.Data", lambda d: d["_Name"] == "User")
    message = F.coalesce(known(F.array_join(_data(150, MONITOR_FIELDS), " | ")), F.concat(F.lit("Sysmon Event ID: "), _id()))
    return event(rows, timestamp=_stamp(), event_type=monitor_type(_id()), event_id=_id(), user=trimmed(F.try_element_at(user, F.lit(1))["_VALUE"]), host=F.col("System.Computer"), message=message, default=ctx.now, offset=times.offset_minutes(F.col("System.TimeCreated._SystemTime")))


_TRIGGER = "array<struct<Enabled: string, StartBoundary: string, UserId: string, Delay: string, Subscription: string>>"
TRIGGERS = ("Logon", "Boot", "Calendar", "Time", "Event", "Registration", "Idle")
TASK_SCHEMA = (
    "RegistrationInfo struct<Date: string, Author: string, Description: string, URI: string>, "
    f"Triggers struct<{', '.join(f'{t}Trigger: {_TRIGGER}' for t in TRIGGERS)}>, "
    "Principals struct<Principal: array<struct<UserId: string, GroupId: string, RunLevel: string>>>, Settings struct<Enabled: string, Hidden: string>, "
    "Actions struct<Exec: array<struct<Command: string, Arguments: string, WorkingDirectory: string>>, ComHandler: array<struct<ClassId: string, Data: string>>>"
)


def scheduled_tasks(texts: DataFrame, ctx: Context) -> DataFrame:
    """A registration, the actions, and the triggers of each task (path, source, text)."""
    options = {"rowTag": "Task", "ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE"}
    # A declaration that names another encoding no longer holds for a text.
    body = F.when(F.col("text").rlike(r"\A\s*+<\?xml"), F.regexp_replace("text", r"^\s*<\?xml[^>]*\?>", "")).otherwise(F.col("text"))
    rows = texts.withColumn("t", F.from_xml(body, TASK_SCHEMA, options)).select("path", "source", "t.*")
    info, first = F.col("RegistrationInfo"), F.try_element_at("Principals.Principal", F.lit(1))
    date = info["Date"]
    rows = rows.select(
        "path", "source", "Triggers", "Actions", info["URI"].alias("uri"), F.coalesce(times.rfc3339(date), times.parsed(times.fraction_cut(date), "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]")).alias("ts"), times.offset_minutes(F.when(times.rfc3339(date).isNotNull(), date)).alias("tz"),
        F.coalesce(known(info["Author"]), known(first["UserId"]), first["GroupId"], F.lit("")).alias("who"),
        F.concat_ws(" | ", labelled("URI: ", info["URI"]), labelled("Author: ", info["Author"]), labelled("Description: ", cut_bytes(info["Description"], 100, 97)), labelled("RunLevel: ", first["RunLevel"]), labelled("Enabled: ", F.col("Settings.Enabled")), labelled("Hidden: ", F.col("Settings.Hidden"))).alias("about"),
    )
    item = lambda kind, number, message: F.struct(F.lit(kind).alias("kind"), number.cast("bigint").alias("number"), message.alias("message"))
    text = lambda c: F.coalesce(c, F.lit(""))
    none = F.array().cast("array<struct<kind: string, number: bigint, message: string>>")
    runs = F.transform("Actions.Exec", lambda x, i: item("ScheduledTask:Action", i + 1, F.concat_ws(" | ", labelled("Task: ", F.col("uri")), labelled("Command: ", x["Command"]), labelled("Arguments: ", cut_bytes(x["Arguments"], 200, 197)), labelled("WorkingDir: ", x["WorkingDirectory"]))))
    handlers = F.transform("Actions.ComHandler", lambda x, i: item("ScheduledTask:COMHandler", i + 1, F.concat(F.lit("COM Handler ClassId: "), text(x["ClassId"]), F.lit(" | Data: "), text(x["Data"]))))
    detail = {"Boot": ("Delay", "Delay"), "Event": ("Subscription", "Subscription")}
    triggers, before = [], F.lit(100)
    for kind in TRIGGERS:
        label, name = detail.get(kind, ("StartBoundary", "StartBoundary"))
        column = F.col(f"Triggers.{kind}Trigger")

        def numbered(kind, label, name, before):
            user = lambda x: F.coalesce(labelled(" | UserId: ", x["UserId"]), F.lit("")) if kind == "Logon" else F.lit("")
            return lambda x, i: item(f"ScheduledTask:{kind}Trigger", before + i, F.concat(F.lit(f"{kind} Trigger | Enabled: "), text(x["Enabled"]), F.lit(f" | {label}: "), text(x[name]), user(x)))

        triggers.append(F.transform(column, numbered(kind, label, name, before)))
        before = before + F.coalesce(F.size(F.coalesce(column, F.array().cast(_TRIGGER))), F.lit(0))
    all_ = F.concat(F.array(item("ScheduledTask:Registration", F.lit(0), F.col("about"))), *[F.coalesce(x, none) for x in (runs, handlers, *triggers)])
    rows = rows.select("path", "source", "ts", "tz", "who", F.explode(all_).alias("x"))
    return event(rows, timestamp=F.col("ts"), event_type=F.col("x.kind"), event_id=F.col("x.number"), user=F.col("who"), message=F.col("x.message"), default=ctx.now, offset=F.col("tz"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _rules(text: str):
    """(kind, number, message) of a configuration; nothing if it can't be read."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return
    hashing = root.find(".//{*}HashAlgorithms/{*}Hashing")
    named = root.find(".//{*}HashAlgorithms")
    hashes = (hashing.text if hashing is not None else named.text if named is not None else "") or ""
    yield "SysmonConfig:Settings", 0, f"Sysmon Configuration | SchemaVersion: {root.get('schemaversion', '')} | HashAlgorithms: {hashes.strip()}"
    number = 0
    filtering = root.find("{*}EventFiltering")
    if filtering is None:
        return
    groups = [(g.get("name", ""), g, GROUP_RULES) for g in filtering.findall("{*}RuleGroup")] + [("", filtering, DIRECT_RULES)]
    for name, group, kinds in groups:
        for kind in kinds:
            for rule in group.findall("{*}" + kind):
                number += 1
                parts = [f"RuleGroup: {name}"] * bool(name) + [f"OnMatch: {rule.get('onmatch', '')}"]
                for c in rule:
                    if c.text:
                        parts.append(_local(c.tag) + (f"[{c.get('condition')}]" if c.get("condition") else "") + f"={c.text}")
                yield f"SysmonConfig:{kind}", number, " | ".join(parts)


def _elements(text: str):
    """(kind, number, message) of each element at depth 2 and 3, up to a number of them, as far as the text is well-formed."""
    found, path = [], []

    class Enough(Exception):
        pass

    def start(tag, attrs):
        path.append(tag.rpartition(":")[2])
        if 2 <= len(path) <= 3:
            more = ", ".join(f"{attrs[i].rpartition(':')[2]}={attrs[i + 1]}" for i in range(0, len(attrs), 2))
            found.append(("XMLElement", len(found) + 1, f"Element: {'/'.join(path)}" + (f" | Attributes: {more}" if more else "")))
            if len(found) >= MAX_ELEMENTS:
                raise Enough

    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.StartElementHandler, parser.EndElementHandler = start, lambda tag: path.pop()
    try:
        parser.Parse(text, True)
    except (Enough, expat.ExpatError):
        pass
    return found


def _walked(texts: DataFrame, walk, ctx: Context) -> DataFrame:
    """Events of the file's modification time, if it is known, from a walk over each text (path, source, text, modified)."""
    rows = texts.select("path", "source", "modified", F.regexp_replace("text", r"^\s*<\?xml[^>]*\?>", "").alias("text"))

    def run(batches):
        for b in batches:
            for p, s, m, t in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                found = list(walk(t or ""))
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.string()), pa.array([s] * n, pa.string()), pa.array([m] * n, pa.timestamp("us", tz="UTC")), *[pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))]], ["path", "source", "modified", "kind", "number", "message"])

    rows = rows.mapInArrow(run, "path string, source string, modified timestamp, kind string, number bigint, message string")
    return event(rows, timestamp=F.col("modified"), event_type=F.col("kind"), event_id="number", message=F.col("message"), default=ctx.now, status=F.when(F.col("modified").isNotNull(), MTIME).otherwise(INGEST))


def monitor_config(texts: DataFrame, ctx: Context) -> DataFrame:
    """A configuration's settings and rules; groups first, then direct rules by kind."""
    return _walked(texts, _rules, ctx)


def generic_xml(texts: DataFrame, ctx: Context) -> DataFrame:
    return _walked(texts, _elements, ctx)
