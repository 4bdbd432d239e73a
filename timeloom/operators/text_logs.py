"""Parsers of line formats: system, web, firewall and desktop logs."""

from __future__ import annotations

from datetime import timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import evaluated, first_match, groups, known, matches, trimmed, truncated
from ..schema import Context, event
from .sequence import months_added
from .segments import Rollover, carried

# The formats' patterns.
ISO_ZONED = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})"
GENERIC = (
    rf"({ISO_ZONED})",
    r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})",
    r"(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4})",
    r"(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2}\s+(?:AM|PM))",
)
STAMP = r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
SYSLOG_3164 = rf"^({STAMP})\s+(\S+)\s+([^:]+):\s+(.*)$"
SYSLOG_5424 = rf"^({ISO_ZONED})\s+(\S+)\s+([^:]+):\s+(.*)$"
WEB = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]+)"\s+(\d{3})\s+(\d+|-)(?:\s+"([^"]*)"\s+"([^"]*)")?.*$'
WINDOWS_COMMA = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}),\s+(\S+)\s+(.*)$"
WINDOWS_SLASH = r"^(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.*)$"
WINDOWS_FIREWALL = r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})\s+(\w+)\s+(\w+)\s+(\S+)\s+(\S+)\s+(\d+|-)\s+(\d+|-)\s+(.*)$"
IPTABLES = rf"^({STAMP})\s+(\S+)\s+kernel:\s+\[([^\]]+)\]\s+(.*)$"
IPTABLES_FIELDS = {"src": r"SRC=(\S+)", "dst": r"DST=(\S+)", "spt": r"SPT=(\d+)", "dpt": r"DPT=(\d+)", "proto": r"PROTO=(\w+)", "in": r"IN=(\S*)", "out": r"OUT=(\S*)"}
ASA = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{4}\s+\d{2}:\d{2}:\d{2}):\s+%ASA-(\d)-(\d+):\s+(.*)$"
_IP = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
ASA_CONNECTION = rf"(?:for|from)\s+(\S+):{_IP}/(\d+).*?(?:to)\s+(\S+):{_IP}/(\d+)"
ASA_DENIED = rf"(?:src|from)\s+(?:\S+:)?{_IP}(?:/(\d+))?.*?(?:dst|to)\s+(?:\S+:)?{_IP}(?:/(\d+))?"
_MAC_TIME = r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}"
UNIFIED = rf"^({_MAC_TIME}(?:\.\d+)?(?:[+-]\d{{4}})?)\s+(\S+)\s+([^\[]+)\[(\d+)\]:\s+(?:\(([^)]+)\)\s+)?(.*)$"
UNIFIED_PLAIN = rf"^({_MAC_TIME}(?:\.\d+)?(?:[+-]\d{{4}})?)\s+(\S+)\s+([^\[]+)\[(\d+)\]:\s+(.*)$"
INSTALL = rf"^({_MAC_TIME})([+-]\d{{2}})\s+(\S+)\s+([^\[]+)\[(\d+)\]:\s+(.*)$"
ASL = rf"^({STAMP})\s+(\S+)\s+([^\[]+)\[(\d+)\]\s+<([^>]+)>:\s+(.*)$"
ASL_NO_PID = rf"^({STAMP})\s+(\S+)\s+(\S+)\s+<([^>]+)>:\s+(.*)$"
# Message ids of firewall appliances.
ASA_CONNECTIONS = ("302013", "302014", "302015", "302016")
ASA_DENY_IDS = ("106001", "106006", "106007", "106014", "106015", "106023", "313001", "313004", "313005", "710003", "710005")
ASA_ACL = "106100"


def _grouped(lines: DataFrame, **patterns: str) -> DataFrame:
    """Adds the groups of each pattern; a pattern is tried where none before it matches."""
    rows, line = lines, truncated(F.col("line"))
    for i, (name, p) in enumerate(patterns.items()):
        rest = reduce(lambda a, b: a & b, [F.col(x).isNull() for x in list(patterns)[:i]], F.lit(True))
        rows = rows.select("*", groups(F.when(rest, line) if i else line, p).alias(name))
    return rows


def _at(name: str, i: int) -> Column:
    """Group i, counted from 1; null without a match."""
    return F.col(name)[i - 1]


#: Columns of a line that events keep beside those of their own.
_PLACE = ("path", "source", "line_no")


def _split(lines: DataFrame) -> list[str]:
    """The column of the split that lines are read in, if they have it."""
    return ["block"] * ("block" in lines.columns)


def _raw_or(hit: Column, kind: str) -> Column:
    return F.when(hit, kind).otherwise(kind + "Raw")


def generic_log(lines: DataFrame, ctx: Context) -> DataFrame:
    """Lines with a time of one of four forms; the form of a file's first line with a time holds from there on."""
    line = truncated(F.col("line"))
    texts = [first_match(line, p) for p in GENERIC]
    stamps = [
        times.rfc3339(texts[0]),
        times.parsed(texts[1], "yyyy-MM-dd HH:mm:ss"),
        times.parsed(texts[2], "dd/MMM/yyyy:HH:mm:ss xx"),
        times.parsed(texts[3], "M/d/yyyy h:mm:ss a"),
    ]
    form = lines.select("path", "line_no", F.coalesce(*[F.when(s.isNotNull(), F.lit(i)) for i, s in enumerate(stamps)]).alias("form"))
    chosen = form.where("form is not null").groupBy("path").agg(F.min_by(F.struct("form", "line_no"), "line_no").alias("sticky"))
    rows = lines.join(chosen, "path", "left")  # a row for each file
    rows = rows.withColumn("form", F.when(F.col("line_no") >= F.col("sticky.line_no"), F.col("sticky.form")))
    # Only the file's own form is looked for.
    of_form = lambda columns: F.coalesce(*[F.when(F.col("form") == i, c) for i, c in enumerate(columns)])
    rows = evaluated(rows, ["path", "source", "line_no", "line", "form"], stamp=of_form(stamps), text=of_form(texts))
    # What looks like a time and is none stays in the message.
    rows = rows.withColumn("cut", F.when(F.col("stamp").isNotNull(), known(F.col("text"))))
    at = F.instr(F.col("line"), F.col("cut"))
    rest = trimmed(F.concat(F.substring("line", F.lit(1), at - 1), F.substring("line", at + F.length("cut"), F.length("line"))))
    zone = F.when(F.col("cut").rlike(r"(Z|[+-]\d{2}:?\d{2})\z") & (F.col("form") != 1), times.offset_minutes(F.col("cut")))
    return event(rows, timestamp=F.col("stamp"), event_type="LogEntry", message=F.when(F.col("cut").isNotNull(), rest).otherwise(F.col("line")), offset=zone)


def _years_on(t: Column, n: int) -> Column:
    """The same day n years on; a leap day that isn't there is the first of March."""
    at = lambda month, day: F.try_make_timestamp(F.year(t) + n, month, day, F.hour(t), F.minute(t), F.second(t))
    return F.coalesce(at(F.month(t), F.dayofmonth(t)), F.when(t.isNotNull(), at(F.lit(3), F.lit(1))))


def dated(rows: DataFrame, ctx: Context) -> DataFrame:
    """Adds ``ts`` to rows of ``full_ts`` (a time with a year, else null) and ``stamp`` (month, day and time).

    A stamp gets the reference year; the one before if it is November or December and now January or February, or if it
    would be over six months ahead; and the next one if that is nearer to the line above. A stamp that is no date has no time
    here and counts as now for the next line.
    """
    now = ctx.reference_time.astimezone(timezone.utc)
    t = F.when(F.col("full_ts").isNull(), times.parsed(F.concat(F.lit(f"{now.year} "), times.spaced(F.col("stamp"))), "yyyy MMM d HH:mm:ss"))
    ahead = F.lit(months_added(now, 6).isoformat()).cast("timestamp")
    past = (F.col("low") > ahead) | ((F.month("low") >= 11) if now.month <= 2 else F.lit(False))
    rows = rows.withColumn("low", t)
    rows = rows.withColumn("low", F.when(past, _years_on(F.col("low"), -1)).otherwise(F.col("low")))
    fixed = F.coalesce("full_ts", F.when(F.col("stamp").isNotNull() & F.col("low").isNull(), ctx.now))
    rows = rows.withColumn("high", F.coalesce(fixed, _years_on(F.col("low"), 1))).withColumn("valid", F.col("full_ts").isNotNull() | F.col("low").isNotNull()).withColumn("low", F.coalesce(fixed, "low"))
    rows = carried(rows.drop("stamp", "full_ts"), Rollover(), "late")
    return rows.withColumn("ts", F.when(F.col("valid"), F.when(F.col("late"), F.col("high")).otherwise(F.col("low"))))


def syslog(lines: DataFrame, ctx: Context) -> DataFrame:
    """Lines with a full time, or with one without a year, which is inferred along the file."""
    rows = _grouped(lines, full=SYSLOG_5424, old=SYSLOG_3164)
    g = lambda i: F.coalesce(_at("full", i), _at("old", i))
    hit = g(1).isNotNull()
    message = F.when(hit, F.concat(F.lit("["), g(3), F.lit("] "), g(4))).otherwise(F.col("line"))
    full_ts = F.when(F.col("full").isNotNull(), F.coalesce(times.rfc3339(_at("full", 1)), ctx.now))
    rows = rows.select(*_PLACE, hit.alias("hit"), g(2).alias("where"), message.alias("message"), _at("full", 1).alias("zoned"), full_ts.alias("full_ts"), F.when(F.col("full").isNull(), _at("old", 1)).alias("stamp"), *_split(rows))
    rows = dated(rows, ctx)
    return event(rows, timestamp=F.col("ts"), event_type=_raw_or(F.col("hit"), "Syslog"), host=F.col("where"), message=F.col("message"), default=ctx.now, offset=times.offset_minutes(F.col("zoned")))


def web_access(lines: DataFrame, ctx: Context) -> DataFrame:
    """Common and combined access logs."""
    rows = _grouped(lines, g=WEB)
    hit, request = F.col("g").isNotNull(), F.split(_at("g", 5), " ")
    message = F.concat(request[0], F.lit(" "), F.coalesce(F.try_element_at(request, F.lit(2)), F.lit("")), F.lit(" (Status: "), _at("g", 6).cast("int"), F.lit(")"))
    return event(rows, timestamp=times.parsed(_at("g", 4), "dd/MMM/yyyy:HH:mm:ss xx"), event_type=_raw_or(hit, "WebAccess"), user=F.nullif(_at("g", 3), F.lit("-")), host=_at("g", 1), message=F.when(hit, message).otherwise(F.col("line")), offset=times.offset_minutes(_at("g", 4)))


def windows_text(lines: DataFrame, ctx: Context) -> DataFrame:
    """Servicing, update and setup logs."""
    rows = _grouped(lines, a=WINDOWS_COMMA, b=WINDOWS_SLASH)
    g = lambda i: F.coalesce(_at("a", i), _at("b", i))
    message = F.when(g(1).isNotNull(), F.concat(F.lit("["), g(2), F.lit("] "), g(3))).otherwise(F.col("line"))
    return event(rows, timestamp=times.parsed(g(1), "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss"), event_type=_raw_or(g(1).isNotNull(), "WindowsLog"), message=message, default=ctx.now)


def windows_firewall(lines: DataFrame, ctx: Context) -> DataFrame:
    """Nine fields after a header of comment lines."""
    rows = _grouped(lines.where(~F.col("line").startswith("#")), g=WINDOWS_FIREWALL)
    rest = F.upper(_at("g", 9))
    way = F.when(rest.contains("RECEIVE"), " (RECEIVE)").when(rest.contains("SEND"), " (SEND)").otherwise("")
    message = F.concat(F.upper(_at("g", 3)), F.lit(" "), F.upper(_at("g", 4)), F.lit(" "), _at("g", 5), F.lit(":"), _at("g", 7), F.lit(" -> "), _at("g", 6), F.lit(":"), _at("g", 8), way)
    hit = F.col("g").isNotNull()
    stamp = times.parsed(F.concat_ws(" ", _at("g", 1), _at("g", 2)), "yyyy-MM-dd HH:mm:ss")
    return event(rows, timestamp=stamp, event_type=_raw_or(hit, "WindowsFirewall"), message=F.when(hit, message).otherwise(F.col("line")))


def iptables(lines: DataFrame, ctx: Context) -> DataFrame:
    """Kernel lines of KEY=value fields, in the reference year."""
    rows = _grouped(lines, g=IPTABLES).select("*", *[known(first_match(_at("g", 4), p)).alias(f"k_{k}") for k, p in IPTABLES_FIELDS.items()])
    k = lambda name: F.col(f"k_{name}")
    end = lambda host, port: F.when(host.isNotNull(), F.concat(host, F.coalesce(F.concat(F.lit(":"), port), F.lit(""))))
    way = F.when(k("in").isNotNull() & k("out").isNotNull(), "(FORWARD)").when(k("in").isNotNull(), "(IN)").when(k("out").isNotNull(), "(OUT)")
    message = F.concat_ws(" ", F.concat(F.lit("["), _at("g", 3), F.lit("]")), k("proto"), end(k("src"), k("spt")), F.lit("->"), end(k("dst"), k("dpt")), way)
    hit = F.col("g").isNotNull()
    stamp = times.parsed(F.concat(F.lit(f"{ctx.reference_time.year} "), times.spaced(_at("g", 1))), "yyyy MMM d HH:mm:ss")
    return event(rows, timestamp=stamp, event_type=_raw_or(hit, "Iptables"), host=_at("g", 2), message=F.when(hit, message).otherwise(F.col("line")))


def asa_action(message_id: Column, message: Column) -> Column:
    """ALLOW, DENY, CLOSE, DROP or INFO: by id where that decides, else by words."""
    m = F.upper(message)
    has = lambda *words: m.rlike("|".join(words))
    return (
        F.when(message_id.isin(*ASA_CONNECTIONS) & has("BUILT"), "ALLOW")
        .when(message_id.isin(*ASA_CONNECTIONS) & has("TEARDOWN"), "CLOSE")
        .when(message_id.isin(*ASA_DENY_IDS), "DENY")
        .when((message_id == ASA_ACL) & has("PERMITTED"), "ALLOW")
        .when(has("DENIED", "DENY"), "DENY")
        .when(has("PERMIT", "BUILT"), "ALLOW")
        .when(has("TEARDOWN"), "CLOSE")
        .when(has("DROP"), "DROP")
        .otherwise("INFO")
    )


def cisco_asa(lines: DataFrame, ctx: Context) -> DataFrame:
    """Firewall appliance messages with their action and ends."""
    rows = _grouped(lines, g=ASA)
    m = _at("g", 4)
    conn, denied = matches(m, ASA_CONNECTION), matches(m, ASA_DENIED)
    part = lambda c, d: known(F.when(conn, first_match(m, ASA_CONNECTION, c)).when(denied, first_match(m, ASA_DENIED, d)))
    proto = F.when(F.upper(m).contains("TCP"), "TCP").when(F.upper(m).contains("UDP"), "UDP").when(F.upper(m).contains("ICMP"), "ICMP")
    end = lambda host, port: F.concat(host, F.coalesce(F.concat(F.lit(":"), port), F.lit("")))
    tag = F.concat(F.lit("[ASA-"), _at("g", 2), F.lit("-"), _at("g", 3), F.lit("]"))
    message = F.concat_ws(" ", tag, asa_action(_at("g", 3), m), proto, end(part(2, 1), part(3, 2)), F.concat(F.lit("-> "), end(part(5, 3), part(6, 4))), F.lit("-"), m)
    hit = F.col("g").isNotNull()
    stamp = times.parsed(times.spaced(_at("g", 1)), "MMM d yyyy HH:mm:ss")
    return event(rows, timestamp=stamp, event_type=_raw_or(hit, "CiscoASA"), event_id=F.when(hit, F.coalesce(_at("g", 3).try_cast("bigint"), F.lit(0))).otherwise(F.col("line_no")), message=F.when(hit, message).otherwise(F.col("line")))


def _mac_time(c: Column) -> Column:
    return F.when(~c.rlike(r"\d\s{2,}\d"), times.parsed(times.fraction_cut(times.spaced(c)), "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S][xx]"))


def macos_unified(lines: DataFrame, ctx: Context) -> DataFrame:
    rows = _grouped(lines, g=UNIFIED)
    hit = F.col("g").isNotNull()
    who = F.concat(F.lit("["), trimmed(_at("g", 3)), F.lit("("), F.coalesce(_at("g", 4).try_cast("bigint").cast("string"), F.lit("0")), F.lit(")]"))
    message = F.concat_ws(" ", who, F.concat(F.lit("("), known(_at("g", 5)), F.lit(")")), _at("g", 6))
    return event(rows, timestamp=_mac_time(_at("g", 1)), event_type=_raw_or(hit, "UnifiedLog"), host=_at("g", 2), message=F.when(hit, message).otherwise(F.col("line")), default=ctx.now, offset=F.when(_at("g", 1).rlike(r"[+-]\d{4}\z"), times.offset_minutes(_at("g", 1))))


def macos_install(lines: DataFrame, ctx: Context) -> DataFrame:
    """Times with an offset of hours; else the unified form."""
    rows = _grouped(lines, a=INSTALL, b=UNIFIED_PLAIN)
    g = lambda i: F.coalesce(_at("a", i + 1), _at("b", i))
    a = F.col("a").isNotNull()
    stamp = F.when(a, _mac_time(F.concat(_at("a", 1), _at("a", 2), F.lit("00")))).otherwise(_mac_time(_at("b", 1)))
    hit = a | F.col("b").isNotNull()
    message = F.concat(F.lit("["), trimmed(g(3)), F.lit("("), F.coalesce(g(4).try_cast("bigint").cast("string"), F.lit("0")), F.lit(")] "), g(5))
    return event(rows, timestamp=stamp, event_type=_raw_or(hit, "InstallLog"), host=g(2), message=F.when(hit, message).otherwise(F.col("line")), default=ctx.now, offset=times.offset_minutes(F.coalesce(_at("a", 2), F.when(_at("b", 1).rlike(r"[+-]\d{4}\z"), _at("b", 1)))))


def macos_asl(lines: DataFrame, ctx: Context) -> DataFrame:
    """System log lines with a level, with or without a process id; years are inferred along the file."""
    rows = _grouped(lines, a=ASL, b=ASL_NO_PID)
    with_pid = F.concat(F.lit("["), trimmed(_at("a", 3)), F.lit("("), F.coalesce(_at("a", 4).try_cast("bigint").cast("string"), F.lit("0")), F.lit(")] <"), _at("a", 5), F.lit("> "), _at("a", 6))
    plain = F.concat(F.lit("["), trimmed(_at("b", 3)), F.lit("] <"), _at("b", 4), F.lit("> "), _at("b", 5))
    hit = F.col("a").isNotNull() | F.col("b").isNotNull()
    stamp = F.coalesce(_at("a", 1), _at("b", 1))
    rows = rows.select(*_PLACE, hit.alias("hit"), F.coalesce(_at("a", 2), _at("b", 2)).alias("where"), F.coalesce(with_pid, plain, F.col("line")).alias("message"), F.lit(None).cast("timestamp").alias("full_ts"), stamp.alias("stamp"), *_split(rows))
    rows = dated(rows, ctx)
    return event(rows, timestamp=F.col("ts"), event_type=_raw_or(F.col("hit"), "ASL"), host=F.col("where"), message=F.col("message"), default=ctx.now)
