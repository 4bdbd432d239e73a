"""Queries through files: rows of the tables are rendered into files, and what is read back from them is compared.

A query's files are written by executors below ``spark.checkpoint.dir``: one for each part of the rows, named by the driver
afterwards, which moves nothing. They stay, as the result reads them.
"""

from __future__ import annotations

import sqlite3
import tempfile
import uuid
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import browser
from ..sinks import writers
from ..sinks.batches import append_batch, read_batches
from ..sinks.time_index import read_between, read_zones, write_indexed
from ..sources.sqlite import history_in
from .catalog import _MONITOR_SQL, _WEB_SQL, CTX, ORACLES, _event_xml, _s, _sunk, query, said, table
from .timeline import Timeline, build_timeline

PARTS = 4
#: Keys of the events of a part that are one document: some 200 MB. More is more documents, which are written apart.
SLICE = 1 << 20
#: Places of a file that are put in order together: 2 to this.
STRETCH_BITS = 13
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see; a local one only where the session names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
    where = where or "file://" + tempfile.mkdtemp(prefix="timeloom-files-")
    return f"{where.rstrip('/')}/timeloom/files-{name}-{uuid.uuid4().hex}"


def _write(rows: DataFrame, folder: str, name: str) -> None:
    """Rows (part, place, value) as files folder/part/name, the values of each in order of place; with ``slice``, folder/slice/part/name.

    Values are put in order by stretches of places, in parallel; the task that writes a file only puts the stretches' texts together.
    """
    spark, raw = rows.sparkSession, f"{folder}-raw/{uuid.uuid4().hex}"
    by = [c for c in ("slice", "part") if c in rows.columns]
    found = F.sort_array(F.collect_list(F.struct("place", F.coalesce("value", F.lit("")).alias("value"))))
    rows = rows.groupBy(*by, F.shiftright(F.col("place").cast("bigint"), STRETCH_BITS).alias("stretch")).agg(found.alias("found"))
    texts = rows.select(*by, "stretch", F.array_join("found.value", "\n").alias("value"))
    texts.repartition(*by).sortWithinPartitions(*by, "stretch").select(*by, "value").write.partitionBy(*by).text(raw)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(raw).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(path("/".join([raw, *[f"{c}=*" for c in by], "part-*"]))):
        own = "/".join(x.partition("=")[2] for x in found.getPath().getParent().toString().split("/")[-len(by) :])
        fs.mkdirs(path(f"{folder}/{own}"))
        fs.rename(found.getPath(), path(f"{folder}/{own}/{name}"))


def _shown(events: DataFrame) -> DataFrame:
    """What is compared of events, with the part and the name of their file."""
    part = F.regexp_extract("path", r"/(\d+)/[^/]+\z", 1).cast("bigint").alias("part")
    return said(events, "source", part)


def _events(spark: SparkSession, sf: str, value: Column | None = None) -> DataFrame:
    e = table(spark, sf, "events").withColumn("part", F.col("event_id") % PARTS).withColumn("place", F.col("event_id"))
    return e if value is None else e.select("part", "place", value.alias("value"))


def _key() -> Column:
    return F.col("event_id").cast("string")


#: Events with their part and their number in it.
_E_SQL = f"(SELECT *, event_id % {PARTS} AS part, row_number() OVER (PARTITION BY event_id % {PARTS} ORDER BY event_id) AS n FROM events)"
_TS = "epoch_us(date_trunc('second', ts))"


def _logs(spark: SparkSession, sf: str) -> str:
    """Four formats: blank lines after requests, returns at the ends of system messages, remarks above firewall lines."""
    folder, us = _folder(spark, "logs"), F.col("user_id").cast("string")
    web = _s("10.0.0.", (F.col("user_id") % 256).cast("string"), " - ", F.when(F.col("user_id") % 3 == 0, "-").otherwise(_s("u", us)), " [", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET /', F.col("event_type"), "/", _key(), ' HTTP/1.1" ', F.when(F.col("event_type") == "error", "500").otherwise("200"), ' 12 "-" "agent"\n  ')
    _write(_events(spark, sf, web), folder, "access.log")
    _write(_events(spark, sf, _s(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "Z h", us, " ", F.col("event_type"), "[", _key(), "]: value\r")), folder, "syslog")
    _write(_events(spark, sf, _s("#remark\n", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), " drop tcp 10.1.0.1 10.2.0.1 ", us, " 443 0 - 0 - send")), folder, "pfirewall.log")
    _write(_events(spark, sf, _s(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), ", Info   ", F.col("event_type"))), folder, "cbs.log")
    return folder


_LOGS_SQL = f"""SELECT w.ts_us, w.event_type, 2 * n - 1 AS event_id, w."user", w.host, w.message, 'access.log' AS source, part FROM ({_WEB_SQL}) w JOIN {_E_SQL} e ON e.event_id + 1 = w.event_id
UNION ALL SELECT {_TS}, 'Syslog', n, '', 'h' || user_id, '[' || event_type || '[' || event_id || ']] value', 'syslog', part FROM {_E_SQL}
UNION ALL SELECT {_TS}, 'WindowsFirewall', 2 * n, '', '', 'DROP TCP 10.1.0.1:' || user_id || ' -> 10.2.0.1:443 (SEND)', 'pfirewall.log', part FROM {_E_SQL}
UNION ALL SELECT {_TS}, 'WindowsLog', n, '', '', '[Info] ' || event_type, 'cbs.log', part FROM {_E_SQL}"""


@query(_LOGS_SQL)
def files_logs(spark, sf):
    """Discovered, routed, read by line, parsed and put together."""
    return _shown(build_timeline(spark, _logs(spark, sf), context=CTX).events)


@query(f"SELECT * FROM ({_LOGS_SQL}) WHERE source IN ('access.log', 'syslog') AND regexp_matches(message, 'error|purchase')")
def files_filtered(spark, sf):
    """The same with a pattern and two parsers alone."""
    return _shown(build_timeline(spark, _logs(spark, sf), pattern="error|purchase", only={"web", "syslog"}, context=CTX).events)


@query(f"SELECT ts_us, source, event_id FROM ({_LOGS_SQL}) ORDER BY 1, 2, 3 LIMIT 500")
def files_ordered_head(spark, sf):
    """The first of a timeline in order of time, source and number."""
    return _shown(build_timeline(spark, _logs(spark, sf), ordered=True, context=CTX).events).select("ts_us", "source", "event_id").orderBy("ts_us", "source", "event_id").limit(500)


def _mixed_files(spark: SparkSession, sf: str) -> Timeline:
    r, folder = table(spark, sf, "region").select(F.col("r_regionkey").alias("part"), F.lit(0).alias("place"), "r_name"), _folder(spark, "mixed")
    for name, value in {"access.log": F.col("r_name"), "x.pf": F.lit("MAM"), "shellbags.dat": F.lit("x"), "bad.json": F.lit('[{"a": 1}, {'), "good.json": _s('{"message": "', F.col("r_name"), '"}'), "bad.xml": F.lit("<a><b/>"), "notes": F.lit("")}.items():
        _write(r.select("part", "place", value.alias("value")), folder, name)
    return build_timeline(spark, folder, f"{folder}/0", context=CTX)


_MIXED_SQL = "(VALUES ('access.log', 'web', 1, 1, false, 1), ('x.pf', 'prefetch', 4, 0, true, 0), ('shellbags.dat', 'shellbags', 2, 0, true, 0), ('bad.json', 'json', 13, 0, true, 0), ('good.json', 'json', 16, 1, false, 1), ('bad.xml', 'generic_xml', 8, 0, true, 0), ('notes', 'log', 1, 0, false, 0)) v(source, parser, base, names, failed, events)"


@query(f"SELECT r_regionkey AS part, source, parser, CAST(base + names * length(r_name) AS BIGINT) AS size, failed FROM region, {_MIXED_SQL}")
def files_listed(spark, sf):
    """Files of two inputs, one inside the other, each once, with what could not be read."""
    t = _mixed_files(spark, sf)
    failed = t.errors.select("path").distinct().withColumn("failed", F.lit(True))
    rows = t.files.select("path", "parser", "size").join(failed, "path", "left")
    return rows.select(F.regexp_extract("path", r"/(\d+)/[^/]+\z", 1).cast("int").alias("part"), F.regexp_extract("path", r"[^/]+\z", 0).alias("source"), "parser", "size", F.coalesce("failed", F.lit(False)).alias("failed"))


@query(f"SELECT r_regionkey AS part, source, r_name AS message FROM region, {_MIXED_SQL} WHERE events = 1")
def files_beside_bad(spark, sf):
    """All events of files that lie beside unreadable ones."""
    return _shown(_mixed_files(spark, sf).events).where("source <> 'bad.xml'").select(F.col("part").cast("int"), "source", "message")


@query(f"""SELECT {_TS} AS ts_us, event_type, 2 * n AS event_id, CAST(user_id AS VARCHAR) AS "user", 'pc' AS host, 'FileName=a; "q"' || chr(10) || 'b' || event_id || ' | Type=' || event_type || ' | UserName=' || user_id || ' | ComputerName=pc' AS message, 'mft.csv' AS source, part FROM {_E_SQL}""")
def files_csv(spark, sf):
    """A byte order mark, semicolons, quoted breaks, and an empty record after each."""
    folder, e = _folder(spark, "csv"), _events(spark, sf)
    head = e.select("part").distinct().select("part", F.lit(-1).cast("bigint").alias("place"), F.lit("\ufeffCreated0x10;FileName;Type;UserName;ComputerName").alias("value"))
    row = _s(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), ';"a; ""q""\nb', _key(), '";', F.col("event_type"), ";", F.col("user_id").cast("string"), ";pc\n;;;;")
    _write(head.union(e.select("part", "place", row.alias("value"))), folder, "mft.csv")
    return _shown(build_timeline(spark, folder, context=CTX).events)


@query(f"""SELECT {_TS} AS ts_us, 'CloudTrail:s3:' || event_type AS event_type, n AS event_id, 'u' || user_id AS "user", '1.1.1.1' AS host, 'Action: ' || event_type || ' | Service: s3 | Region: eu | SourceIP: 1.1.1.1' || CASE WHEN event_id % 5 = 0 THEN ' | Error: E' ELSE '' END AS message, 'trail.jsonl' AS source, part FROM {_E_SQL}""")
def files_cloud_lines(spark, sf):
    """Records one a line, known by their content."""
    folder = _folder(spark, "cloud")
    obj = _s('{"eventTime":"', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), 'Z","eventSource":"s3","eventName":"', F.col("event_type"), '","awsRegion":"eu","sourceIPAddress":"1.1.1.1","userIdentity":{"userName":"u', F.col("user_id").cast("string"), '"}', F.when(F.col("event_id") % 5 == 0, ',"errorCode":"E"').otherwise(""), "}")
    _write(_events(spark, sf, obj), folder, "trail.jsonl")
    return _shown(build_timeline(spark, folder, context=CTX).events)


def _event_files(spark, sf, provider: str, name: str) -> DataFrame:
    folder, o = _folder(spark, "xml"), _event_xml(spark, sf, provider)
    key = F.regexp_extract("text", "<EventID>(\\d+)", 1).cast("bigint")
    rows = o.select(F.floor(key / SLICE).alias("slice"), (key % PARTS).alias("part"), key.alias("place"), F.col("text").alias("value"))
    ends = rows.select("slice", "part").distinct().select("slice", "part", F.explode(F.array(F.struct(F.lit(-1).cast("bigint").alias("place"), F.lit("<Events>").alias("value")), F.struct(F.lit((1 << 63) - 1).alias("place"), F.lit("</Events>").alias("value")))).alias("x")).select("slice", "part", "x.*")
    _write(rows.union(ends), folder, name)
    return _shown(build_timeline(spark, folder, context=CTX).events)


@query(f"SELECT *, 'sec.xml' AS source, event_id % {PARTS} AS part FROM ({ORACLES['winxml_parse']})")
def files_event_xml(spark, sf):
    """Documents of many events each, known by their content."""
    return _event_files(spark, sf, "Prov", "sec.xml")


@query(f"SELECT count(*) AS events, count(DISTINCT part) AS files FROM (SELECT o_orderkey % {PARTS} AS part FROM orders LEFT JOIN {_MONITOR_SQL} ON o_orderkey = id)")
def files_monitor_events(spark, sf):
    """Events of the system monitor, which a document's provider gives away."""
    found = _event_files(spark, sf, "Other", "mon.xml")
    return found.agg(F.count("*").alias("events"), F.countDistinct("part").alias("files"))


def _nations(spark: SparkSession, sf: str, value: Column, before: str, after: str) -> DataFrame:
    """A value for each nation in a file for its region, between a first and a last one."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("part"), F.col("n_nationkey").alias("place"), "n_name")
    ends = [n.select("part").distinct().select("part", F.lit(p).alias("place"), F.lit(v).alias("value")) for p, v in ((-1, before), (1 << 30, after))]
    return n.select("part", "place", value.alias("value")).union(ends[0]).union(ends[1])


_N_SQL = "(SELECT n_name, n_regionkey AS part, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation)"


@query(f"""SELECT 'SysmonConfig:ProcessCreate' AS event_type, n AS event_id, 'RuleGroup: g' || n_name || ' | OnMatch: include | Image[is]=' || n_name AS message, CAST(part AS BIGINT) AS part FROM {_N_SQL}
UNION ALL SELECT DISTINCT 'SysmonConfig:Settings', 0, 'Sysmon Configuration | SchemaVersion: 4.2 | HashAlgorithms: md5', CAST(n_regionkey AS BIGINT) FROM nation""")
def files_monitor_config(spark, sf):
    folder = _folder(spark, "config")
    rule = _s('<RuleGroup name="g', F.col("n_name"), '"><ProcessCreate onmatch="include"><Image condition="is">', F.col("n_name"), "</Image></ProcessCreate></RuleGroup>")
    _write(_nations(spark, sf, rule, '<Sysmon schemaversion="4.2"><HashAlgorithms>md5</HashAlgorithms><EventFiltering>', "</EventFiltering></Sysmon>"), folder, "sysmon.xml")
    return _shown(build_timeline(spark, folder, context=CTX).events).select("event_type", "event_id", "message", "part")


@query(f"""SELECT epoch_us(TIMESTAMP '2023-04-21 15:30:45') AS ts_us, 'PowerShellCommand' AS event_type, n AS event_id, 'D\\u' AS "user", 'Command: say ' || n_name || ' | Output: ' || n_name AS message, CAST(part AS BIGINT) AS part FROM {_N_SQL}
UNION ALL SELECT DISTINCT epoch_us(TIMESTAMP '2023-04-21 15:30:45'), 'PowerShellTranscriptStart', 0, 'D\\u', 'PowerShell session started. Host: ps.exe, RunAs: D\\u', CAST(n_regionkey AS BIGINT) FROM nation
UNION ALL SELECT DISTINCT epoch_us(TIMESTAMP '2023-04-21 16:31:47'), 'PowerShellTranscriptEnd', 0, 'D\\u', 'PowerShell session ended. Duration: 1h1m2s', CAST(n_regionkey AS BIGINT) FROM nation""")
def files_transcripts(spark, sf):
    """Sessions with their start, commands, output and end."""
    folder, stars = _folder(spark, "transcripts"), "*" * 22
    before = f"{stars}\nWindows PowerShell transcript start\nStart time: 20230421153045\nUsername: D\\u\nRunAs User: D\\u\nMachine: PC1 (x)\nHost Application: ps.exe\n{stars}"
    after = f"{stars}\nWindows PowerShell transcript end\nEnd time: 20230421163147\n{stars}"
    _write(_nations(spark, sf, _s("PS C:\\> say ", F.col("n_name"), "\n", F.col("n_name")), before, after), folder, "session.txt")
    return _shown(build_timeline(spark, folder, context=CTX).events).select("ts_us", "event_type", "event_id", "user", "message", "part")


@query(f"""SELECT epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS ts_us, '[Part ' || n || '/9] Path: C:\\a.ps1 | Script: if (1 < 2) {{ ' || n_name || ' }}' AS message, CAST(part AS BIGINT) AS part FROM {_N_SQL}""")
def files_script_blocks(spark, sf):
    """Blocks in tags, with their numbers and the path of their script."""
    folder = _folder(spark, "scripts")
    n = table(spark, sf, "nation")
    number = n.select("n_nationkey", F.row_number().over(_by_region()).alias("n"), F.col("n_regionkey").alias("part"), "n_name")
    value = _s("2024-01-01T00:00:00Z MessageNumber=", F.col("n").cast("string"), " MessageTotal=9 Path=C:\\a.ps1 <ScriptBlockText>if (1 &lt; 2) { ", F.col("n_name"), " }</ScriptBlockText>")
    _write(number.select("part", F.col("n_nationkey").alias("place"), value.alias("value")), folder, "4104.txt")
    return _shown(build_timeline(spark, folder, context=CTX).events).select("ts_us", "message", "part")


def _by_region():
    from pyspark.sql import Window

    return Window.partitionBy("n_regionkey").orderBy("n_nationkey")


def _database(rows: pd.DataFrame) -> pd.DataFrame:
    """A browser's history of one page as the bytes of a database."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE urls(id INTEGER, url TEXT, title TEXT, visit_count INTEGER)")
    db.execute("CREATE TABLE visits(url INTEGER, visit_time INTEGER)")
    first = rows.iloc[0]
    db.execute("INSERT INTO urls VALUES (?, ?, NULL, ?)", (int(first["page_id"]), first["url"], int(first["page_id"]) % 9))
    db.executemany("INSERT INTO visits VALUES (?, ?)", [(int(p), int(t)) for p, t in zip(rows["page_id"], rows["clock"], strict=True)])
    db.commit()
    content = db.serialize()
    db.close()
    return pd.DataFrame({"path": [f"/chrome/{first['page_id']}/History"], "content": [content]})


@query("SELECT epoch_us(date_trunc('second', e.ts)) AS ts_us, 'Visited: ' || p.url || ' (visit count: ' || (p.page_id % 9) || ')' AS message, count(*) AS visits FROM pages p JOIN events e ON e.user_id % 50 = p.page_id GROUP BY ALL")
def files_history(spark, sf):
    """A database for each page visited, made and read in executors."""
    e = table(spark, sf, "events").select((F.col("user_id") % 50).alias("page_id"), (F.unix_micros("ts") + F.lit(11_644_473_600_000_000)).alias("clock"))
    made = e.join(table(spark, sf, "pages").select("page_id", "url"), "page_id").groupBy("page_id").applyInPandas(_database, "path string, content binary")
    events = browser.visits(*history_in(made, "chrome"), "chrome", CTX)
    return events.groupBy(F.unix_micros("timestamp").alias("ts_us"), "message").agg(F.count("*").alias("visits"))


@query(ORACLES["csv_sink_format"])
def files_csv_sink(spark, sf):
    """Written as CSV and read back."""
    folder = _folder(spark, "csv-sink")
    writers.write_csv(_sunk(spark, sf), folder)
    back = spark.read.csv(folder, header=True, escape='"')
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])  # an empty field is read as a null


@query(ORACLES["jsonl_sink_format"])
def files_jsonl_sink(spark, sf):
    """Written as JSON Lines and read back."""
    folder = _folder(spark, "jsonl-sink")
    writers.write_jsonl(_sunk(spark, sf), folder)
    return spark.read.text(folder)


@query("SELECT value, 'b' || (CAST(regexp_extract(value, '\"event_id\":(\\d+)', 1) AS BIGINT) % 3) AS batch FROM (" + ORACLES["jsonl_sink_format"] + ")")
def files_batches(spark, sf):
    """Written in three batches, each of them twice, and read back."""
    folder, events = _folder(spark, "batches"), _sunk(spark, sf)
    for i in (0, 1, 1, 2, 0, 2):
        append_batch(events.where(F.col("event_id") % 3 == i), folder, "jsonl", f"b{i}")
    return read_batches(spark, folder, "jsonl")


@query("""SELECT epoch_us(ts) AS ts_us, event_id, event_type AS message FROM events, (SELECT min(ts) AS low, max(ts) AS high FROM events WHERE event_id % 2 = 0)
WHERE event_id % 2 = 0 AND epoch_us(ts) >= epoch_us(low) + (epoch_us(high) - epoch_us(low)) // 4 AND epoch_us(ts) < epoch_us(low) + (epoch_us(high) - epoch_us(low)) // 2""")
def files_time_range(spark, sf):
    """Written in ranges of time; of the files, those of the second quarter are read."""
    folder, events = _folder(spark, "time-range"), _sunk(spark, sf)
    write_indexed(events, folder, 16)
    low, high = read_zones(spark, folder).agg(F.unix_micros(F.min("first")), F.unix_micros(F.max("last"))).first()
    at = lambda part: EPOCH + timedelta(microseconds=low + (high - low) // part)
    return read_between(spark, folder, at(4), at(2)).select(F.unix_micros("timestamp").alias("ts_us"), "event_id", "message")
