"""Files written to a folder, routed, parsed and put in one timeline."""

import csv
import json
import sqlite3
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from timeloom.plans.timeline import build_timeline
from timeloom.schema import Context
from timeloom.sinks import writers

NOW = Context(datetime(2024, 1, 15, 12, tzinfo=timezone.utc))
EVENT = """<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="{p}"/><EventID{q}>{i}</EventID><Level>{l}</Level><TimeCreated SystemTime="2023-04-21T15:30:45.1234567Z"/><Channel>{c}</Channel><Computer>PC1</Computer><Security UserID="S-1-5-18"/></System><EventData><Data Name="User">bob</Data><Data Name="Image">C:\\x.exe</Data><Data Name="Empty"/><Data Name="Long">{long}</Data></EventData></Event>"""
FILES = {
    "syslog": "2023-01-01T12:00:00Z myhost myapp[123]: Test message\n\nDec 31 23:59:59 oldhost sshd[1]: late\r\nJan 1 00:00:01 oldhost sshd[1]: early\nnot syslog\n",
    "auth.log": "Jan 01 12:00:00 oldhost sshd[456]: Failed password\n",
    "access.log": '127.0.0.1 - jdoe [21/Apr/2023:15:30:45 +0200] "GET /index.html HTTP/1.1" 200 1234 "http://referer.com" "Mozilla/5.0"\n1.2.3.4 - - [bad] "GET" 404 -\nnonsense\n',
    "cbs.log": "2023-04-21 15:30:45, Info                  Cbs    Starting TrustedInstaller...\nplain\n",
    "WindowsUpdate.log": "2023/04/21 15:30:45 1234 5678 Misc Validating signature...\n",
    "pfirewall.log": "#Version: 1.5\n2023-04-21 15:30:45 allow tcp 10.0.0.1 10.0.0.2 49152 443 0 - 0 0 0 - - - RECEIVE\n2023-04-21 15:30:45 DROP UDP 10.0.0.1 10.0.0.2 - - rest\n",
    "ufw.log": "Apr 21 15:30:45 gw kernel: [UFW BLOCK] IN=eth0 OUT= SRC=1.2.3.4 DST=5.6.7.8 PROTO=TCP SPT=1 DPT=22\nApr 21 15:30:45 gw kernel: [X] IN=a OUT=b DST=5.6.7.8\n",
    "cisco.txt": "Apr 21 2023 15:30:45: %ASA-6-302013: Built outbound TCP connection 1 for outside:1.2.3.4/443 (1.2.3.4/443) to inside:10.0.0.1/5000 (x)\nApr 21 2023 15:30:45: %ASA-4-106023: Deny udp src outside:1.2.3.4/53 dst inside:10.0.0.9/99\nApr 21 2023 15:30:45: %ASA-5-999999: dropping it\n",
    "unified.txt": "2023-04-21 15:30:45.123456-0700 mac1 kernel[0]: (IOKit) hello\n2023-04-21 15:30:45 mac1 app[12]: plain\nraw\n",
    "install.log": "2023-04-21 15:30:45-07 mac1 installer[99]: PackageKit: done\n",
    "system.log": "Apr 21 15:30:45 mac1 syslogd[1] <Notice>: hi\nApr 21 15:30:46 mac1 kernel <Error>: bad\n",
    "u_ex230421.log": "#Software: IIS\n#Fields: date time s-ip cs-method cs-uri-stem cs-uri-query s-port cs-username c-ip cs(User-Agent) sc-status sc-substatus sc-win32-status time-taken\n2023-04-21 15:30:45 10.0.0.1 GET /a q=1 80 - 9.9.9.9 " + "U" * 120 + " 404 2 5 15\nshort row\n#Fields: date time c-ip cs-method\n2023-04-22 01:02:03 8.8.8.8 POST\n",
    "zeek/conn.log": "#separator \\x09\n#empty_field\t(empty)\n#unset_field\t-\n#path\tconn\n#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tservice\tduration\n1682087445.123456\tC1\t10.0.0.1\t1000\t10.0.0.2\t53\tudp\t-\t0.5\n",
    "x509.log": "#fields\tts\tcertificate.subject\tcertificate.serial\n#path\tx509\n1682087445\tCN=a\t01\n",
    "app.txt": "start\n2023-04-21T15:30:45Z one 2023-04-21T15:30:45Z\n2023-04-21 15:30:46 two\n2023-04-21T15:30:47+01:00 three\n",
    "odd.txt": "2023-04-21 15:30:45 first\n2024-13-45 10:00:00 second\n",
    "access.log.1": '21/Apr/2023:15:30:45 +0000 rotated\n',
    "events.json": '[{"timestamp":"2023-04-21T15:30:45+02:00","event_type":"A","event_id":7.9,"user":"u","host":3,"message":"m"}, 5, {"timestamp":5}]',
    "one.json": '{\n "message": "alone"\n}',
    "bad.json": '[{"a": 1}, {',
    "cloudtrail.json": '{"Records":[{"eventTime":"2023-04-21T15:30:45Z","eventSource":"s3.amazonaws.com","eventName":"GetObject","awsRegion":"eu","sourceIPAddress":"1.1.1.1","userIdentity":{"arn":"arn:x"},"errorCode":"E"}]}',
    "cloudtrail2.jsonl": '{"eventName":"A"}\nbad\n{"eventName":"B"}\n',
    "azure.json": '{"value":[{"time":"2023-04-21T15:30:45Z","operationName":"op","resourceId":"' + "r" * 120 + '","identity":{"claims":{"http://schemas.xmlsoap.org/ws/2005/05/identity/claims/upn":"u@x"}}}]}',
    "gcp.jsonl": '{"timestamp":"2023-04-21T15:30:45.5Z","protoPayload":{"methodName":"m","serviceName":"s","authenticationInfo":{"principalEmail":"e"},"requestMetadata":{"callerIp":"2.2.2.2"}},"resource":{"type":"t","labels":{"project_id":"p"}},"severity":"INFO"}\n',
    "mft.csv": '\ufeffCreated0x10,FileName,Owner,ComputerName\n1/2/2024 01:00:00,"a, b",bob,pc\n13/2/2024 01:00:00,c,-,pc\n1682087445,d,,\n1682087445123,e,,\n133265610450000000,f,,\n',
    "semi.csv": "time;message\n2023-04-21 15:30:45;hello\n",
    "sec.xml": "<Events>" + EVENT.format(p="Prov", q=' Qualifiers="0"', i=4624, l=4, c="Security", long="x" * 120) + "</Events>",
    "task.xml": '<?xml version="1.0" encoding="UTF-16"?><Task xmlns="http://schemas.microsoft.com/windows/2004/02/mit/task"><RegistrationInfo><Date>2023-04-21T15:30:45</Date><Author>me</Author><URI>\\t</URI></RegistrationInfo><Triggers><LogonTrigger><Enabled>true</Enabled><UserId>u1</UserId></LogonTrigger><TimeTrigger><StartBoundary>s</StartBoundary></TimeTrigger></Triggers><Actions><Exec><Command>cmd</Command><Arguments>/c</Arguments></Exec><Exec><Command>b</Command></Exec><ComHandler><ClassId>{1}</ClassId></ComHandler></Actions></Task>',
    "sysmon.xml": '<Sysmon schemaversion="4.2"><HashAlgorithms>md5</HashAlgorithms><EventFiltering><RuleGroup name="g"><ProcessCreate onmatch="include"><Image condition="is">x</Image></ProcessCreate></RuleGroup><DnsQuery onmatch="exclude"/></EventFiltering></Sysmon>',
    "other.xml": '<r><a k="v"><b/></a><a><b><c/></b></a></r>',
    "session_transcript.txt": "*" * 22 + "\nWindows PowerShell transcript start\nStart time: 20230421153045\nUsername: D\\u\nRunAs User: D\\v\nMachine: PC1 (x)\nHost Application: ps.exe\n" + "*" * 22 + "\nPS C:\\> dir\nfile1\n\nfile2\nPS C:\\> whoami\n" + "*" * 22 + "\nWindows PowerShell transcript end\nEnd time: 20230421163147\n" + "*" * 22 + "\n",
    "4104.txt": "2023-04-21T15:30:45Z MessageNumber=1 MessageTotal=2 Path=C:\\a.ps1 <ScriptBlockText>if (1 &lt; 2) { &amp;lt; }</ScriptBlockText>\n<ScriptBlockText>first\nsecond</ScriptBlockText>\nScriptBlockText: third\n",
    "x.pf": "MAM", "shellbags.dat": "x",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("case")
    for name, text in FILES.items():
        p = root / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(text.encode())
    for name, ddl in {
        "Chrome/History": "CREATE TABLE urls(id, url, title, visit_count); CREATE TABLE visits(url, visit_time); INSERT INTO urls VALUES (1,'http://a/x',NULL,3),(2,'http://b','B',1); INSERT INTO visits VALUES (1,13326561045000000),(2,13326561046999999),(9,1);",
        "firefox/places.sqlite": "CREATE TABLE moz_places(id, url, title, visit_count); CREATE TABLE moz_historyvisits(place_id, visit_date); INSERT INTO moz_places VALUES (1,'http://f','F',2); INSERT INTO moz_historyvisits VALUES (1,1682087445123456);",
        "Safari/History.db": "CREATE TABLE history_items(id, url, visit_count); CREATE TABLE history_visits(history_item, visit_time); INSERT INTO history_items VALUES (1,'https://www.s.com/p',4); INSERT INTO history_visits VALUES (1,703780245.5);",
    }.items():
        (root / name).parent.mkdir(exist_ok=True)
        db = sqlite3.connect(root / name)
        db.executescript(ddl)
        db.close()
    return root


@pytest.fixture(scope="module")
def by_file(spark, folder):
    out = {}
    for r in build_timeline(spark, str(folder), context=NOW).events.collect():
        out.setdefault(r.path.removeprefix(str(folder) + "/"), []).append(r)
    return {k: sorted(v, key=lambda r: (r.event_id, r.event_type, r.message)) for k, v in out.items()}


def shown(rows, *fields):
    return [tuple(getattr(r, f) for f in fields) for r in rows]


def at(*parts):
    return datetime(*parts)


def test_syslog(by_file):
    rows = by_file["syslog"]
    assert shown(rows, "event_id", "event_type", "host", "message") == [(1, "Syslog", "myhost", "[myapp[123]] Test message"), (3, "Syslog", "oldhost", "[sshd[1]] late"), (4, "Syslog", "oldhost", "[sshd[1]] early"), (5, "SyslogRaw", "", "not syslog")]
    assert shown(rows, "timestamp") == [(at(2023, 1, 1, 12),), (at(2023, 12, 31, 23, 59, 59),), (at(2024, 1, 1, 0, 0, 1),), (at(2024, 1, 15, 12),)]
    assert rows[3].ts_status == "ingest_default" and rows[0].tz_offset_min == 0
    assert shown(by_file["auth.log"], "timestamp", "message") == [(at(2024, 1, 1, 12), "[sshd[456]] Failed password")]


def test_web(by_file):
    a, b, c = by_file["access.log"]
    assert (a.event_type, a.host, a.user, a.message, a.timestamp, a.tz_offset_min) == ("WebAccess", "127.0.0.1", "jdoe", "GET /index.html (Status: 200)", at(2023, 4, 21, 13, 30, 45), 120)
    assert (b.user, b.message, b.timestamp, b.ts_status) == ("", "GET  (Status: 404)", None, "missing")
    assert (c.event_type, c.message) == ("WebAccessRaw", "nonsense")
    assert shown(by_file["access.log.1"], "event_type", "message") == [("LogEntry", "rotated")]


def test_windows_text(by_file):
    assert shown(by_file["cbs.log"], "event_type", "message") == [("WindowsLog", "[Info] Cbs    Starting TrustedInstaller..."), ("WindowsLogRaw", "plain")]
    assert shown(by_file["WindowsUpdate.log"], "message", "timestamp") == [("[1234] 5678 Misc Validating signature...", at(2023, 4, 21, 15, 30, 45))]


def test_firewalls(by_file):
    assert shown(by_file["pfirewall.log"], "event_id", "message") == [(2, "ALLOW TCP 10.0.0.1:49152 -> 10.0.0.2:443 (RECEIVE)"), (3, "DROP UDP 10.0.0.1:- -> 10.0.0.2:-")]
    assert shown(by_file["ufw.log"], "host", "message") == [("gw", "[UFW BLOCK] TCP 1.2.3.4:1 -> 5.6.7.8:22 (IN)"), ("gw", "[X] -> 5.6.7.8 (FORWARD)")]
    assert shown(by_file["cisco.txt"], "event_id", "message")[:2] == [(106023, "[ASA-4-106023] DENY UDP 1.2.3.4:53 -> 10.0.0.9:99 - Deny udp src outside:1.2.3.4/53 dst inside:10.0.0.9/99"), (302013, "[ASA-6-302013] ALLOW TCP 1.2.3.4:443 -> 10.0.0.1:5000 - Built outbound TCP connection 1 for outside:1.2.3.4/443 (1.2.3.4/443) to inside:10.0.0.1/5000 (x)")]
    assert by_file["cisco.txt"][2].message == "[ASA-5-999999] DROP - dropping it"


def test_macos(by_file):
    a, b, c = by_file["unified.txt"]
    assert (a.message, a.timestamp, a.tz_offset_min) == ("[kernel(0)] (IOKit) hello", at(2023, 4, 21, 22, 30, 45, 123456), -420)
    assert (b.message, c.event_type) == ("[app(12)] plain", "UnifiedLogRaw")
    assert shown(by_file["install.log"], "message", "timestamp") == [("[installer(99)] PackageKit: done", at(2023, 4, 21, 22, 30, 45))]
    assert shown(by_file["system.log"], "message", "timestamp") == [("[syslogd(1)] <Notice> hi", at(2024, 4, 21, 15, 30, 45)), ("[kernel] <Error> bad", at(2024, 4, 21, 15, 30, 46))]


def test_header_logs(by_file):
    a, b = by_file["u_ex230421.log"]
    assert (a.event_id, a.host, a.message) == (3, "9.9.9.9 -> 10.0.0.1:80", "GET /a ?q=1 (Status: 404.2) [15ms] Win32: 5 UA: " + "U" * 100 + "...")
    assert (b.event_id, b.host, b.message, b.timestamp) == (6, "8.8.8.8", "POST  (Status: 0)", at(2023, 4, 22, 1, 2, 3))
    (z,) = by_file["zeek/conn.log"]
    assert (z.event_type, z.event_id, z.host, z.message, z.timestamp) == ("ZeekConnection", 1, "10.0.0.1", "10.0.0.1:1000 -> 10.0.0.2:53 [UDP] duration=0.5s", at(2023, 4, 21, 14, 30, 45, 123456))
    assert shown(by_file["x509.log"], "event_type", "message") == [("ZeekX509", "subject=CN=a serial=01")]


def test_generic_log(by_file):
    assert shown(by_file["app.txt"], "event_id", "timestamp", "message") == [(1, None, "start"), (2, at(2023, 4, 21, 15, 30, 45), "one 2023-04-21T15:30:45Z"), (3, None, "2023-04-21 15:30:46 two"), (4, at(2023, 4, 21, 14, 30, 47), "three")]


def test_what_looks_like_a_time(by_file):
    assert shown(by_file["odd.txt"], "timestamp", "message") == [(at(2023, 4, 21, 15, 30, 45), "first"), (None, "2024-13-45 10:00:00 second")]


def test_json(by_file):
    assert shown(by_file["events.json"], "event_id", "event_type", "user", "host", "timestamp") == [(0, "Unknown", "", "", at(2024, 1, 15, 12)), (7, "A", "u", "", at(2023, 4, 21, 13, 30, 45))]
    assert shown(by_file["one.json"], "message") == [("alone",)]
    assert "bad.json" not in by_file
    (a,) = by_file["cloudtrail.json"]
    assert (a.event_type, a.user, a.host, a.message) == ("CloudTrail:s3.amazonaws.com:GetObject", "arn:x", "1.1.1.1", "Action: GetObject | Service: s3.amazonaws.com | Region: eu | SourceIP: 1.1.1.1 | Error: E")
    assert shown(by_file["cloudtrail2.jsonl"], "event_id", "event_type") == [(1, "CloudTrail::A"), (3, "CloudTrail::B")]
    (a,) = by_file["azure.json"]
    assert (a.event_type, a.user, a.message) == ("Azure:op", "u@x", "Operation: op | Resource: ..." + "r" * 97)
    (a,) = by_file["gcp.jsonl"]
    assert (a.event_type, a.user, a.host, a.message, a.timestamp) == ("GCP:s:m", "e", "2.2.2.2", "Method: m | Service: s | ResourceType: t | Resource: p | CallerIP: 2.2.2.2 | Severity: INFO", at(2023, 4, 21, 15, 30, 45, 500000))


def test_csv(by_file):
    rows = by_file["mft.csv"]
    assert shown(rows, "event_id", "timestamp", "user", "host") == [(2, at(2024, 1, 2, 1), "bob", "pc"), (3, at(2024, 2, 13, 1), "", "pc"), (4, at(2023, 4, 21, 14, 30, 45), "", ""), (5, at(2023, 4, 21, 14, 30, 45, 123000), "", ""), (6, at(2023, 4, 21, 14, 30, 45), "", "")]
    assert rows[0].message.endswith("a, b | ComputerName=pc") and rows[0].event_type == "CSVRecord"
    assert shown(by_file["semi.csv"], "message", "timestamp") == [("hello", at(2023, 4, 21, 15, 30, 45))]


def test_xml(by_file):
    (a,) = by_file["sec.xml"]
    assert (a.event_type, a.event_id, a.user, a.host, a.message) == ("Security", 4624, "S-1-5-18", "PC1", "EventID: 4624 | Provider: Prov | Level: Information | User=bob, Image=C:\\x.exe, Long=" + "x" * 97 + "...")
    assert a.timestamp == at(2023, 4, 21, 15, 30, 45, 123456)
    assert shown(by_file["task.xml"], "event_id", "event_type", "message") == [
        (0, "ScheduledTask:Registration", "URI: \\t | Author: me"), (1, "ScheduledTask:Action", "Task: \\t | Command: cmd | Arguments: /c"), (1, "ScheduledTask:COMHandler", "COM Handler ClassId: {1} | Data: "),
        (2, "ScheduledTask:Action", "Task: \\t | Command: b"), (100, "ScheduledTask:LogonTrigger", "Logon Trigger | Enabled: true | StartBoundary:  | UserId: u1"), (101, "ScheduledTask:TimeTrigger", "Time Trigger | Enabled:  | StartBoundary: s"),
    ]
    assert shown(by_file["sysmon.xml"], "event_id", "event_type", "message") == [(0, "SysmonConfig:Settings", "Sysmon Configuration | SchemaVersion: 4.2 | HashAlgorithms: md5"), (1, "SysmonConfig:ProcessCreate", "RuleGroup: g | OnMatch: include | Image[is]=x"), (2, "SysmonConfig:DnsQuery", "OnMatch: exclude")]
    assert shown(by_file["other.xml"], "event_id", "message") == [(1, "Element: r/a | Attributes: k=v"), (2, "Element: r/a/b"), (3, "Element: r/a"), (4, "Element: r/a/b")]


def test_powershell(by_file):
    rows = by_file["session_transcript.txt"]
    assert shown(rows, "event_type", "event_id", "user", "message") == [
        ("PowerShellTranscriptEnd", 0, "D\\u", "PowerShell session ended. Duration: 1h1m2s"), ("PowerShellTranscriptStart", 0, "D\\u", "PowerShell session started. Host: ps.exe, RunAs: D\\v"),
        ("PowerShellCommand", 1, "D\\u (RunAs: D\\v)", "Command: dir | Output: file1\nfile2"), ("PowerShellCommand", 2, "D\\u (RunAs: D\\v)", "Command: whoami"),
    ]
    assert [r.message for r in by_file["4104.txt"]] == ["Script: firstsecond", "Script: third", "[Part 1/2] Path: C:\\a.ps1 | Script: if (1 < 2) { &lt; }"]
    assert {r.timestamp for r in by_file["4104.txt"]} == {at(2023, 4, 21, 15, 30, 45)}


def test_browsers(by_file):
    assert shown(by_file["Chrome/History"], "message", "timestamp") == [("Visited: B - http://b (visit count: 1)", at(2023, 4, 21, 14, 30, 46)), ("Visited: http://a/x (visit count: 3)", at(2023, 4, 21, 14, 30, 45))]
    assert shown(by_file["firefox/places.sqlite"], "timestamp") == [(at(2023, 4, 21, 14, 30, 45, 123456),)]
    assert shown(by_file["Safari/History.db"], "message", "timestamp") == [("Visited: s.com - https://www.s.com/p (visit count: 4)", at(2023, 4, 21, 14, 30, 45, 500000))]


def test_engine(spark, folder):
    t = build_timeline(spark, str(folder), str(folder / "syslog"), context=NOW)
    assert {(r.parser, r.path.rsplit("/", 1)[1]) for r in t.errors.collect()} == {("prefetch", "x.pf"), ("shellbags", "shellbags.dat"), ("json", "bad.json")}
    assert t.files.count() == len(FILES) + 3
    one = build_timeline(spark, str(folder), pattern="Failed|GetObject", only={"syslog", "cloudtrail"}, context=NOW)
    assert {r.message[:6] for r in one.events.collect()} == {"[sshd[", "Action"}
    for bad in ("(", "(?=x)", "a++", r"(a)\1"):
        with pytest.raises(ValueError):
            build_timeline(spark, str(folder), pattern=bad)
    assert build_timeline(spark, str(folder), max_size=0, context=NOW).events.count() == 0


def test_bad_files(spark, tmp_path):
    """One file of each kind that can't be read: an error for each, and all of the others."""
    for name, data in {"bad.json": b'[{"a": 1}, {', "cloudtrail.jsonl": b"nothing\n", "chrome/History": b"no database", "Safari/History.db": b"SQLite format 3\0" + b"x" * 90, "bad.evtx": b"x" * 9000, "empty.evtx": b"ElfFile\0" + bytes(9000), "task.xml": b"<Task><Actions>", "other.xml": b"<a><b/>", "syslog": b"2024-01-01T00:00:00Z h p: m\n", "good.json": b'{"message": "m"}'}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    t = build_timeline(spark, str(tmp_path), context=NOW)
    got = {r.path.removeprefix(str(tmp_path) + "/") for r in t.errors.collect()}
    assert got == {"bad.json", "cloudtrail.jsonl", "chrome/History", "Safari/History.db", "bad.evtx", "empty.evtx", "task.xml", "other.xml"}
    assert {(r.source, r.message) for r in t.events.collect() if r.source in ("syslog", "good.json")} == {("syslog", "[p] m"), ("good.json", "m")}


def test_large_files(spark, tmp_path):
    """Files of any size are listed, and those that can't be read are errors."""
    (tmp_path / "syslog").write_text("<1>2024-01-01T00:00:00Z h p: m\n")
    for name in ("big.log", "big.json"):
        with open(tmp_path / name, "wb") as f:
            f.truncate((2 << 30) + 1)
    t = build_timeline(spark, str(tmp_path), only={"syslog", "json"}, context=NOW)
    name = lambda r: r.path.rsplit("/", 1)[1]
    assert {name(r): r.error is None for r in t.files.collect()} == {"syslog": True, "big.log": True, "big.json": False}
    assert [name(r) for r in t.errors.collect()] == ["big.json"] and t.events.count() == 1
    t = build_timeline(spark, str(tmp_path), max_size=2 << 30, context=NOW)
    assert {name(r) for r in t.errors.collect()} == {"big.log", "big.json"} and t.files.count() == 3 and t.events.count() == 1


def test_sinks(spark, folder, tmp_path):
    events = build_timeline(spark, str(folder / "access.log"), context=NOW, ordered=True).events
    writers.single_file(writers.write_csv, events, str(tmp_path / "o.csv"))
    rows = list(csv.DictReader(open(tmp_path / "o.csv", newline="")))
    assert {r["timestamp"] for r in rows} == {"0001-01-01T00:00:00Z", "2023-04-21T15:30:45+02:00"} and rows[0]["score"] == "0.00"
    writers.single_file(writers.write_jsonl, events, str(tmp_path / "o.jsonl"))
    objects = [json.loads(x) for x in open(tmp_path / "o.jsonl")]
    assert all(len(o) == 8 for o in objects)
    assert writers.write_sqlite(events, str(tmp_path / "o.db")) == 3
    db = sqlite3.connect(tmp_path / "o.db")
    assert db.execute("SELECT count(*), min(id) FROM events").fetchone() == (3, 1)
    with pytest.raises(ValueError):
        writers.sink("xls")


def test_cli(folder, tmp_path):
    from timeloom.cli import main

    assert main(["--input", str(folder / "access.log"), "--output", str(tmp_path / "out"), "--format", "parquet"]) == 0


def test_files_too_large_for_a_row(spark, tmp_path, monkeypatch):
    """Objects a line come through line by line, numbered as in smaller files; what has to be held whole is an error."""
    from timeloom.plans import timeline

    line = '{"eventTime":"2023-04-21T15:30:45Z","eventSource":"s3","eventName":"E%d"}'
    (tmp_path / "cloudtrail.jsonl").write_text("\n".join(line % i if i % 5 else ["", "bad", "7"][i % 3] for i in range(1, 400)))
    (tmp_path / "azure.json").write_text('{"operationName":"a","time":"2023-04-21T15:30:45+01:00"}\n{"operationName":"b"}\n')
    (tmp_path / "gcp.json").write_text('[{"protoPayload":{"methodName":"m"}},\n' + '{"protoPayload":{}},' * 20 + "{}]")
    (tmp_path / "sysmon.xml").write_text('<Sysmon schemaversion="4.8"><EventFiltering>' + "<ProcessCreate/>" * 50 + "</EventFiltering></Sysmon>")
    shown = lambda t: sorted(tuple(r) for r in t.events.select("source", "event_id", "event_type", F.unix_micros("timestamp"), "message").collect())
    small = build_timeline(spark, str(tmp_path), context=NOW)
    whole = shown(small)
    monkeypatch.setattr(timeline, "MAX_WHOLE", 50)
    large = build_timeline(spark, str(tmp_path), context=NOW)
    assert shown(large) == [r for r in whole if r[0] in ("cloudtrail.jsonl", "azure.json")] and len(shown(large)) > 300
    assert sorted(r.path.rsplit("/", 1)[1] for r in large.errors.collect()) == ["gcp.json", "sysmon.xml"]
    assert "azure.json" in {r.path.rsplit("/", 1)[1] for r in build_timeline(spark, str(tmp_path), context=Context(NOW.reference_time, compat=True)).errors.collect()}


def test_objects_a_line_are_never_held_whole(spark, tmp_path, monkeypatch):
    """Whatever the file's size, and with the records that the whole text would give."""
    from timeloom.operators import json_logs
    from timeloom.plans import timeline
    from timeloom.sources.whole import read_texts

    line = '{"eventTime":"2023-04-21T15:30:45Z","eventSource":"s3","eventName":"E%d"}'
    lined = {"a-cloudtrail.jsonl": "\r\n".join(line % i for i in range(50)), "b-cloudtrail.json": "\n \n" + line % 1 + "\nbad\n[]\n" + line % 2 + "\n", "c-cloudtrail.json": line % 3}
    held = {"d-cloudtrail.json": '{"Records":[' + line % 1 + "," + line % 2 + "]}\n", "e-cloudtrail.json": "[" + line % 1 + "]\n" + line % 2, "f-cloudtrail.json": "bad\n" + line % 1, "g-cloudtrail.json": "\ufeff" + line % 1 + "\n" + line % 2, "h-cloudtrail.json": '{\n"eventName": "A"}'}
    for name, text in (lined | held).items():
        (tmp_path / name).write_text(text, newline="")
    shown = lambda events: sorted(tuple(r) for r in events.select("source", "event_id", "event_type", F.unix_micros("timestamp"), "message").collect())
    want = shown(json_logs.cloudtrail(read_texts(spark, [str(tmp_path / n) for n in lined | held]), NOW))
    read = []
    whole = timeline.PARSERS["cloudtrail"]
    monkeypatch.setitem(timeline.PARSERS, "cloudtrail", lambda spark, paths, ctx: read.extend(paths) or whole(spark, paths, ctx))
    t = build_timeline(spark, str(tmp_path), context=NOW)
    assert shown(t.events) == want and t.errors.count() == 0
    assert sorted(p.rsplit("/", 1)[1] for p in read) == sorted(held)
