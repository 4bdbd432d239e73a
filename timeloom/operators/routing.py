"""Which parser reads a file: the first rule that holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import matches
from . import text_logs

# Names and markers, lower-case where names are.
SENSOR_FILES = (
    "conn.log", "dns.log", "http.log", "ssl.log", "files.log", "x509.log", "dhcp.log", "ssh.log", "smtp.log", "ftp.log", "notice.log", "weird.log", "dpd.log", "known_hosts.log",
    "known_services.log", "software.log", "pe.log", "ntp.log", "rdp.log", "smb_mapping.log", "smb_files.log", "dce_rpc.log", "ntlm.log", "kerberos.log", "sip.log", "snmp.log", "tunnel.log",
)
SYSLOG_FILES = ("syslog", "auth.log", "kern.log", "messages", "user.log")
EVENT_URI, TASK_URI = "http://schemas.microsoft.com/win/2004/08/events/event", "http://schemas.microsoft.com/windows/2004/02/mit/task"


def _any(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def rules(path: Column, head: Column, head_lines: Column) -> list[tuple[Column, str]]:
    """(condition, parser) in order. ``head``: the first 4,096 bytes; ``head_lines``: the first 50 lines."""
    low = F.lower(path)
    name = F.regexp_extract(low, r"[^/\\]+\z", 0)
    folder = F.regexp_replace(low, r"[/\\]?[^/\\]*\z", "")
    ext = F.regexp_extract(name, r"\.[^.]*\z", 0)
    has = lambda *w: _any(*[name.contains(x) for x in w])
    first = lambda n, *patterns: F.exists(F.slice(head_lines, 1, n), lambda x: _any(*[matches(x, p) for p in patterns]))
    within = lambda *w: _any(*[head.contains(x) for x in w])
    log = name.endswith(".log")
    xml, json = ext == ".xml", ext.isin(".json", ".jsonl")
    stars = first(10, r"^\*{20,}$", "(?i)^Windows PowerShell transcript start")
    sensor_head = F.exists(F.slice(head_lines, 1, 15), lambda x: x.startswith("#separator")) & F.exists(F.slice(head_lines, 1, 15), lambda x: x.startswith("#fields"))
    return [
        (ext == ".evtx", "evtx"),
        (ext == ".pf", "prefetch"),
        (xml & (within(EVENT_URI) | (within("<Event") & within("<System>"))), "windows_xml"),
        (xml & (within(TASK_URI) | (within("<Task") & within("<RegistrationInfo", "<Actions"))), "scheduled_task"),
        (xml & ((within("<Sysmon") & within("schemaversion", "<EventFiltering")) | within("Microsoft-Windows-Sysmon")), "sysmon"),
        (xml, "generic_xml"),
        (json & (has("cloudtrail") | (within('"eventSource"') & within('"eventName"') & within('"awsRegion"'))), "cloudtrail"),
        (json & (has("azure", "activitylog") | (within('"resourceId"') & within('"operationName"'))), "azure"),
        (json & (has("gcp", "cloudaudit", "google", "stackdriver") | within('"protoPayload"') | (within('"methodName"') & within('"serviceName"'))), "gcp"),
        (ext == ".json", "json"),
        ((name == "history") & _any(*[low.contains(x) for x in ("chrome", "edge", "chromium")]), "browser_chrome"),
        ((name == "places.sqlite") & (low.contains("firefox") | low.contains("mozilla")), "browser_firefox"),
        ((name == "history.db") & low.contains("safari"), "browser_safari"),
        (has("shellbag"), "shellbags"),
        (has(".log."), "log"),
        (has("transcript") | stars, "transcript"),
        (has("scriptblock", "script-block", "powershell-operational", "4104") | F.exists(head_lines, lambda x: _any(*[x.contains(w) for w in ("ScriptBlockText", "MessageNumber", "ScriptBlockId")])), "script_block"),
        ((name == "install.log") | name.startswith("install.log.") | has("installer.log"), "macos_install"),
        (name.isin("system.log", "secure.log") | name.startswith("system.log.") | name.startswith("secure.log.") | has("asl") | first(10, text_logs.ASL, text_logs.ASL_NO_PID), "macos_asl"),
        (has("unified", "logshow", "log_show") | name.startswith("system_logs") | first(10, text_logs.UNIFIED, text_logs.UNIFIED_PLAIN), "macos_unified"),
        ((name.startswith("u_ex") & log) | (log & (low.contains("inetpub") | low.contains("w3svc"))), "iis"),
        ((log & (folder.contains("zeek") | folder.contains("bro"))) | name.isin(*SENSOR_FILES) | (log & sensor_head), "zeek"),
        ((name == "access.log") | name.startswith("access.log.") | has("apache", "nginx"), "web"),
        (name.isin(*SYSLOG_FILES) | has("syslog.", "auth.log.", "kern.log."), "syslog"),
        ((name == "cbs.log") | has("windowsupdate", "setupapi", "dism"), "windows_text"),
        ((name == "pfirewall.log") | (has("firewall") & log), "windows_firewall"),
        ((name == "ufw.log") | has("iptables", "firewall", "netfilter"), "iptables"),
        (has("asa", "cisco", "pix"), "cisco_asa"),
        (ext == ".csv", "csv"),
    ]


def route(path: Column | str = "path", head: Column | str = "head", head_lines: Column | str = "head_lines") -> Column:
    """The parser's name; ``log`` where no rule holds."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    lines = F.coalesce(col(head_lines), F.array().cast("array<string>"))
    out = None
    for test, parser in rules(col(path), F.coalesce(col(head), F.lit("")), lines):
        out = F.when(test, parser) if out is None else out.when(test, parser)
    return out.otherwise("log")
