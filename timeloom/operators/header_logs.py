"""Formats whose header lines name the fields: web server (W3C) and network sensor (tab-separated) logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import cut_bytes, evaluated, known, labelled, trimmed
from ..schema import Context, event
from .sequence import headed, last_value

# Event types by the sensor log's path.
SENSOR_TYPES = {
    "conn": "ZeekConnection", "dns": "ZeekDNS", "http": "ZeekHTTP", "ssl": "ZeekSSL", "files": "ZeekFiles", "x509": "ZeekX509", "dhcp": "ZeekDHCP",
    "ssh": "ZeekSSH", "smtp": "ZeekSMTP", "ftp": "ZeekFTP", "notice": "ZeekNotice", "weird": "ZeekWeird", "dpd": "ZeekDPD", "known_hosts": "ZeekKnownHosts",
    "known_services": "ZeekKnownServices", "software": "ZeekSoftware", "pe": "ZeekPE", "ntp": "ZeekNTP", "rdp": "ZeekRDP", "smb_mapping": "ZeekSMBMapping",
    "smb_files": "ZeekSMBFiles", "dce_rpc": "ZeekDCERPC", "ntlm": "ZeekNTLM", "kerberos": "ZeekKerberos", "sip": "ZeekSIP", "snmp": "ZeekSNMP", "tunnel": "ZeekTunnel",
}


#: The fields that are read of web server logs.
W3C_FIELDS = ("date", "time", "c-ip", "cs-username", "s-ip", "s-port", "cs-method", "cs-uri-stem", "cs-uri-query", "sc-status", "sc-substatus", "sc-win32-status", "time-taken", "cs(User-Agent)")


def w3c(lines: DataFrame, ctx: Context) -> DataFrame:
    """Rows under the latest ``#Fields`` line above them; rows of fewer fields than it names, and those before any, are dropped."""
    tokens = F.split(trimmed(F.col("line")), r"[\t\n\f\r ]+")
    fields = F.when(F.col("line").startswith("#Fields:"), F.split(trimmed(F.substring("line", F.lit(9), F.length("line"))), r"[\t\n\f\r ]+"))
    heads = last_value(lines.where(F.col("line").startswith("#Fields:")).withColumn("named", fields), names=F.col("named"))
    # A field that is named twice has its last place. Places are found once a header.
    place = lambda name: F.when(F.array_contains("names", name), F.size("names") - F.array_position(F.reverse("names"), name).cast("int"))
    heads = heads.withColumn("places", F.transform(F.array(*map(F.lit, W3C_FIELDS)), place))
    rows = headed(lines.where(~F.col("line").startswith("#")), heads, "names", "places")
    rows = evaluated(rows.where(F.array_join("names", "") != ""), ["path", "source", "line_no", "names", "places"], values=tokens).where(F.size("values") >= F.size("names"))
    rows = evaluated(rows, ["path", "source", "line_no"], fields=F.transform("places", lambda i: F.nullif(F.get("values", i), F.lit("-"))))
    field = lambda name: F.get("fields", F.lit(W3C_FIELDS.index(name)))
    number = lambda name: F.coalesce(field(name).try_cast("bigint"), F.lit(0))
    odd = lambda name: F.when((known(field(name)) != "0"), field(name))
    status = F.concat(F.lit("(Status: "), number("sc-status"), F.coalesce(F.concat(F.lit("."), odd("sc-substatus")), F.lit("")), F.lit(")"))
    message = F.concat_ws(
        " ",
        F.concat(F.coalesce(field("cs-method"), F.lit("")), F.lit(" "), F.coalesce(field("cs-uri-stem"), F.lit(""))),
        labelled("?", field("cs-uri-query")), status, F.when(number("time-taken") > 0, F.concat(F.lit("["), number("time-taken"), F.lit("ms]"))),
        labelled("Win32: ", odd("sc-win32-status")), labelled("UA: ", cut_bytes(field("cs(User-Agent)"), 100, 100)),
    )
    client, server, port = F.coalesce(field("c-ip"), F.lit("")), known(field("s-ip")), known(field("s-port"))
    host = F.when(server.isNotNull(), F.concat(client, F.lit(" -> "), server, F.coalesce(F.concat(F.lit(":"), port), F.lit("")))).otherwise(client)
    stamp = times.parsed(F.concat(known(field("date")), F.lit(" "), known(field("time"))), "yyyy-MM-dd HH:mm:ss[.SSS]")
    return event(rows, timestamp=stamp, event_type="IISAccess", user=field("cs-username"), host=host, message=message)


def _headed(name: str, by: Column) -> Column:
    """The second field of a header line of that name."""
    return F.when(F.col("line").startswith(name), F.try_element_at(F.split(F.col("line"), by, -1), F.lit(2)))


def unescaped_separator(c: Column) -> Column:
    """``\\x09`` and the like as the character."""
    code = F.conv(F.regexp_extract(c, r"^\\x([0-9A-Fa-f]{2})", 1), 16, 10).try_cast("int")
    return F.when(code.isNotNull(), F.chr(code)).otherwise(c)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))


def sensor(lines: DataFrame, ctx: Context) -> DataFrame:
    """Tab-separated logs under header lines; event ids count the rows of data."""
    line = F.col("line")
    heads = lines.where(line.startswith("#"))
    heads = last_value(heads.withColumn("sep_here", F.when(line.startswith("#separator "), unescaped_separator(F.substring("line", F.lit(12), F.length("line"))))), sep=F.col("sep_here"))
    heads = heads.withColumn("sep", _quoted(F.coalesce("sep", F.lit("\t"))))
    names_here = F.when(line.startswith("#fields") & (F.size(F.split(line, F.col("sep"), -1)) > 1), F.slice(F.split(line, F.col("sep"), -1), F.lit(2), F.greatest(F.lit(0), F.size(F.split(line, F.col("sep"), -1)) - 1)))
    heads = heads.select("*", names_here.alias("n_here"), _headed("#path", F.col("sep")).alias("p_here"), _headed("#empty_field", F.col("sep")).alias("e_here"), _headed("#unset_field", F.col("sep")).alias("u_here"))
    heads = last_value(heads, names=F.col("n_here"), log=F.col("p_here"), empty=F.col("e_here"), unset=F.col("u_here"))
    heads = heads.withColumn("log", F.coalesce("log", F.lit(""))).withColumn("places", places(FIELDS)).withColumn("layout", placed_layout())
    rows = headed(lines.where(~line.startswith("#")), heads, "names", "sep", "log", "empty", "unset", "places", "layout", number="ordinal")
    raw = F.split(line, F.col("sep"), -1)
    clean = F.transform(raw, lambda v: F.when((v == F.coalesce("empty", F.lit("(empty)"))) | (v == F.coalesce("unset", F.lit("-"))), F.lit("")).otherwise(v))
    n = F.least(F.size("names"), F.size(raw))
    rows = evaluated(rows, ["path", "source", "line_no", "ordinal", "names", "log", "places", "layout"], values=F.slice(clean, F.lit(1), n))
    rows = sensor_message(evaluated(rows, rows.columns, slots=F.transform("places", lambda i: F.get("values", i))))
    return event(rows, timestamp=times.epoch_text(field("ts")), event_type=sensor_type(F.col("log")), event_id="ordinal", host=F.coalesce(known(field("id.orig_h")), field("host")), message=F.col("message"))


def sensor_type(log: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SENSOR_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, log), F.lit("ZeekLog"))


#: The fields that are read by name outside of the layouts.
FIELDS = (
    "ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "host", "proto", "rcode_name", "uri", "sha256", "sha1", "md5", "auth_success", "success",
    "error_msg", "domainname", "username", "command", "arg", "reply_code", "reply_msg",
)


def field(name: str) -> Column:
    """The value of one of ``FIELDS``, in the row's ``slots``; null where the log doesn't have it."""
    return F.col("slots")[FIELDS.index(name)]


def places(fields: tuple[str, ...]) -> Column:
    """Where each of ``fields`` is in ``names``, from 0; null where it isn't. For header lines, so that rows only look up."""
    return F.transform(F.array(*map(F.lit, fields)), lambda name: F.nullif(F.array_position("names", name), F.lit(0)).cast("int") - 1)


# What is told of each kind of record after its connection: label, field, and what follows. "@" fields are derived
# below; "@" alone is always there. Certificates have no connection.
LAYOUTS = {
    "conn": [("[", "@proto", "]"), ("service=", "service", ""), ("state=", "conn_state", ""), ("duration=", "duration", "s")],
    "dns": [("query=", "query", ""), ("type=", "qtype_name", ""), ("answers=[", "answers", "]"), ("rcode=", "@rcode", "")],
    "http": [("", "method", ""), ("", "@url", ""), ("[", "status_code", "]"), ("UA=", "user_agent", "")],
    "ssl": [("SNI=", "server_name", ""), ("ver=", "version", ""), ("subject=", "subject", ""), ("issuer=", "issuer", "")],
    "files": [("file=", "filename", ""), ("type=", "mime_type", ""), ("size=", "total_bytes", ""), ("", "@hash", "")],
    "notice": [("[", "note", "]"), ("", "msg", ""), ("(", "sub", ")")],
    "ssh": [("[SSH]", "@", ""), ("ver=", "version", ""), ("auth=", "@auth", ""), ("client=", "client", ""), ("server=", "server", "")],
    "dhcp": [("MAC=", "mac", ""), ("assigned=", "assigned_ip", ""), ("hostname=", "host_name", ""), ("lease=", "lease_time", "s")],
    "x509": [("subject=", "certificate.subject", ""), ("issuer=", "certificate.issuer", ""), ("serial=", "certificate.serial", "")],
    "kerberos": [("[Kerberos]", "@", ""), ("client=", "client", ""), ("service=", "service", ""), ("", "@ticket", "")],
    "ntlm": [("[NTLM]", "@", ""), ("user=", "@account", ""), ("host=", "hostname", ""), ("", "@success", "")],
    "smtp": [("[SMTP]", "@", ""), ("from=", "mailfrom", ""), ("to=", "rcptto", ""), ("subject=", "subject", ""), ("reply=", "last_reply", "")],
    "ftp": [("[FTP]", "@", ""), ("user=", "user", ""), ("", "@command", ""), ("[", "@reply", "]")],
    "weird": [("[WEIRD:", "name", "]"), ("", "addl", "")],
    "rdp": [("[RDP]", "@", ""), ("cookie=", "cookie", ""), ("security=", "security_protocol", ""), ("result=", "result", "")],
}


#: The fields of ``derived``, in its order.
DERIVED = ("@proto", "@rcode", "@url", "@hash", "@auth", "@success", "@ticket", "@account", "@command", "@reply")


def _verdict(name: str, yes: str, no: str | Column) -> Column:
    return F.when(field(name) == "T", yes).when(field(name) == "F", no)


def derived(log: Column) -> dict[str, Column]:
    """Fields that are made of others, for the kinds of records that have them."""
    also = lambda name, before=" ", after="": F.coalesce(labelled(before, field(name), after), F.lit(""))
    domain, user = known(field("domainname")), known(field("username"))
    return {
        "@proto": F.upper(field("proto")),
        "@rcode": F.when(field("rcode_name") != "NOERROR", field("rcode_name")),
        "@url": F.coalesce(F.concat(F.lit("http://"), known(field("host")), F.coalesce(field("uri"), F.lit(""))), field("uri")),
        "@hash": F.coalesce(*[labelled(f"{k}=", field(k)) for k in ("sha256", "sha1", "md5")]),
        "@auth": _verdict("auth_success", "SUCCESS", "FAILED"),
        "@success": _verdict("success", "SUCCESS", "FAILED"),
        "@ticket": _verdict("success", "SUCCESS", F.concat(F.lit("FAILED"), also("error_msg", " (", ")"))),
        "@account": F.coalesce(F.concat(domain, F.lit("\\"), user), user),
        "@command": F.concat(known(field("command")), also("arg")),
        "@reply": F.concat(known(field("reply_code")), also("reply_msg")),
    }


def placed_layout() -> Column:
    """The layout of a header's kind of log, with the place of each part's field: among the values, or negative among the derived; null for others."""
    part = lambda x: F.struct(*[F.lit(v).alias(k) for k, v in zip(("label", "name", "after"), x, strict=True)])
    table = F.create_map(*[c for log, parts in LAYOUTS.items() for c in (F.lit(log), F.array(*map(part, parts)))])
    made = F.array(*map(F.lit, DERIVED))

    def place(x: Column) -> Column:
        own = F.nullif(F.array_position("names", x["name"]), F.lit(0)) - 1
        return F.struct(x["label"].alias("label"), x["after"].alias("after"), F.coalesce(own, -F.nullif(F.array_position(made, x["name"]), F.lit(0))).cast("int").alias("place"), (x["name"] == "@").alias("always"))

    return F.transform(F.try_element_at(table, F.col("log")), place)


def sensor_message(rows: DataFrame) -> DataFrame:
    """Adds ``message``: a record's connection, then what its kind of log is about; absent fields leave no trace.

    Layouts are data that one expression reads, so the plan doesn't grow with them.
    """
    orig, resp = known(field("id.orig_h")), known(field("id.resp_h"))
    port = lambda name: F.coalesce(field(name), F.lit(""))
    conn = F.when(orig.isNotNull() & resp.isNotNull(), F.concat(orig, F.lit(":"), port("id.orig_p"), F.lit(" -> "), resp, F.lit(":"), port("id.resp_p"))).otherwise(F.coalesce(orig, F.lit("")))
    more = derived(F.col("log"))
    rows = evaluated(rows, rows.columns, conn=conn, made=F.array(*[more[name] for name in DERIVED]))

    def shown(x: Column) -> Column:
        value = F.when(x["always"], F.lit("")).otherwise(known(F.when(x["place"] < 0, F.get("made", -x["place"] - 1)).otherwise(F.get("values", x["place"]))))
        return F.concat(x["label"], value, x["after"])

    told = F.array_join(F.array_compact(F.transform("layout", shown)), " ")
    some = F.filter(F.arrays_zip(F.slice("names", F.lit(1), F.size("values")).alias("keys"), F.col("values").alias("values")), lambda x: (x["values"] != "") & ~x["keys"].isin("ts", "uid"))
    rest = F.array_join(F.transform(F.slice(some, 1, 5), lambda x: F.concat(x["keys"], F.lit("="), x["values"])), " ")
    message = (
        F.when(F.col("layout").isNull(), F.when(F.col("conn") != "", F.col("conn")).otherwise(rest))
        .when(F.col("log") == "x509", told)
        .otherwise(F.concat("conn", F.when(told != "", F.concat(F.lit(" "), told)).otherwise("")))
    )
    return rows.withColumn("message", message)
