"""JSON: plain event objects and the audit logs of three clouds. Fields count only with the type they should have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import known, labelled, tail_bytes
from ..schema import Context, event

#: What holds the records of a cloud's log that is one object.
WRAPPERS = {"cloudtrail": "Records", "azure": "value", "gcp": "entries"}
UPN = "http://schemas.xmlsoap.org/ws/2005/05/identity/claims/upn"


def string_at(v: Column, *keys: str) -> Column:
    """The value under the keys if it is a string, else empty."""
    path = "$" + "".join(f'["{k}"]' for k in keys)
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string")).otherwise("")


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def records(texts: DataFrame, wrapper: str | None = None, compat: bool = False, first_only: bool = False) -> DataFrame:
    """(path, source, ordinal, v) from whole texts (path, source, text): the objects of an array, of a wrapper's array, of lines, or one alone.

    Elements and lines that are no objects are skipped but counted. ``compat`` gives what tools that read only one shape
    do: nothing of lines or a lone object, or with ``first_only`` the first object. Records of :func:`line_records` stay as they are.
    """
    if "v" in texts.columns:
        return texts
    rows = texts.withColumn("head", F.ltrim("text")).withColumn("whole", F.try_parse_json("text"))
    listed = F.when(F.col("head").startswith("["), F.try_variant_get("whole", "$", "array<variant>"))
    wrapped = F.try_variant_get("whole", f"$.{wrapper}", "array<variant>") if wrapper else F.lit(None).cast("array<variant>")
    lines = F.transform(F.split("text", "\n"), lambda x: F.try_parse_json(x))
    some = F.exists(lines, is_object)
    alone = F.array(F.col("whole"))
    if compat and not first_only:
        lone = F.array().cast("array<variant>")
    elif compat:
        lone = F.when(some, F.slice(F.filter(lines, is_object), 1, 1)).otherwise(alone)
    else:
        lone = F.when(some, lines).otherwise(alone) if wrapper else alone
    rows = rows.select("path", "source", F.posexplode(F.coalesce(listed, wrapped, lone)).alias("ordinal", "v"))
    return rows.where(is_object(F.col("v"))).withColumn("ordinal", F.col("ordinal") + 1)


def line_records(lines: DataFrame) -> DataFrame:
    """The same from lines (path, source, line_no, line) of files known to hold an object a line, which are never held whole."""
    return lines.select("path", "source", F.col("line_no").alias("ordinal"), F.try_parse_json("line").alias("v")).where(is_object(F.col("v")))


def json_events(texts: DataFrame, ctx: Context) -> DataFrame:
    """An array of events, or one event."""
    v = F.col("v")
    stamp = string_at(v, "timestamp")
    number = F.when(F.schema_of_variant(F.try_variant_get(v, "$.event_id", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.try_variant_get(v, "$.event_id", "double").try_cast("bigint"))
    kind = F.when(F.schema_of_variant(F.try_variant_get(v, "$.event_type", "variant")) == "STRING", F.try_variant_get(v, "$.event_type", "string"))
    return event(records(texts), timestamp=times.rfc3339(stamp), event_type=F.coalesce(kind, F.lit("Unknown")), event_id=F.coalesce(number, F.lit(0)), user=string_at(v, "user"), host=string_at(v, "host"), message=string_at(v, "message"), default=ctx.now, offset=times.offset_minutes(stamp))


def _with(rows: DataFrame, **fields: tuple[str, ...]) -> DataFrame:
    """The record's strings as columns, each read once."""
    return rows.select("path", "source", "ordinal", *[string_at(F.col("v"), *keys).alias(name) for name, keys in fields.items()])


def cloudtrail(texts: DataFrame, ctx: Context) -> DataFrame:
    who = ("userName", "arn", "principalId")
    rows = _with(records(texts, WRAPPERS["cloudtrail"], ctx.compat), service=("eventSource",), name=("eventName",), host=("sourceIPAddress",), stamp=("eventTime",), region=("awsRegion",), code=("errorCode",), reason=("errorMessage",), **{k: ("userIdentity", k) for k in who})
    c = F.col
    kind = F.when((c("service") != "") | (c("name") != ""), F.concat(F.lit("CloudTrail:"), "service", F.lit(":"), "name")).otherwise("CloudTrail")
    message = F.concat_ws(" | ", labelled("Action: ", c("name")), labelled("Service: ", c("service")), labelled("Region: ", c("region")), labelled("SourceIP: ", c("host")), labelled("Error: ", c("code")), labelled("ErrorMsg: ", c("reason")))
    return event(rows, timestamp=times.rfc3339(c("stamp")), event_type=kind, event_id="ordinal", user=F.coalesce(*[known(c(k)) for k in who]), host=c("host"), message=message, offset=times.offset_minutes(c("stamp")))


def _first_time(*names: str):
    """(the first of the columns that is a time, its offset)"""
    stamps = [F.col(n) for n in names]
    return F.coalesce(*[times.rfc3339(s) for s in stamps]), F.coalesce(*[F.when(times.rfc3339(s).isNotNull(), times.offset_minutes(s)) for s in stamps])


def azure_activity(texts: DataFrame, ctx: Context) -> DataFrame:
    rows = _with(
        records(texts, WRAPPERS["azure"], ctx.compat, True), t1=("time",), t2=("eventTimestamp",), t3=("submissionTimestamp",), operation=("operationName",), host=("callerIpAddress",), category=("category",),
        resource=("resourceId",), result=("resultType",), name=("identity", "claims", "name"), upn=("identity", "claims", UPN), caller=("caller",),
    )
    c = F.col
    stamp, offset = _first_time("t1", "t2", "t3")
    message = F.concat_ws(" | ", labelled("Operation: ", c("operation")), labelled("Category: ", c("category")), labelled("Resource: ", tail_bytes(c("resource"), 100, 97)), labelled("Result: ", c("result")), labelled("CallerIP: ", c("host")))
    return event(rows, timestamp=stamp, event_type=F.coalesce(labelled("Azure:", c("operation")), F.lit("AzureActivity")), event_id="ordinal", user=F.coalesce(known(c("name")), known(c("upn")), c("caller")), host=c("host"), message=message, offset=offset)


def gcp_audit(texts: DataFrame, ctx: Context) -> DataFrame:
    labels = ("instance_id", "bucket_name", "project_id", "cluster_name")
    rows = _with(
        records(texts, WRAPPERS["gcp"], ctx.compat, True), t1=("timestamp",), t2=("receiveTimestamp",), method=("protoPayload", "methodName"), service=("protoPayload", "serviceName"),
        host=("protoPayload", "requestMetadata", "callerIp"), who=("protoPayload", "authenticationInfo", "principalEmail"), kind=("resource", "type"), severity=("severity",), **{k: ("resource", "labels", k) for k in labels},
    )
    c = F.col
    stamp, offset = _first_time("t1", "t2")
    message = F.concat_ws(" | ", labelled("Method: ", c("method")), labelled("Service: ", c("service")), labelled("ResourceType: ", c("kind")), labelled("Resource: ", F.coalesce(*[known(c(k)) for k in labels])), labelled("CallerIP: ", c("host")), labelled("Severity: ", c("severity")))
    kind = F.when((c("service") != "") | (c("method") != ""), F.concat(F.lit("GCP:"), "service", F.lit(":"), "method")).otherwise("GCPAudit")
    return event(rows, timestamp=stamp, event_type=kind, event_id="ordinal", user=c("who"), host=c("host"), message=message, offset=offset)
