"""Browser visits: pages joined to their visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import base_name, known
from ..schema import Context, event

#: How each browser counts time, over a visit's visit_time (with a fraction) and visit_micros (without).
CLOCKS = {
    "chrome": lambda: times.webkit_time(F.col("visit_micros")),
    "firefox": lambda: times.unix_micros(F.col("visit_micros")),
    "safari": lambda: times.mac_absolute(F.col("visit_time")),
}


def title_of(url: Column) -> Column:
    """The host part of an address, without a leading www."""
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^https://", ""), "^http://", ""), r"^www\.", ""), r"^([^/]*)", 1)


def visit_message(title: Column, url: Column, count: Column) -> Column:
    return F.concat(F.lit("Visited: "), F.coalesce(F.concat(known(title), F.lit(" - ")), F.lit("")), url, F.lit(" (visit count: "), count, F.lit(")"))


def visits(pages: DataFrame, visited: DataFrame, browser: str, ctx: Context) -> DataFrame:
    """Events of pages (path, id, url, title, visit_count) and visits (path, page, visit_time, visit_micros).

    The visits of a database follow each other by time: they are sorted within the partition that the database is in.
    """
    rows = pages.alias("p").join(visited.alias("v"), (F.col("p.path") == F.col("v.path")) & (F.col("p.id") == F.col("v.page"))).where("p.url is not null and p.visit_count is not null")
    rows = rows.select(F.col("p.path").alias("path"), base_name(F.col("p.path")).alias("source"), "url", "title", "visit_count", "visit_time", "visit_micros")
    rows = rows.repartition("path").sortWithinPartitions("path", "visit_time", "visit_micros")
    title = title_of(F.col("url")) if browser == "safari" else F.col("title")
    return event(rows, timestamp=CLOCKS[browser](), event_type="BrowserHistory", event_id=F.lit(0), message=visit_message(title, F.col("url"), F.col("visit_count")))
