"""State carried from line to line of a file."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_value(df: DataFrame, **columns) -> DataFrame:
    """Each column's last value that is not null, up to and with the row itself, in line order of the file."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[F.last(c, ignorenulls=True).over(w).alias(name) for name, c in columns.items()])


def headed(lines: DataFrame, heads: DataFrame, key: str, *more: str, number: str | None = None, stretch: int = 1 << 16) -> DataFrame:
    """Each line with ``key`` and ``more`` of the latest of ``heads`` above it; lines before the first ``key`` are dropped.

    Lines meet heads by stretches of a file's lines, so that one long file is many tasks whichever way Spark joins: each stretch
    that has lines gets a list of the head it begins with and those within it. Only heads that change something and have another
    line below them count. ``number``: a column that counts the lines kept of each file from 1, in line order; their order is found
    before anything is added to them.
    """
    at = ["path", "stretch"]
    cut = lambda df: df.withColumn("stretch", F.floor(F.col("line_no") / stretch).cast("bigint"))
    by_line = Window.partitionBy("path").orderBy("line_no")
    state = F.struct(F.col(key), *[F.col(c) for c in more])
    heads = heads.select("path", "line_no", state.alias("state"), F.lead("line_no").over(by_line).alias("next")).where(f"state.{key} is not null and (next is null or next > line_no + 1)")
    heads = heads.withColumn("above", F.lag("state").over(by_line)).where("above is null or not state <=> above")
    heads = cut(heads).groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("line_no", "state"))).alias("own"))
    lines_cut = cut(lines)
    met = lines_cut.groupBy(*at).agg(F.count("*").alias("n")).join(heads, at, "full")
    before = Window.partitionBy("path").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("first", F.last(F.try_element_at("own", F.lit(-1)), ignorenulls=True).over(before))
    met = met.withColumn("heads", F.concat(F.array_compact(F.array("first")), F.coalesce("own", F.slice(F.array("first"), 1, 0))))
    met = met.where("n is not null and size(heads) > 0").select(*at, "heads")
    rows = lines_cut
    if number:
        starts = met.select(*at, F.col("heads")[0]["line_no"].alias("start"))
        kept = lambda df: df.join(starts, at).where(F.col("line_no") > F.col("start"))
        per = kept(lines_cut.select(*at, "line_no")).groupBy(*at).agg(F.count("*").alias("n"))
        per = per.select(*at, (F.sum("n").over(Window.partitionBy("path").orderBy("stretch")) - F.col("n")).alias("before"))
        n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = kept(lines_cut.repartition(n, *at)).drop("start").withColumn("own", F.row_number().over(Window.partitionBy(*at).orderBy("line_no")))
        rows = rows.join(per, at).withColumn(number, (F.col("before") + F.col("own")).cast("bigint"))
    rows = rows.join(met, at).where(F.col("line_no") > F.col("heads")[0]["line_no"])
    found = F.when(F.size("heads") == 1, F.col("heads")[0]).otherwise(F.try_element_at(F.filter("heads", lambda h: h["line_no"] < F.col("line_no")), F.lit(-1)))
    rows = rows.withColumn("head", found["state"])
    return rows.select(*lines.columns, *[F.col("head")[c].alias(c) for c in (key, *more)], *[number] * bool(number))


def counted(rows: DataFrame, name: str, stretch: int = 1 << 16) -> DataFrame:
    """Numbers the rows of each file from 1 in line order: counted within stretches of lines, after the rows of the stretches before."""
    rows = rows.withColumn("stretch", F.floor(F.col("line_no") / stretch))
    per = rows.groupBy("path", "stretch").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("stretch")) - F.col("n")
    rows = rows.join(per.select("path", "stretch", before.alias("before")), ["path", "stretch"])
    own = F.row_number().over(Window.partitionBy("path", "stretch").orderBy("line_no"))
    return rows.withColumn(name, (F.col("before") + own).cast("bigint")).drop("stretch", "before")


def months_added(t: datetime, n: int) -> datetime:
    """The same day n months on; days beyond the month's end run over into the next."""
    month = t.month - 1 + n
    first = t.replace(year=t.year + month // 12, month=month % 12 + 1, day=1)
    return first + timedelta(days=t.day - 1)
