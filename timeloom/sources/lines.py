"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base_name


#: Bytes of a side table of splits that are broadcast at most.
MOST_BROADCAST = 256 << 20


def split_bytes(spark: SparkSession, raw: DataFrame) -> int:
    """An upper bound of the bytes of a table of the splits in which files are read, by their sizes alone."""
    conf, size = spark.conf, lambda name: int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name)))
    total = int(str(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = raw.inputFiles()
    cores = int(conf.get("spark.sql.files.minPartitionNum", None) or 0) or spark.sparkContext.defaultParallelism
    each = min(size("spark.sql.files.maxPartitionBytes"), max(size("spark.sql.files.openCostInBytes"), total // cores))
    return (len(files) + total // max(1, each)) * (max(map(len, files), default=0) + 100)


def read_lines(spark: SparkSession, paths: list[str], blank: bool = False, numbered: bool = True, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(path, source, line_no, line, block), lines numbered from 1 with blank ones counted, which stay only with ``blank``.

    Files are split as Spark splits them; ``block`` is where a split begins, and its rows come in line order. A line's number is
    its place in its split plus the lines of the file's splits before it. Of each split one row is shuffled, and all of them are
    broadcast to the lines, which stay where they are read. Should the table of splits be above ``most_broadcast`` bytes by the
    files' sizes, it is joined instead, and there is no ``block``. Without ``numbered``, line_no only ascends within a
    split, where there are splits, and files are read once less.
    """
    raw = spark.read.text(paths, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    few = split_bytes(spark, raw) <= most_broadcast
    raw = raw.withColumn("place", F.monotonically_increasing_id())
    # A file's path and name are found once, not for each of its lines.
    named = lambda files: with_source(files.withColumn("path", local_path(F.col("file"))))
    line = without_return(F.col("value")).alias("line")
    if few and not numbered:
        known = {f for x in raw.inputFiles() for f in (x, x.replace("file:///", "file:/", 1))}  # rows have local files without an authority
        files = named(spark.createDataFrame([(f,) for f in sorted(known)], "file string"))
        path = F.coalesce("path", local_path(F.col("file")))
        lines = raw.join(F.broadcast(files), "file", "left").select(path.alias("path"), F.col("place").alias("line_no"), line, "block", F.coalesce("source", base_name(path)).alias("source"))
        return lines if blank else lines.where(~is_blank(F.col("line")))
    blocks = raw.groupBy("file", "block").agg(F.min("place").alias("first"), F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("block")) - F.col("lines")
    blocks = named(blocks.select("file", "block", (before - F.col("first") + 1).alias("shift")))
    lines = raw.join(F.broadcast(blocks) if few else blocks, ["file", "block"], "left")
    shift = F.coalesce("shift", F.raise_error(F.lit("a file was split in another way when its lines were counted")).cast("bigint"))
    lines = lines.select("path", (F.col("place") + shift).alias("line_no"), line, *["block"] * few, "source")
    return lines if blank else lines.where(~is_blank(F.col("line")))


def lines_of(texts: DataFrame, blank: bool = False) -> DataFrame:
    """The same from whole texts (path, text)."""
    lines = texts.select("path", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.select("path", (F.col("line_no") + 1).cast("bigint").alias("line_no"), without_return(F.col("line")).alias("line"))
    return with_source(lines if blank else lines.where(~is_blank(F.col("line"))))


def without_return(c: Column) -> Column:
    """Without a carriage return at the end."""
    return F.when(c.endswith("\r"), F.left(c, F.length(c) - 1)).otherwise(c)


def is_blank(c: Column) -> Column:
    """Whether there is nothing but white space."""
    return ~c.rlike(r"\S")


def with_source(lines: DataFrame) -> DataFrame:
    return lines.withColumn("source", base_name(F.col("path")))


def local_path(c):
    """A file's path without the scheme of local files."""
    return F.regexp_replace(F.call_function("url_decode", F.regexp_replace(c, r"\+", "%2B")), r"^file:(//)?", "")
