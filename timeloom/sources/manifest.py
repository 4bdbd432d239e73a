"""Which files there are, and what routing needs of each."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import local_path

HEAD_BYTES, HEAD_LINES = 4096, 50
MANIFEST = "path string, size bigint, modified timestamp, head string, head_lines array<string>, error string"


def list_files(spark: SparkSession, *inputs: str) -> DataFrame:
    """(path, size, modified) of all files at or below the inputs, each once; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(inputs))
    return raw.select(local_path(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).dropDuplicates(["path"])


def _start(spark: SparkSession, path: str, size: int) -> bytes:
    """The first ``size`` bytes of a file, or all it has."""
    if "://" not in path and os.path.exists(path):
        with open(path, "rb") as f:
            return f.read(size)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def first_lines(spark: SparkSession, paths: list[str], threads: int = 32) -> list[str]:
    """Each file's first line, of which no more is read than it takes."""

    def one(path: str) -> str:
        size = 1 << 16
        while b"\n" not in (data := _start(spark, path, size)) and len(data) == size:
            size *= 16
        return data.split(b"\n")[0].decode("utf-8", "replace").removesuffix("\r")

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(one, paths))


def _head(spark: SparkSession, path: str) -> tuple[str, list[str], str | None]:
    """The first bytes as text, the first lines, and why a file can't be read."""
    try:
        data = _start(spark, path, HEAD_LINES * 2048)
    except Exception as e:  # the file is reported and skipped
        return "", [], str(e)[:500]
    text = data[:HEAD_BYTES].decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8", "replace")
    lines = data.decode("utf-8", "replace").split("\n")[:HEAD_LINES]
    return text, [x.removesuffix("\r") for x in lines], None


def manifest(spark: SparkSession, *inputs: str, max_size: int | None = None, threads: int = 32) -> DataFrame:
    """The files with their heads. Those above ``max_size`` bytes have that as their error, whichever way they were named."""
    rows = list_files(spark, *inputs).collect()
    with ThreadPoolExecutor(threads) as pool:
        heads = list(pool.map(lambda r: _head(spark, r.path), rows))
    over = lambda r: None if max_size is None or r.size <= max_size else f"skipped: {r.size} bytes are more than {max_size}"
    return spark.createDataFrame([(r.path, r.size, r.modified, head, lines, error or over(r)) for r, (head, lines, error) in zip(rows, heads, strict=True)], MANIFEST)
