"""Appending to a timeline, exactly once a batch.

A batch is written beside the others under a name of its own and then renamed, in one step that fails if the name is taken, to
``batch=<id>``. So readers see a batch whole or not at all, a batch that is repeated (by a stream that starts again, or by two
writers) adds nothing, and what was not finished is never read. The file system's rename of a folder has to be atomic, as
that of HDFS and of local disks is; on object stores it is not.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .writers import csv_columns, json_lines

_STAGING = "_staging"


def _csv(events: DataFrame, path: str) -> None:
    csv_columns(events).write.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


WRITERS: dict[str, Callable[[DataFrame, str], None]] = {
    "csv": _csv,
    "jsonl": lambda events, path: json_lines(events).write.text(path),
    "parquet": lambda events, path: events.sortWithinPartitions("timestamp").write.parquet(path),
}


class _Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self._conf)
        self._names = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf)

    def path(self, name: str):
        return self._path(f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def move(self, name: str, to: str) -> bool:
        """In one step; False if ``to`` is there already."""
        kind = getattr(self.spark.sparkContext._jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self._names.rename(self.path(name), self.path(to), options)
            return True
        except Py4JJavaError:
            if self.has(to):
                return False
            raise


@dataclass
class Staged:
    """A batch that is written and not yet part of the timeline."""

    folder: _Folder
    name: str
    batch: str

    def commit(self) -> bool:
        """Whether the batch was added; it isn't if one of that id is there, and then goes."""
        added = self.folder.move(self.name, f"batch={self.batch}")
        if not added:
            self.folder.drop(self.name)
        return added

    def discard(self) -> None:
        self.folder.drop(self.name)


def _id(batch: int | str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", str(batch)):
        raise ValueError(f"a batch's id is letters, digits, dots, hyphens and underscores: {batch!r}")
    return str(batch)


def stage_batch(events: DataFrame, root: str, kind: str, batch: int | str) -> Staged | None:
    """Writes a batch out of sight; None if one of that id is there already. What a failure leaves is removed."""
    folder, batch = _Folder(events.sparkSession, root), _id(batch)
    if folder.has(f"batch={batch}"):
        return None
    name = f"{_STAGING}/{batch}-{uuid.uuid4().hex}"
    try:
        WRITERS[kind](events, f"{folder.root}/{name}")
    except BaseException:
        folder.drop(name)
        raise
    return Staged(folder, name, batch)


def append_batch(events: DataFrame, root: str, kind: str, batch: int | str) -> bool:
    """Adds a batch of events in the format ``kind`` (csv, jsonl, parquet); False if one of that id is there already."""
    staged = stage_batch(events, root, kind, batch)
    return staged is not None and staged.commit()


def read_batches(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The rows of all batches, and ``batch``, the id of each; as text in csv, lines (``value``) in jsonl."""
    reader = spark.read.option("basePath", root).option("inferSchema", "false")
    path = f"{root.rstrip('/')}/batch=*"
    if kind == "csv":
        return reader.csv(path, header=True, escape='"', multiLine=True)
    return reader.text(path) if kind == "jsonl" else reader.parquet(path)
