"""Filters over events."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import PatternError, translated


_checked: dict[str, str] = {}


def check_pattern(spark: SparkSession, pattern: str) -> str:
    """The pattern as Spark matches it, or an error before any file is read."""
    if pattern in _checked:
        return _checked[pattern]
    java, scripts = translated(pattern)
    known = {str(x) for x in spark._jvm.java.lang.Character.UnicodeScript.values()} if scripts else set()
    if unknown := [s for s in scripts if s.upper() not in known]:
        raise PatternError(f"invalid filter pattern: no script {', '.join(sorted(unknown))} in {pattern}")
    try:
        spark.range(1).select(F.lit("").rlike(java)).first()
    except PySparkException as e:
        raise PatternError(f"invalid filter pattern: {str(e)[:500]}") from e
    _checked[pattern] = java
    return java


def matching(events: DataFrame, pattern: str | None) -> DataFrame:
    """Events whose user, host, message or source has a match; all without a pattern.

    The condition stays above a generator of one row, so that the optimiser doesn't move it below the parser and parse a line
    again for each use of a column.
    """
    if not pattern:
        return events
    p = check_pattern(events.sparkSession, pattern)
    parsed = events.select(F.inline(F.array(F.struct(*[F.col(c) for c in events.columns]))))
    return parsed.where(F.col("user").rlike(p) | F.col("host").rlike(p) | F.col("message").rlike(p) | F.col("source").rlike(p))


def numbered_matches(rows: DataFrame, column: str, patterns: Sequence[str], name: str) -> DataFrame:
    """``rows`` with the numbers of the patterns that match anywhere in ``column`` as an array, instead of that column.

    Many patterns over long texts: each is a pass of the linear-time engine whose syntax this is over a batch of texts. Whatever
    :func:`check_pattern` refuses is refused here too.
    """
    for p in patterns:
        check_pattern(rows.sparkSession, p)
        try:
            pc.match_substring_regex(pa.array([""]), p)
        except pa.ArrowInvalid as e:
            raise PatternError(f"invalid filter pattern: {str(e)[:500]}") from e
    kept = [f for f in rows.schema if f.name != column]

    def run(batches):
        for b in batches:
            texts = b.column(len(kept))
            hits = np.array([pc.match_substring_regex(texts, p).fill_null(False).to_numpy(zero_copy_only=False) for p in patterns], bool).reshape(len(patterns), len(b)).T
            ends = np.append(0, np.cumsum(hits.sum(1))).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(hits)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], [*b.schema.names[:-1], name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{name}` array<int>"])
    return rows.select(*[f"`{f.name}`" for f in kept], column).mapInArrow(run, schema)
