"""Timelines in ranges of time, and reading some of them."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from timeloom.schema import event
from timeloom.sinks.time_index import read_between, read_zones, write_indexed

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def make_events(spark, n):
    """A third of the events share one moment, some have none."""
    rows = spark.range(0, n, 1, 5).select(F.col("id").alias("line_no"), F.lit("s.log").alias("source"), F.concat(F.lit("/"), F.col("id") % 7).alias("path"))
    stamp = F.when(F.col("line_no") % 11 == 0, None).when(F.col("line_no") % 3 == 0, F.lit(START + timedelta(hours=5))).otherwise(F.lit(START) + F.make_dt_interval(mins=F.col("line_no").cast("int") * 7919 % 60_000))
    return event(rows, timestamp=stamp, event_type="X", message=F.col("line_no").cast("string"))


def test_ranges_of_time(spark, tmp_path):
    events = make_events(spark, 3000)
    zones = write_indexed(events, f"{tmp_path}/t", 12).orderBy("first", "last").collect()
    assert sum(z.rows for z in zones) == 3000 and sum(z.timeless for z in zones) == 273 and max(z.rows for z in zones) < 900 and len(zones) > 8
    assert all(a.last <= b.first for a, b in zip(zones[:-1], zones[1:], strict=True) if a.first)
    everything = {r.event_id: r.timestamp for r in events.collect()}
    naive = lambda t: t.replace(tzinfo=None)
    for since, until in ((START, START + timedelta(hours=6)), (START + timedelta(days=20), START + timedelta(days=21)), (None, START + timedelta(days=1)), (START + timedelta(days=40), None), (None, None)):
        got = read_between(spark, f"{tmp_path}/t", since, until)
        want = {i for i, t in everything.items() if t is not None and (since is None or t >= naive(since)) and (until is None or t < naive(until))}
        rows = [r.event_id for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want)
    assert len(read_between(spark, f"{tmp_path}/t", START + timedelta(days=20), START + timedelta(days=21)).inputFiles()) <= 2
    assert read_between(spark, f"{tmp_path}/t", START - timedelta(days=9), START - timedelta(days=8)).collect() == []
    assert read_between(spark, f"{tmp_path}/t", START - timedelta(days=9), START - timedelta(days=8), timeless=True).count() == 273


def test_no_events(spark, tmp_path):
    write_indexed(make_events(spark, 10).where("false"), f"{tmp_path}/t")
    assert read_between(spark, f"{tmp_path}/t").collect() == [] and read_zones(spark, f"{tmp_path}/t").count() <= 1
    with pytest.raises(Exception, match="exist"):
        write_indexed(make_events(spark, 10), f"{tmp_path}/t")
