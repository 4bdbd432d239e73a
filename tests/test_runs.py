"""Runs that are watched and stopped, and batches that are added once."""

import os
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from timeloom.plans import runs
from timeloom.plans.timeline import build_timeline
from timeloom.schema import Context, event
from timeloom.sinks.batches import append_batch, read_batches, stage_batch
from timeloom.streaming import arrivals


def make_events(spark, n, first=0, parts=4):
    rows = spark.range(first, first + n, 1, parts).select(F.col("id").alias("line_no"), F.lit("s.log").alias("source"), F.lit("/s.log").alias("path"))
    return event(rows, timestamp=F.timestamp_seconds("line_no"), event_type=F.when(F.col("line_no") % 4 == 0, "XRaw").otherwise("X"), message=F.concat(F.lit('m "'), F.col("line_no"), F.lit("\nx")))


def slowly(events, seconds):
    """The same rows, each batch of them only after a while."""

    def run(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return events.mapInArrow(run, events.schema)


@pytest.mark.parametrize("kind", ["csv", "jsonl", "parquet"])
def test_a_repeated_batch_adds_nothing(spark, tmp_path, kind):
    root = f"{tmp_path}/out"
    added = [append_batch(make_events(spark, 10, 10 * i), root, kind, b) for i, b in enumerate(["a", "b", "a", "b"])]
    rows = read_batches(spark, root, kind)
    assert added == [True, True, False, False] and rows.groupBy("batch").count().orderBy("batch").collect() == [("a", 10), ("b", 10)]
    assert os.listdir(f"{root}/_staging") == []
    if kind == "csv":
        assert {int(r.event_id) for r in rows.collect()} == set(range(20))


def test_of_two_writers_of_a_batch_one_adds_it(spark, tmp_path):
    root = f"{tmp_path}/out"
    one, two = (stage_batch(make_events(spark, n), root, "jsonl", 7) for n in (5, 6))
    with ThreadPoolExecutor(2) as pool:
        added = list(pool.map(lambda s: s.commit(), (one, two)))
    assert sorted(added) == [False, True] and read_batches(spark, root, "jsonl").count() == (5 if added[0] else 6)
    assert stage_batch(make_events(spark, 5), root, "jsonl", 7) is None and os.listdir(f"{root}/_staging") == []


def test_a_batch_that_fails_leaves_nothing(spark, tmp_path):
    bad = make_events(spark, 10).withColumn("message", F.when(F.col("event_id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("message")))
    with pytest.raises(Exception, match="no"):
        append_batch(bad, f"{tmp_path}/out", "jsonl", 1)
    run = runs.start_run(bad, f"{tmp_path}/out", "jsonl", 1)
    with pytest.raises(Exception, match="no"):
        run.wait(120)
    assert run.progress().state == runs.FAILED and os.listdir(f"{tmp_path}/out/_staging") == [] and os.listdir(f"{tmp_path}/out") == ["_staging"]
    with pytest.raises(ValueError):
        append_batch(bad, f"{tmp_path}/out", "jsonl", "../x")


def test_a_run_is_watched(spark, tmp_path):
    run = runs.start_run(slowly(make_events(spark, 4000, parts=16), 0.3), f"{tmp_path}/out", "jsonl", 1)
    seen = []
    while run.progress().state == runs.RUNNING:
        seen.append(run.progress())
        time.sleep(0.1)
    end = run.wait(120)
    assert (end.state, end.events, end.raw, end.percent) == (runs.DONE, 4000, 1000, 100.0) and end.events_a_second > 0
    assert any(p.tasks == 16 for p in seen) and [p.tasks_done for p in seen] == sorted(p.tasks_done for p in seen) and max(p.tasks_done for p in seen) > 0
    assert read_batches(spark, f"{tmp_path}/out", "jsonl").count() == 4000
    assert runs.start_run(make_events(spark, 5), f"{tmp_path}/out", "jsonl", 1).wait(120).state == runs.REPEATED


def test_a_stopped_run_leaves_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"{i}.cbs.log").write_text("2023-04-21 15:30:45, Info a\n" * 50)
    append_batch(make_events(spark, 10), f"{tmp_path}/out", "jsonl", "before")
    events = build_timeline(spark, f"{tmp_path}/in", context=Context(datetime(2024, 1, 1, tzinfo=timezone.utc))).events
    run, began = runs.start_run(slowly(events.repartition(8), 60), f"{tmp_path}/out", "jsonl", 1), time.time()
    while not run.progress().tasks:
        time.sleep(0.1)
    other = runs.start_run(make_events(spark, 20), f"{tmp_path}/out", "jsonl", 2)
    run.cancel()
    assert run.progress().state == runs.CANCELLED and time.time() - began < 50 and other.wait(120).state == runs.DONE
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["_staging", "batch=2", "batch=before"] and os.listdir(f"{tmp_path}/out/_staging") == []
    run.cancel()
    other.cancel()
    assert other.progress().state == runs.DONE and read_batches(spark, f"{tmp_path}/out", "jsonl").count() == 30


def test_a_stream_that_starts_again(spark, tmp_path):
    """Without its checkpoint a stream hands out the same batches again, which add nothing."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "cbs.log").write_text("2023-04-21 15:30:45, Info a\nraw\n")
    for n in (1, 2):
        arrivals.stream_batches(spark, str(folder), f"{tmp_path}/out", "jsonl", f"{tmp_path}/checkpoint{n}").awaitTermination(120)
    assert read_batches(spark, f"{tmp_path}/out", "jsonl").count() == 2
    (folder / "more.cbs.log").write_text("2023-04-21 15:30:45, Info b\n")
    arrivals.stream_batches(spark, str(folder), f"{tmp_path}/out", "jsonl", f"{tmp_path}/checkpoint2").awaitTermination(120)
    assert read_batches(spark, f"{tmp_path}/out", "jsonl").count() == 3


def test_command_line_batches(spark, tmp_path, capsys):
    from timeloom import cli

    (tmp_path / "cbs.log").write_text("2023-04-21 15:30:45, Info a\nraw\n")
    args = ["--input", str(tmp_path / "cbs.log"), "--output", f"{tmp_path}/out", "--format", "jsonl", "--batch", "one"]
    assert cli.main(args) == 0 and cli.main(args) == 0 and read_batches(spark, f"{tmp_path}/out", "jsonl").count() == 2
    told = capsys.readouterr().err
    assert "done: 100 %, 2 events" in told and "repeated" in told
    with pytest.raises(SystemExit):
        cli.main([*args[:4], "--format", "sqlite", "--batch", "two"])
