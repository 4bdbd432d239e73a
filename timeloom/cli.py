"""``python -m timeloom.cli --input PATH --output PATH --format csv|jsonl|sqlite|parquet [--filter PATTERN] [--batch ID]``"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from .plans.runs import CANCELLED, RUNNING, Run, start_run
from .plans.timeline import build_timeline
from .schema import Context
from .sinks.batches import WRITERS
from .sinks.writers import sink


def watched(run: Run, every: float = 2.0) -> bool:
    """Tells how far a run is until it ends, and whether it was not stopped. An interrupt stops it."""
    try:
        while True:
            now = run.wait(every)
            print(f"{now.state}: {now.percent:.0f} %, {now.events} events, {now.events_a_second} a second", file=sys.stderr)
            if now.state != RUNNING:
                return now.state != CANCELLED
    except KeyboardInterrupt:
        run.cancel()
        print(run.progress().state, file=sys.stderr)
        return False


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="One timeline from many logs and artifacts.")
    p.add_argument("--input", required=True, action="append", help="file or folder; may be repeated")
    p.add_argument("--output", required=True)
    p.add_argument("--format", default="jsonl", choices=["csv", "jsonl", "sqlite", "parquet"])
    p.add_argument("--filter", help="keep events whose user, host, message or source matches")
    p.add_argument("--only", action="append", help="parser to use; may be repeated")
    p.add_argument("--max-size", type=int, help="bytes above which files are skipped and reported; all are read by default")
    p.add_argument("--reference-time", type=datetime.fromisoformat, help="what formats without a date or year take for now")
    p.add_argument("--compat", action="store_true")
    p.add_argument("--batch", help="add the events to the timeline at the output as the batch of this id, once; an interrupt leaves nothing of it")
    a = p.parse_args(args)
    if a.batch is not None and a.format not in WRITERS:
        p.error(f"batches are {', '.join(WRITERS)}")
    spark = SparkSession.builder.appName("timeloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = a.reference_time or datetime.now(timezone.utc)
    timeline = build_timeline(spark, *a.input, pattern=a.filter, context=Context(now if now.tzinfo else now.replace(tzinfo=timezone.utc), a.compat), only=set(a.only) if a.only else None, max_size=a.max_size)
    if a.batch is None:
        sink(a.format)(timeline.events, a.output)
    elif not watched(start_run(timeline.events, a.output, a.format, a.batch)):
        return 1
    for r in timeline.errors.toLocalIterator():
        print(f"{r.path}: {r.error}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
