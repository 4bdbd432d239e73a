"""A timeline being written: what it has done so far, and a way to stop it that leaves nothing behind."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sinks.batches import Staged, stage_batch

RUNNING, DONE, REPEATED, CANCELLED, FAILED = "running", "done", "repeated", "cancelled", "failed"


@dataclass(frozen=True)
class Progress:
    """``events`` and ``raw`` (those that no pattern fitted) are exact when the run is done; before, ``events`` is what tasks have written."""

    state: str
    tasks: int
    tasks_done: int
    bytes_read: int
    events: int
    raw: int | None
    seconds: float

    @property
    def percent(self) -> float:
        return 100.0 if self.state == DONE else 100.0 * self.tasks_done / self.tasks if self.tasks else 0.0

    @property
    def events_a_second(self) -> int:
        return round(self.events / self.seconds) if self.seconds else 0


class Run:
    """One batch of events on its way into a timeline. Its jobs have a group of their own, so that it alone is stopped."""

    def __init__(self, events: DataFrame, root: str, kind: str, batch: int | str):
        self._spark: SparkSession = events.sparkSession
        self._sc = self._spark.sparkContext
        self._group = f"timeloom-{uuid.uuid4().hex}"
        self._counted = Observation(self._group)
        # Counted where events are written: no file is read for it once more.
        observed = events.observe(self._counted, F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type").endswith("Raw")).alias("raw"))
        self._state, self._error, self._final = RUNNING, None, {}
        self._lock, self._stop = threading.Lock(), False
        self._began, self._ended = time.time(), None
        self._thread = InheritableThread(target=self._work, args=(observed, root, kind, batch), daemon=True)
        self._thread.start()

    def _work(self, events: DataFrame, root: str, kind: str, batch: int | str) -> None:
        self._sc.setJobGroup(self._group, f"timeline batch {batch}", interruptOnCancel=True)
        staged: Staged | None = None
        try:
            if not self._stop:
                staged = stage_batch(events, root, kind, batch)
            with self._lock:  # either the batch is part of the timeline, or it was stopped
                if self._stop:
                    state = CANCELLED
                elif staged is None:
                    state = REPEATED
                else:
                    self._final = dict(self._counted.get)
                    state, staged = (DONE if staged.commit() else REPEATED), None
            if staged is not None:
                staged.discard()
        except BaseException as e:  # told by wait()
            state, self._error = (CANCELLED, None) if self._stop else (FAILED, e)
        self._ended, self._state = time.time(), state

    def cancel(self) -> None:
        """Stops the run's tasks. A batch that was added before stays; else nothing of it does."""
        with self._lock:
            self._stop = self._state == RUNNING
        if self._stop:
            while self._thread.is_alive():  # a job that begins meanwhile is stopped too
                self._sc.cancelJobGroup(self._group)
                self._thread.join(0.2)

    def progress(self) -> Progress:
        tracker, store = self._sc.statusTracker(), self._sc._jsc.sc().statusStore()
        tasks = done = size = written = 0
        for job in tracker.getJobIdsForGroup(self._group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                seen = tracker.getStageInfo(stage)
                if seen is None:  # it hasn't begun
                    continue
                tasks, done = tasks + seen.numTasks, done + seen.numCompletedTasks
                last = store.lastStageAttempt(stage)
                size, written = size + last.inputBytes(), written + last.outputRecords()
        return Progress(self._state, tasks, done, size, self._final.get("events", written), self._final.get("raw"), (self._ended or time.time()) - self._began)

    def wait(self, seconds: float | None = None) -> Progress:
        """What there is when the run has ended, or after ``seconds``. Raises what made it fail."""
        self._thread.join(seconds)
        if self._error is not None:
            raise self._error
        return self.progress()


def start_run(events: DataFrame, root: str, kind: str, batch: int | str) -> Run:
    """Begins to add a batch of events (csv, jsonl, parquet) to the timeline below ``root``, and returns at once."""
    return Run(events, root, kind, batch)
