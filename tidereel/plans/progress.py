"""Progress of a run as a table of events, and cancelling (K9)."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from threading import Event, Lock, Thread

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidereel.sources import files

EVENT = "run string, number long, at timestamp, phase string, state string, counts map<string,bigint>, detail string"
OUTCOME = "source_path string, ok boolean, error string, segments long, from_store boolean"


class Cancelled(Exception):
    """A run that was told to stop; what it has committed to the store stays."""


class Progress:
    """The events of one run below ``path``; without a path none are kept, but a run can still be cancelled.

    An event is a small file that appears whole. There are a few for each
    phase, slice and micro-batch, none for each source: how each source ended
    is a table that Spark writes (``outcomes``). ``cancel`` may be called by
    any thread of the driver.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, run: str | None = None):
        self.spark, self.path, self.run = spark, path, run or uuid.uuid4().hex
        self.tag = f"run-{self.run}"
        self._stop, self._lock, self._number, self._open = Event(), Lock(), 0, 0

    def emit(self, phase: str, state: str, counts: dict[str, int] | None = None, detail: str | None = None) -> None:
        if self.path is None:
            return
        with self._lock:
            self._number += 1
            number = self._number
        row = {"run": self.run, "number": number, "at": datetime.now(UTC).isoformat(), "phase": phase, "state": state, "counts": counts or {}, "detail": detail}
        if not files.write_new(self.spark, f"{self.path}/events/{self.run}-{number:09d}.json", json.dumps(row)):
            raise FileExistsError(f"the run {self.run} has events already")

    def cancel(self) -> None:
        """Ends the jobs of this run, also those that its phase was just about to start; it raises ``Cancelled`` and starts no further phase."""
        self._stop.set()

        def end():
            while self._open:
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
                time.sleep(0.2)

        Thread(target=end, daemon=True).start()

    def check(self) -> None:
        if self._stop.is_set():
            raise Cancelled(self.run)

    @contextmanager
    def phase(self, name: str) -> Iterator[dict[str, int]]:
        """Events at the start and the end of a phase; the counts put into the dict that it gives go with the last one. Phases may be nested."""
        self.check()
        context = self.spark.sparkContext
        outer = self.tag in context.getJobTags()
        counts: dict[str, int] = {}
        self.emit(name, "started")
        context.addJobTag(self.tag)
        self._open += 1
        try:
            yield counts
            self.check()
        except Exception as error:
            stopped = self._stop.is_set()
            self.emit(name, "cancelled" if stopped else "failed", counts, None if stopped else str(error)[:2000])
            if stopped:
                raise Cancelled(self.run) from error
            raise
        finally:
            self._open -= 1
            if not outer:
                context.removeJobTag(self.tag)
        self.emit(name, "finished", counts)

    def outcomes(self, rows: DataFrame) -> None:
        """How each source ended: ``rows`` as ``OUTCOME`` says."""
        if self.path is not None:
            rows.write.parquet(f"{self.path}/outcomes/run={self.run}")

    @contextmanager
    def streams(self, name: str = "stream", wait: float = 10.0) -> Iterator[None]:
        """Events of the micro-batches of all queries that start inside; at the end it waits up to ``wait`` seconds for those of queries that have ended."""
        listener = _Batches(self, name)
        self.spark.streams.addListener(listener)
        try:
            yield
            until = time.monotonic() + wait
            active = lambda: {str(q.id) for q in self.spark.streams.active}
            while listener.open - active() and time.monotonic() < until:
                time.sleep(0.05)
        finally:
            self.spark.streams.removeListener(listener)


class _Batches(StreamingQueryListener):
    def __init__(self, progress: Progress, name: str):
        self.progress, self.name, self.open = progress, name, set()

    def onQueryStarted(self, event):
        self.open.add(str(event.id))
        self.progress.emit(self.name, "started", detail=str(event.id))

    def onQueryProgress(self, event):
        p = event.progress
        self.progress.emit(self.name, "batch", {"batch": p.batchId, "rows": p.numInputRows, "milliseconds": p.batchDuration}, str(p.id))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.progress.emit(self.name, "failed" if event.exception else "finished", detail=event.exception and str(event.exception)[:2000] or str(event.id))
        self.open.discard(str(event.id))


def events(spark: SparkSession, path: str) -> DataFrame:
    """All events below ``path``."""
    held = files.exists(spark, f"{path}/events")
    return spark.read.schema(EVENT).json(f"{path}/events") if held else spark.createDataFrame([], EVENT)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """How each source of each run ended."""
    held = files.exists(spark, f"{path}/outcomes")
    rows = spark.read.schema(f"{OUTCOME}, run string").parquet(f"{path}/outcomes") if held else spark.createDataFrame([], f"{OUTCOME}, run string")
    return rows.select("run", *[c.split()[0] for c in OUTCOME.split(", ")])


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last event of each phase of each run."""
    return events(spark, path).groupBy("run", "phase").agg(F.max_by(F.struct("number", "at", "state", "counts", "detail"), "number").alias("e")).select("run", "phase", "e.*")
