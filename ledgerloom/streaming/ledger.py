"""Job ledgers and run totals over event time: the same rows as a batch and as a stream.

A ledger folds a job's events in the order of their time, as whole microseconds, so no worker needs to know a time zone.  The stream holds events back until the watermark passes
them, so that order doesn't depend on how they arrive; timers put back to pending what has run for too long.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.sources.folders import ship_package

PENDING, RUNNING, DONE, FAILED, SKIPPED = "pending", "running", "done", "failed", "skipped"
FINAL = (DONE, FAILED, SKIPPED)
#: Minutes after which a run counts as lost, failures after which a job is failed, and what is noted then.
STALE_MINUTES, MOST_FAILURES = 30, 3
LOST = "stale running job reset"
#: Buckets of jobs that a stream keeps together.
BUCKETS = 512

_ROW = "status string, failures int, healed int, locked_by string, locked_at long, error string, updated_at long"
_EVENTS = "us long, seq long, event string, worker string, error string"
_FIELDS = tuple(c.split()[0] for c in _ROW.split(", "))
_COLUMNS = tuple(c.split()[0] for c in _EVENTS.split(", "))
MINUTE = 60_000_000


def new_job(at: int) -> dict:
    return {"status": PENDING, "failures": 0, "healed": 0, "locked_by": None, "locked_at": None, "error": None, "updated_at": at}


def heal(job: dict, now: int, stale: int) -> dict:
    """A run that was claimed more than ``stale`` ago goes back to pending, as of the moment after that."""
    if job["status"] != RUNNING or now - job["locked_at"] <= stale:
        return job
    at = job["locked_at"] + stale
    return {**job, "status": PENDING, "healed": job["healed"] + 1, "locked_by": None, "locked_at": None, "error": LOST, "updated_at": at}


def advance(job: dict | None, event: dict, stale: int, most_failures: int) -> dict:
    """``job`` after one event: enqueue, start, done, fail or skip.  Final states stay; a run that isn't lost can't be claimed."""
    at, kind = event["us"], event["event"]
    job = heal(job or new_job(at), at, stale)
    if job["status"] in FINAL or kind == "enqueue" or (kind == "start" and job["status"] == RUNNING):
        return job
    if kind == "start":
        return {**job, "status": RUNNING, "locked_by": event["worker"], "locked_at": at, "error": None, "updated_at": at}
    free = {**job, "locked_by": None, "locked_at": None, "updated_at": at}
    if kind == "fail":
        failures = job["failures"] + 1
        return {**free, "failures": failures, "status": FAILED if failures >= most_failures else PENDING, "error": (event["error"] or "")[:1000]}
    return {**free, "status": DONE if kind == "done" else SKIPPED, "error": None if kind == "done" else (event["error"] or "")[:500]}


def _plain(row: dict) -> dict:
    """A row of a pandas frame as Python values: missing ones are None."""
    return {k: None if v is None or v != v else v for k, v in row.items()}


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["job", *_FIELDS])
    return out.astype({"job": "int64", "failures": "int32", "healed": "int32", "locked_at": "Int64", "updated_at": "int64"})


def _timed(rows: DataFrame) -> DataFrame:
    """Microseconds as timestamps."""
    return rows.withColumns({c: F.timestamp_micros(c) for c in ("locked_at", "updated_at")})


def job_ledger(events: DataFrame, as_of: dt.datetime | str, stale_minutes: int = STALE_MINUTES, most_failures: int = MOST_FAILURES) -> DataFrame:
    """The ledger at ``as_of`` of (job, at, seq, event, worker, error) rows up to then.

    Rows are sorted by job and time and read as a stream, so a job's events are never a list; events of one time go by
    ``seq``.  A null event changes nothing.
    """
    ship_package(events.sparkSession)
    stale = stale_minutes * MINUTE
    limit = F.lit(str(as_of)).cast("timestamp")
    now = events.sparkSession.range(1).select(F.unix_micros(limit)).first()[0]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, job = None, None
        for frame in frames:
            out = []
            for row in map(_plain, frame.to_dict("records")):
                if job is not None and row["job"] != name:
                    out.append((name, *(heal(job, now, stale)[f] for f in _FIELDS)))
                    job = None
                name, job = row["job"], advance(job, row, stale, most_failures)
            if out:
                yield _frame(out)
        if job is not None:
            yield _frame([(name, *(heal(job, now, stale)[f] for f in _FIELDS))])

    rows = events.withColumn("at", F.col("at").cast("timestamp")).filter((F.col("at") <= limit) & F.col("event").isNotNull())
    rows = rows.withColumn("us", F.unix_micros("at")).select("job", *_COLUMNS).repartition("job").sortWithinPartitions("job", "us", "seq")
    return _timed(rows.mapInPandas(fold, f"job long, {_ROW}"))


class LedgerProcessor(StatefulProcessor):
    """Keeps the jobs of a bucket, the events that the watermark hasn't reached, and which runs last; emits rows that have changed.

    A job costs a look-up and an update of its row when it changes.  Lists, timers and frames come once a bucket: once a job
    they would cost more than the fold.
    """

    def __init__(self, stale_minutes: int = STALE_MINUTES, most_failures: int = MOST_FAILURES):
        self.stale, self.most_failures = stale_minutes * MINUTE, most_failures

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "job long", _ROW)
        self.waiting = handle.getListState("waiting", f"job long, {_EVENTS}")
        self.running = handle.getListState("running", "job long, locked_at long")

    def _timer(self, at: int, more: int = 0) -> None:
        """At the first whole millisecond that isn't before ``at``, or some later."""
        self.handle.registerTimer(-(-at // 1000) + more)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            new = frame[["job", *_COLUMNS]].astype(object)
            self.waiting.appendList(list(new.where(new.notna(), None).itertuples(index=False, name=None)))
            low = int(frame["us"].min())
            first = low if first is None else min(first, low)
        self._timer(first)
        yield _frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, left = {}, []
        for job, *x in self.waiting.get():
            if x[0] <= now:
                due.setdefault(job, []).append(dict(zip(_COLUMNS, x)))
            else:
                left.append((job, *x))
        runs = dict(self.running.get())
        lost = [job for job, at in runs.items() if now - at > self.stale]
        out = []
        for name in {**due, **dict.fromkeys(lost)}:
            held = self.rows.getValue((name,))
            was = job = dict(zip(_FIELDS, held)) if held else None
            for x in sorted(due.get(name, ()), key=lambda x: (x["us"], x["seq"])):
                job = advance(job, x, self.stale, self.most_failures)
            job = heal(job, now, self.stale)
            runs.pop(name, None)
            if job["status"] == RUNNING:
                runs[name] = job["locked_at"]
            if job != was:
                row = tuple(job[f] for f in _FIELDS)
                self.rows.updateValue((name,), row)
                out.append((name, *row))
        for state, items, at, more in ((self.waiting, left, min((x[1] for x in left), default=None), 0), (self.running, list(runs.items()), min(runs.values(), default=0) + self.stale, 1)):
            if due or lost:
                if items:
                    state.put(items)
                    self._timer(at, more)
                else:
                    state.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


def ledger_stream(events: DataFrame, delay: str = "10 minutes", stale_minutes: int = STALE_MINUTES, most_failures: int = MOST_FAILURES, buckets: int = BUCKETS) -> DataFrame:
    """Changed rows of the ledger, as the watermark (``delay`` behind the newest event) passes events and lost runs.

    The last row of each job is the batch ledger at the watermark.  Events older than the watermark when they come are
    dropped.  Jobs are dealt into ``buckets``, which stay as they are for a checkpoint's life.  Needs the RocksDB state store.
    """
    # the process that prepares a stateful query on the driver's side has no shipped files, so this module goes by value
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = events.filter("event is not null").withColumn("at", F.col("at").cast("timestamp"))
    rows = rows.select("job", "at", F.unix_micros("at").alias("us"), *_COLUMNS[1:]).withWatermark("at", delay)
    rows = rows.withColumn("bucket", F.pmod(F.hash("job"), F.lit(buckets)))
    return _timed(rows.groupBy("bucket").transformWithStateInPandas(LedgerProcessor(stale_minutes, most_failures), f"job long, {_ROW}", "Update", "EventTime"))


def run_totals(events: DataFrame, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """(source, started_at, ended_at, events, succeeded, skipped, failed, items, last_error) of each run.

    A run is a source's events of which none comes more than ``gap`` after the one before.  As a stream (``delay``
    given), a run comes out once the watermark passes its last event and the gap; an event older than the watermark when it
    comes is dropped, and changes no total.  Events: (source, at, seq, outcome, items, error).
    """
    rows = events.withColumn("at", F.col("at").cast("timestamp"))
    rows = rows.withWatermark("at", delay) if delay else rows
    count = lambda outcome: F.count_if(F.col("outcome") == outcome)
    grouped = rows.groupBy(F.session_window("at", gap).alias("run"), "source").agg(
        F.max("at").alias("ended_at"), F.count(F.lit(1)).alias("events"), count("success").alias("succeeded"), count("skipped").alias("skipped"), count("failed").alias("failed"),
        F.sum("items").alias("items"), F.max_by("error", F.when(F.col("outcome") == "failed", F.struct("at", "seq"))).alias("last_error"),
    )
    return grouped.select("source", F.col("run.start").alias("started_at"), "ended_at", "events", "succeeded", "skipped", "failed", "items", "last_error")
