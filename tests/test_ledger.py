"""Ledgers and run totals: batch against plain Python, stream against batch, and both after a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import ledger as l

DAY = dt.datetime(2026, 5, 4)
SCHEMA = "job long, at timestamp, seq long, event string, worker string, error string"
MINUTE = dt.timedelta(minutes=1)


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def one(spark, events, as_of):
    rows = [(1, DAY + m * MINUTE, i, e, "w", "boom") for i, (m, e) in enumerate(events)]
    return l.job_ledger(spark.createDataFrame(rows, SCHEMA), DAY + as_of * MINUTE).first()


@pytest.mark.parametrize(
    "events,as_of,want",
    [
        ([(0, "enqueue")], 1, ("pending", 0, 0)),
        ([(0, "enqueue"), (1, "start")], 31, ("running", 0, 0)),
        ([(0, "enqueue"), (1, "start")], 32, ("pending", 0, 1)),
        ([(0, "start"), (31, "start")], 40, ("running", 0, 1)),
        ([(0, "start"), (20, "start")], 29, ("running", 0, 0)),
        ([(0, "start"), (5, "done"), (6, "fail")], 99, ("done", 0, 0)),
        ([(0, "start"), (1, "fail"), (2, "start"), (3, "fail")], 9, ("pending", 2, 0)),
        ([(0, "start"), (1, "fail"), (2, "start"), (3, "fail"), (4, "start"), (5, "fail")], 9, ("failed", 3, 0)),
        ([(0, "start"), (40, "done")], 50, ("done", 0, 1)),
        ([(0, "enqueue"), (1, "skip")], 50, ("skipped", 0, 0)),
        ([(0, "start"), (60, "done")], 10, ("running", 0, 0)),
    ],
)
def test_ledger_cases(spark, events, as_of, want):
    row = one(spark, events, as_of)
    assert (row.status, row.failures, row.healed) == want
    assert (row.error == l.LOST) == (want[0] == "pending" and want[2] > 0)
    assert (row.locked_at is not None) == (row.status == "running")


def made(seed, jobs=40):
    rng = random.Random(seed)
    rows = []
    for seq in range(600):
        rows.append((rng.randrange(jobs), DAY + dt.timedelta(seconds=rng.randrange(6 * 3600)), seq, rng.choice(["enqueue", "start", "start", "start", "done", "fail", "skip", None]), f"w{seq % 3}", "e" * (seq % 4)))
    return rows


def final(rows):
    last = {}
    for r in rows:
        if r.job not in last or r.updated_at >= last[r.job].updated_at:
            last[r.job] = r
    return sorted(tuple(r) for r in last.values())


def test_stream_is_the_batch(rocks, tmp_path):
    """Files in time order but shuffled inside, a restart between them, and an event that comes too late."""
    spark, rows = rocks, made(1)
    newest = max(r[1] for r in rows)
    rows += [(41, newest - 10 * MINUTE, 1, "start", "w", None), (42, newest - 40 * MINUTE, 2, "start", "w", None), (43, newest - 40 * MINUTE - dt.timedelta(microseconds=300), 3, "start", "w", None)]
    rows = sorted(rows, key=lambda r: r[1])
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    got = []

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        out = l.ledger_stream(stream, "10 minutes").writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True)
        out.foreachBatch(lambda df, _: got.extend(df.collect())).start().awaitTermination()

    for part in range(3):
        some = rows[part * 201 : part * 201 + 201]
        random.Random(part).shuffle(some)
        if part == 2:
            some.append((7, DAY, 9_999, "done", "late", None))  # hours behind the watermark by now
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run()
    mark = max(r[1] for r in rows if r[3]) - 10 * MINUTE
    want = l.job_ledger(spark.createDataFrame(rows, SCHEMA), mark).collect()
    assert final(got) == sorted(tuple(r) for r in want)
    before = len(got)
    run()
    assert len(got) == before


TOTALS = "source string, at timestamp, seq long, outcome string, items long, error string"


def plain_totals(rows, gap):
    out = []
    for source in {r[0] for r in rows}:
        run = []
        for r in [*sorted((r for r in rows if r[0] == source), key=lambda r: (r[1], r[2])), None]:
            if run and (r is None or r[1] - run[-1][1] >= gap):
                bad = [x for x in run if x[3] == "failed"]
                out.append((source, run[0][1], run[-1][1], len(run), *(sum(x[3] == k for x in run) for k in ("success", "skipped", "failed")), sum(x[4] for x in run), bad[-1][5] if bad else None))
                run = []
            run.append(r)
    return sorted(out)


def test_run_totals(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((rng.choice("abc"), DAY + dt.timedelta(seconds=rng.randrange(20 * 3600)), i, rng.choice(["success", "skipped", "failed"]), rng.randrange(9), f"e{i}") for i in range(200))
    rows.sort(key=lambda r: r[1])
    batch = l.run_totals(spark.createDataFrame(rows, TOTALS)).collect()
    assert sorted(tuple(r) for r in batch) == plain_totals(rows, 30 * MINUTE)

    source, state, got = str(tmp_path / "in"), str(tmp_path / "state"), []
    late = ("a", DAY - dt.timedelta(hours=1), 999, "failed", 100, "late")
    for part in range(4):
        some = rows[part * 50 : part * 50 + 50] + ([late] if part == 3 else [])
        spark.createDataFrame(some, TOTALS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(TOTALS).parquet(source)
        out = l.run_totals(stream, delay="1 hour").writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True)
        out.foreachBatch(lambda df, _: got.extend(df.collect())).start().awaitTermination()
    mark = rows[-1][1] - 60 * MINUTE
    assert sorted(tuple(r) for r in got) == [r for r in plain_totals(rows, 30 * MINUTE) if r[2] + 30 * MINUTE <= mark]
    assert not any(r.last_error == "late" for r in got)


def test_jobs_of_one_bucket_keep_apart(rocks, tmp_path):
    """Forty jobs in two buckets, whose timers, lists and rows they share, against the batch."""
    rows = sorted((r for r in made(3) if r[3]), key=lambda r: r[1])
    source, state, got = str(tmp_path / "in"), str(tmp_path / "state"), []
    for part in range(2):
        rocks.createDataFrame(rows[part * 260 : part * 260 + 260], SCHEMA).write.mode("append").parquet(source)
        out = l.ledger_stream(rocks.readStream.schema(SCHEMA).parquet(source), "10 minutes", buckets=2).writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True)
        out.foreachBatch(lambda df, _: got.extend(df.collect())).start().awaitTermination()
    want = l.job_ledger(rocks.createDataFrame(rows[:520], SCHEMA), max(r[1] for r in rows[:520]) - 10 * MINUTE).collect()
    assert final(got) == sorted(tuple(r) for r in want)
