"""Evidence into signals: a stream gives the batch's rows; replays and a kill between both tables change nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import signal_rules as r
from ledgerloom.operators.store import TableSet
from ledgerloom.streaming import evidence as e
from ledgerloom.streaming import ingest

SCHEMA = "source_type string, source_id string, title string, summary string, content string, published_at date"


def subject():
    return F.concat(F.lit("C:"), F.col("source_id").cast("long") % 3)


def at():
    return F.lit("2026-05-04 00:00:00").cast("timestamp")


def payloads(spark, ids, extra=""):
    words = [w for *_, ws in r.SIGNALS.values() for w in ws]
    rows = [("news", str(i), f"title {i}", None, f"{words[i % len(words)]}。{words[i * 7 % len(words)]}{extra}。", dt.date(2026, 1, 1) if i % 2 else None) for i in ids]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def paths(spark):
    rows = [("C:0", ["C:0", "P:1"], ["SUPPLIES"], [0.5]), ("C:0", ["C:0", "P:1", "U:9"], ["SUPPLIES", "USED_BY"], [0.5, 0.9]), ("C:1", ["C:1", "P:2"], ["PEER"], [1.0])]
    return spark.createDataFrame(rows, "subject string, nodes array<string>, rels array<string>, weights array<double>")


def rows(df):
    return sorted(map(str, df.collect()))


def test_stream_is_the_batch(spark, tmp_path, paths):
    source, state, folder = (f"file://{tmp_path}/{x}" for x in ("in", "state", "out"))
    store = TableSet(spark, folder)
    for part in range(3):
        payloads(spark, range(part * 8, part * 8 + 8)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ingest.run_available(stream, e.evidence_sink(store, subject(), paths, at(), 4), state)
    found, spread = e.signals_and_propagations(payloads(spark, range(24)), subject(), paths, at())
    assert rows(store.table("signals").select(*found.columns)) == rows(found) and found.count() > 20
    assert rows(store.table("propagations").select(*spread.columns)) == rows(spread) and spread.count() > 20
    assert store.manifest()["streams"] == {"evidence": 2}


def test_replay_and_kill(spark, tmp_path, paths, monkeypatch):
    store = TableSet(spark, f"file://{tmp_path}/out")
    sink = e.evidence_sink(store, subject(), paths, at(), 4)
    sink(payloads(spark, range(6)), 0)
    before = (store.manifest(), rows(store.table("signals")), rows(store.table("propagations")))
    sink(payloads(spark, range(6)), 0)
    sink(payloads(spark, range(6, 9)), 0)  # another batch under a number that is committed
    assert (store.manifest(), rows(store.table("signals")), rows(store.table("propagations"))) == before
    held, calls = TableSet._stage, []

    def breaks(self, name, *rest):
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return held(self, name, *rest)

    monkeypatch.setattr(TableSet, "_stage", breaks)
    with pytest.raises(RuntimeError):
        sink(payloads(spark, range(6, 9)), 1)
    monkeypatch.setattr(TableSet, "_stage", held)
    assert (store.manifest(), rows(store.table("signals")), rows(store.table("propagations"))) == before
    sink(payloads(spark, range(6, 9)), 1)
    found, _ = e.signals_and_propagations(payloads(spark, range(9)), subject(), paths, at())
    assert store.table("signals").count() == found.count()


def test_refreshed_columns(spark, tmp_path, paths):
    store = TableSet(spark, f"file://{tmp_path}/out")
    e.evidence_sink(store, subject(), paths, at(), 4)(payloads(spark, range(4)), 0)
    later = F.lit("2026-06-01 00:00:00").cast("timestamp")
    old = {r.signal_id: r for r in store.table("signals").collect()}
    changed = payloads(spark, range(4)).withColumn("published_at", F.lit("2026-05-30").cast("date"))
    e.evidence_sink(store, subject(), paths, later, 4)(changed, 1)
    for row in store.table("signals").collect():
        assert row.detected_at == dt.datetime(2026, 6, 1) and row.freshness == 100
        assert row.published_at == old[row.signal_id].published_at and row.strength == old[row.signal_id].strength
