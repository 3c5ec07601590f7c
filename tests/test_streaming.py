"""Streams give what the batch operators give, and a replay adds nothing."""

import datetime as dt

from ledgerloom.streaming import ingest

SCHEMA = "event_id long, title string, ts timestamp"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_news_once_over_batches(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    day = dt.datetime(2026, 5, 4)
    write(spark, source, [(1, "a", day), (2, "b", day), (3, "a", day + dt.timedelta(hours=1))])

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ingest.run_available(stream, ingest.append_new(out, ["title"], ["ts", "event_id"]), state)
        return sorted(r.event_id for r in spark.read.parquet(out).collect())

    assert run() == [1, 2]
    assert run() == [1, 2]
    write(spark, source, [(4, "b", day), (5, "c", day)])
    assert run() == [1, 2, 5]


def test_watermarked_operators_are_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, source, [(1, "a", dt.datetime(2026, 5, 4))])
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    assert ingest.news_stream(stream).isStreaming
    rows = []
    q = ingest.news_stream(stream).writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.event_id for r in rows] == [1] and rows[0].news_id.startswith("EV:")
