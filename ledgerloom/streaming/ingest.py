"""Streams over the same operators: news with bounded state, signals by micro-batch, and job ledgers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import ids
from ledgerloom.operators.upsert import insert_absent, keep_first


def news_stream(raw: DataFrame, delay: str = "1 day") -> DataFrame:
    """News (title, ts, ...) once for each id while its watermark lasts; later repeats within the delay drop."""
    return raw.withColumn("news_id", ids.news_id(F.col("title"))).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["news_id"])


def hourly_totals(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Counts by hour and kind; an hour is final once the watermark passes its end."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("hour"), "event_type", "events")


def append_new(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that adds rows of keys that the table lacks: exact, and the same after a replay."""

    def write(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        first = keep_first(batch, keys, order)
        try:
            known = spark.read.parquet(path)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = first.limit(0)
        insert_absent(known, first, keys).write.mode("append").parquet(path)

    return write


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what there is, then stop: one code path for back-fill and stream."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
