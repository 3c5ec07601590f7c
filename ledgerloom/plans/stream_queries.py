"""Registered queries that run streams over what the tables hold, with the SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.sources import tables as t
from ledgerloom.sources.folders import shared_folder
from ledgerloom.streaming import ingest

QUERIES, ORACLE_SQL = {}, {}


def sm1_news_stream(spark, sf):
    """Each title once, with its first event: a micro-batch stream into a table, then that table as it was written."""
    schema = t.table(spark, sf, "events").schema
    folder = shared_folder(spark, "news")
    t.table(spark, sf, "events").write.parquet(f"{folder}/in")
    raw = spark.readStream.schema(schema).parquet(f"{folder}/in")
    titled = raw.select("event_id", F.concat("event_type", F.lit(":"), F.col("user_id") % 50).alias("title"), "ts")
    ingest.run_available(titled, ingest.append_new(f"{folder}/out", ["title"], ["ts", "event_id"]), f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("title", "event_id")


QUERIES["sm1_news_stream"] = sm1_news_stream
ORACLE_SQL["sm1_news_stream"] = "SELECT event_type || ':' || (user_id % 50) AS title, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1"
