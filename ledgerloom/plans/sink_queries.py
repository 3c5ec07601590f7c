"""Merges that write: bucketed tables merged in place, and evidence streamed into signals and propagations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.signal_rules import SIGNALS
from ledgerloom.operators.store import BUCKETS, TableSet, upsert_sink
from ledgerloom.plans.bindings import ANNOUNCEMENTS, EDGES, with_
from ledgerloom.plans.rule_queries import _PATHS, PAYLOADS, _found, company_paths, payloads
from ledgerloom.sources import tables as t
from ledgerloom.sources.folders import shared_folder
from ledgerloom.streaming import evidence as e
from ledgerloom.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


@query("snk4_bucketed_merges", """WITH a AS (SELECT o_orderkey AS id, o_custkey AS owner, o_totalprice AS amount, o_orderdate AS created FROM orders WHERE o_orderkey % 3 <> 0),
    b AS (SELECT o_orderkey AS id, o_custkey + 1 AS owner, o_totalprice * CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 0.5 END AS amount, o_orderdate + INTERVAL 1 DAY AS created FROM orders WHERE o_orderkey % 2 = 0),
    m AS (SELECT coalesce(a.id, b.id) AS id, coalesce(b.owner, a.owner) AS owner, greatest(a.amount, b.amount) AS amount, coalesce(a.created, b.created) AS created FROM a FULL JOIN b ON a.id = b.id),
    c AS (SELECT id, owner * 10 AS owner FROM m WHERE id % 64 < 3)
    SELECT m.id, coalesce(c.owner, m.owner) AS owner, amount, created FROM m LEFT JOIN c ON m.id = c.id""")
def bucketed_merges(spark, sf):
    """Three merges into a table on shared storage; the last one only reaches the buckets of its keys."""
    store = TableSet(spark, shared_folder(spark, "merges"))
    o = t.table(spark, sf, "orders")
    row = lambda owner, amount, created: (F.col("o_orderkey").alias("id"), owner.alias("owner"), amount.alias("amount"), created.alias("created"))
    policies = {"owner": "take_new", "amount": "greatest", "created": "keep_old"}
    store.merge({"orders": (o.filter("o_orderkey % 3 <> 0").select(*row(F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderdate"))), ["id"], policies, "take_new")})
    changed = F.col("o_totalprice") * F.when(F.col("o_custkey") % 2 == 0, 2.0).otherwise(0.5)
    later = o.filter("o_orderkey % 2 = 0").select(*row(F.col("o_custkey") + 1, changed, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")))
    store.merge({"orders": (later, ["id"], policies, "take_new")})
    some = store.table("orders").filter("id % 64 < 3").withColumn("owner", F.col("owner") * 10)
    store.merge({"orders": (some, ["id"], policies, "take_new")})
    return store.table("orders")


@query("snk3_streamed_inserts", "SELECT user_id, arg_min(event_id, event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def streamed_inserts(spark, sf):
    """Inserts that ignore known keys, by micro-batches into a bucketed table."""
    folder = shared_folder(spark, "inserts")
    rows = t.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    # a batch that comes later never has a smaller number
    for k, part in enumerate(("event_id < 3000", "event_id >= 3000")):
        rows.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    store = TableSet(spark, f"{folder}/out")
    ingest.run_available(stream, upsert_sink(store, "first", ["user_id"], ["event_id"], default="keep_old"), f"{folder}/state")
    return store.table("first")


@query("sm2_evidence_stream", f"""{with_(ANNOUNCEMENTS, PAYLOADS, _found('payloads'), EDGES, _PATHS)},
    x AS (SELECT signal_id, dst AS target, concat_ws(' ', src, CASE WHEN hops = 2 THEN '-[' || rels[1] || ']-> ' || mid END, '-[' || rels[hops] || ']-> ' || dst) AS relation_path, kind, polarity, hops,
        CASE WHEN kind = 'risk' THEN 'risk_contagion' WHEN list_contains(rels, 'SUPPLIES') THEN 'supply_chain_validation' WHEN list_contains(rels, 'USED_BY') THEN 'customer_demand_validation' END AS secondary_type FROM told JOIN best ON subject = src),
    s AS (SELECT DISTINCT signal_id, source_id, kind, strength, value, freshness FROM signals)
    SELECT 'signal' AS record, signal_id AS id, source_id AS about, kind, value::DOUBLE AS score FROM s
    UNION ALL SELECT 'propagation', 'PROP:' || substr(sha256(concat_ws('|', signal_id, target, relation_path)), 1, 20), target, secondary_type, hops FROM x""")
def evidence_stream(spark, sf):
    """Signals and their propagations as a stream of evidence left them, both tables in one commit a batch."""
    folder = shared_folder(spark, "evidence")
    rows = payloads(spark, sf)
    companies = t.table(spark, sf, "supplier").count()
    company_paths(spark, sf).write.parquet(f"{folder}/paths")
    # a feed of two batches, in the files that its tasks write; few tasks are dealt over four files
    (rows if rows.rdd.getNumPartitions() >= 4 else rows.repartition(4)).write.parquet(f"{folder}/in")
    files = len(spark.read.schema(rows.schema).parquet(f"{folder}/in").inputFiles())
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(f"{folder}/in")
    store = TableSet(spark, f"{folder}/out")
    subject = F.concat(F.lit("C:"), F.col("source_id").cast("long") % companies)
    # so many buckets that one holds a million propagations at most, were every text to show every kind
    buckets = max(BUCKETS, -(-t.table(spark, sf, "documents").count() * len(SIGNALS) * 20 // t.TASK_ROWS))
    sink = e.evidence_sink(store, subject, spark.read.parquet(f"{folder}/paths"), F.lit("2026-05-04").cast("timestamp"), buckets)
    ingest.run_available(stream, sink, f"{folder}/state")
    signals = store.table("signals").select(F.lit("signal").alias("record"), F.col("signal_id").alias("id"), F.col("source_id").alias("about"), "kind", F.col("value").cast("double").alias("score"))
    return signals.unionByName(store.table("propagations").select(F.lit("propagation").alias("record"), F.col("propagation_id").alias("id"), F.col("target").alias("about"), F.col("secondary_type").alias("kind"), F.col("hops").cast("double").alias("score")))
