"""Job ledgers and run totals over the events, as batches and as streams, with the SQL of the same rows.

A job is a user's events of a day; the stream is fed in three parts, in the order of time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources import tables as t
from ledgerloom.sources.folders import shared_folder
from ledgerloom.streaming import ledger as l

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Minutes after which a run is lost in these queries: the events of a job are hours apart.
STALE = 240
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


_KINDS = {"signup": "enqueue", "view": "start", "click": "start", "error": "fail", "purchase": "done"}


def _ledger_sql(as_of: str) -> str:
    """SQL of the ledger at ``as_of``: each job's events one after another."""
    lost = f"(w.status = 'running' AND e.t0 > w.locked_at + INTERVAL {STALE} MINUTE)"
    status = f"(CASE WHEN {lost} THEN 'pending' ELSE w.status END)"
    stays = f"({status} IN ('done', 'failed', 'skipped') OR e.event = 'enqueue' OR (e.event = 'start' AND {status} = 'running'))"
    now_lost = f"(status = 'running' AND (SELECT m FROM z) > locked_at + INTERVAL {STALE} MINUTE)"
    kinds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())
    return f"""WITH RECURSIVE z AS (SELECT {as_of} AS m FROM events),
    e AS (SELECT user_id * 1000 + dayofyear(ts) AS job, ts AS t0, event_id AS seq, CASE event_type {kinds} END AS event, 'w' || event_id % 7 AS worker, 'e' || event_id AS error,
        row_number() OVER (PARTITION BY user_id * 1000 + dayofyear(ts) ORDER BY ts, event_id) AS k FROM events, z WHERE ts <= m),
    walk AS (SELECT job, 0::BIGINT AS k, 'pending' AS status, 0 AS failures, 0 AS healed, NULL::VARCHAR AS locked_by, NULL::TIMESTAMP AS locked_at, NULL::VARCHAR AS error, t0 AS updated_at FROM e WHERE k = 1
        UNION ALL SELECT e.job, e.k,
            CASE WHEN {stays} THEN {status} WHEN e.event = 'start' THEN 'running' WHEN e.event = 'done' THEN 'done' WHEN w.failures + 1 >= 3 THEN 'failed' ELSE 'pending' END,
            w.failures + (NOT {stays} AND e.event = 'fail')::INTEGER, w.healed + {lost}::INTEGER,
            CASE WHEN {stays} THEN CASE WHEN {lost} THEN NULL ELSE w.locked_by END WHEN e.event = 'start' THEN e.worker END,
            CASE WHEN {stays} THEN CASE WHEN {lost} THEN NULL ELSE w.locked_at END WHEN e.event = 'start' THEN e.t0 END,
            CASE WHEN {stays} THEN CASE WHEN {lost} THEN '{l.LOST}' ELSE w.error END WHEN e.event = 'fail' THEN e.error END,
            CASE WHEN {stays} THEN CASE WHEN {lost} THEN w.locked_at + INTERVAL {STALE} MINUTE ELSE w.updated_at END ELSE e.t0 END
        FROM walk w JOIN e ON e.job = w.job AND e.k = w.k + 1),
    last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY job ORDER BY k DESC) = 1)
    SELECT job, CASE WHEN {now_lost} THEN 'pending' ELSE status END AS status, failures, healed + {now_lost}::INTEGER AS healed, CASE WHEN NOT {now_lost} THEN locked_by END AS locked_by,
        CASE WHEN NOT {now_lost} THEN locked_at END AS locked_at, CASE WHEN {now_lost} THEN '{l.LOST}' ELSE error END AS error, CASE WHEN {now_lost} THEN locked_at + INTERVAL {STALE} MINUTE ELSE updated_at END AS updated_at FROM last"""


def _job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for name, event in _KINDS.items():
        kind = F.when(F.col("event_type") == name, event).otherwise(kind)
    return t.table(spark, sf_dir, "events").select(
        (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("job"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), kind.alias("event"), F.concat(F.lit("w"), F.col("event_id") % 7).alias("worker"), F.concat(F.lit("e"), "event_id").alias("error")
    )


def _newest(rows: DataFrame, at: str) -> str:
    """The newest time of the table (one aggregated value), or the epoch for an empty one."""
    return rows.agg(F.date_format(F.max(at), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("m")).first().m or "1970-01-01"


def _fed(spark: SparkSession, rows: DataFrame, at: str, folder: str, run: Callable[[DataFrame], None]) -> None:
    """Runs the stream over ``rows`` in three parts, in the order of time; a part is written when the one before is done."""
    low, high = rows.agg(F.percentile_approx(F.unix_micros(at), [1 / 3, 2 / 3])).first()[0] or (0, 0)
    part = F.when(F.unix_micros(at) <= low, 0).when(F.unix_micros(at) <= high, 1).otherwise(2)
    for k in range(3):
        rows.filter(part == k).write.mode("append").parquet(folder)
        run(spark.readStream.schema(rows.schema).parquet(folder))


@query("sm3_healing_ledger", _ledger_sql("max(ts)"))
def healing_ledger(spark, sf):
    events = _job_events(spark, sf)
    return l.job_ledger(events, _newest(events, "at"), STALE)


@query("sm3_ledger_stream", _ledger_sql("date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE"))
def ledger_stream(spark, sf):
    """The ledger as a stateful stream left it, ten minutes behind the newest event."""
    folder, events = shared_folder(spark, "ledger"), _job_events(spark, sf)

    def run(stream):
        changed = l.ledger_stream(stream, "10 minutes", STALE).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        # a batch that is replayed overwrites its own folder
        changed.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n:06d}")).start().awaitTermination()

    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        _fed(spark, events, "at", f"{folder}/in", run)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was) if was else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy("job").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("job", "batch")]), "batch").alias("x")).select("job", "x.*")


_RUNS = """r AS (SELECT event_type AS source, ts, event_id, (['success', 'skipped', 'failed'])[user_id % 3 + 1] AS outcome, event_id % 7 AS items, 'e' || event_id AS error FROM events),
    g AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true) AS starts FROM r WINDOW w AS (PARTITION BY source ORDER BY ts)),
    i AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY source ORDER BY ts) AS run FROM g),
    totals AS (SELECT source, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS events, count(*) FILTER (outcome = 'success') AS succeeded, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed,
        sum(items)::BIGINT AS items, arg_max(error, (ts, event_id)) FILTER (outcome = 'failed') AS last_error FROM i GROUP BY source, run)"""


def _run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.get(F.array(F.lit("success"), F.lit("skipped"), F.lit("failed")), (F.col("user_id") % 3).cast("int"))
    return t.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), outcome.alias("outcome"), (F.col("event_id") % 7).alias("items"), F.concat(F.lit("e"), "event_id").alias("error"))


@query("sm8_run_sessions", f"WITH {_RUNS} SELECT * FROM totals")
def run_sessions(spark, sf):
    return l.run_totals(_run_events(spark, sf))


@query("sm8_run_totals_stream", f"WITH {_RUNS} SELECT * FROM totals WHERE ended_at + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)")
def run_totals_stream(spark, sf):
    """Runs that the watermark, an hour behind the newest event, has closed."""
    folder = shared_folder(spark, "runs")

    def run(stream):
        closed = l.run_totals(stream, delay="1 hour").writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        closed.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n:06d}")).start().awaitTermination()

    _fed(spark, _run_events(spark, sf), "at", f"{folder}/in", run)
    return spark.read.parquet(f"{folder}/out").drop("batch")
