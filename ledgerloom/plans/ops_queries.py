"""Registered queries over task runs, jobs, logs and counters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import ops as o
from ledgerloom.operators import upsert as u
from ledgerloom.plans.bindings import RUNS, with_
from ledgerloom.sources import tables as t

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


_NEWEST = f"""{with_(RUNS)}, newest AS (SELECT task, run_id, status, started_at, records, max(started_at) FILTER (status = 'success') OVER (PARTITION BY task) AS last_success FROM runs
    QUALIFY row_number() OVER (PARTITION BY task ORDER BY started_at DESC, run_id DESC) = 1), z AS (SELECT max(started_at)::DATE AS today FROM runs)"""


@query("wn11_newest_and_success", f"{_NEWEST} SELECT * FROM newest")
def newest(spark, sf):
    return o.newest_and_success(t.runs(spark, sf))


@query("rd1_latest_dates", """SELECT 'orders' AS source, max(o_orderdate)::DATE AS latest FROM orders UNION ALL SELECT 'lineitem', max(l_shipdate)::DATE FROM lineitem UNION ALL SELECT 'events', max(ts + INTERVAL 8 HOUR)::DATE FROM events""")
def latest_dates(spark, sf):
    def one(name, at):
        return t.table(spark, sf, name).agg(F.to_date(F.max(at)).alias("latest")).select(F.lit(name).alias("source"), "latest")

    return one("orders", F.col("o_orderdate")).unionByName(one("lineitem", F.col("l_shipdate"))).unionByName(one("events", F.col("ts") + F.expr("INTERVAL 8 HOURS")))


_STATES = f"""{_NEWEST}, s AS (SELECT task, last_success, date_diff('day', last_success::DATE, today) AS lag, CASE WHEN last_success IS NULL THEN 'missing' WHEN date_diff('day', last_success::DATE, today) <= 1 + task % 3 THEN 'fresh' ELSE 'stale' END AS base, status FROM newest, z),
    states AS (SELECT task, last_success, lag, CASE WHEN status = 'failed' THEN CASE WHEN base = 'fresh' THEN 'stale' ELSE 'failed' END ELSE base END AS state FROM s)"""


def _states(spark, sf):
    runs = t.runs(spark, sf)
    today = F.broadcast(runs.agg(F.to_date(F.max("started_at")).alias("today")))
    return o.freshness(o.newest_and_success(runs).crossJoin(today), F.datediff("today", F.to_date("last_success")), 1 + F.col("task") % 3)


@query("rd4_freshness", f"{_STATES} SELECT * FROM states")
def freshness(spark, sf):
    return _states(spark, sf)


@query("rd4_overall", f"{_STATES} SELECT count(*) FILTER (state = 'fresh') AS fresh, count(*) AS total, CASE WHEN count(*) FILTER (state = 'fresh') = count(*) THEN 'fresh' WHEN count(*) FILTER (state = 'fresh') = 0 THEN 'unavailable' ELSE 'degraded' END AS overall FROM states")
def overall(spark, sf):
    return o.overall(_states(spark, sf))


@query("rd5_alerts", f"""{with_(RUNS)}, i AS (SELECT *, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY started_at, run_id) AS island, CASE WHEN status = 'success' THEN lag(records) OVER (PARTITION BY task, status ORDER BY started_at, run_id) END AS before FROM runs),
    l AS (SELECT task, island, status, records, before FROM i QUALIFY row_number() OVER (PARTITION BY task ORDER BY started_at DESC, run_id DESC) = 1),
    a AS (SELECT l.task, (SELECT count(*) FROM i WHERE i.task = l.task AND i.island = l.island AND i.status = 'failed') AS tail, (SELECT avg(CASE WHEN status = 'failed' THEN 1.0 ELSE 0.0 END) FROM i WHERE i.task = l.task) AS rate, status, records, before FROM l)
    SELECT task, 'consecutive_failures' AS alert FROM a WHERE tail >= 2 UNION ALL SELECT task, 'failure_rate' FROM a WHERE rate >= 0.22 UNION ALL SELECT task, 'record_drop' FROM a WHERE status = 'success' AND before > 0 AND records < before * (1 - 0.8::DOUBLE)""")
def alerts(spark, sf):
    return o.alerts(t.runs(spark, sf), streak=2, rate=0.22)


@query("ag4_log_stats", f"{with_(RUNS)} SELECT kind AS level, task % 5 AS service, count(*) AS n, count(*) FILTER (status = 'failed') AS errors FROM runs GROUP BY GROUPING SETS ((kind), (task % 5), ())")
def log_stats(spark, sf):
    return o.log_stats(t.runs(spark, sf).withColumn("shard", F.col("task") % 5), "kind", "shard")


@query("ag5_job_counts", f"{with_(RUNS)} SELECT kind, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'success') AS success FROM runs GROUP BY 1")
def job_counts(spark, sf):
    return t.runs(spark, sf).groupBy("kind").agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "success").alias("success"))


@query("ag6_week_summary", f"{with_(RUNS)} SELECT task, count(*) AS runs, arg_max(status, (started_at, run_id)) AS last_status FROM runs WHERE started_at > (SELECT max(started_at) FROM runs) - INTERVAL 7 DAY GROUP BY 1")
def week(spark, sf):
    runs = t.runs(spark, sf)
    end = F.broadcast(runs.agg(F.max("started_at").alias("z")))
    recent = runs.join(end).filter(F.col("started_at") > F.col("z") - F.expr("INTERVAL 7 DAYS"))
    return recent.groupBy("task").agg(F.count(F.lit(1)).alias("runs"), F.max_by("status", F.struct("started_at", "run_id")).alias("last_status"))


@query("ag15_data_status", "SELECT count(DISTINCT l_suppkey) AS stocks, max(l_shipdate)::DATE AS latest, min(l_shipdate)::DATE AS earliest, count(*) AS trades FROM lineitem")
def data_status(spark, sf):
    return t.table(spark, sf, "lineitem").agg(F.countDistinct("l_suppkey").alias("stocks"), F.to_date(F.max("l_shipdate")).alias("latest"), F.to_date(F.min("l_shipdate")).alias("earliest"), F.count(F.lit(1)).alias("trades"))


@query("ag16_usage_by_day", "SELECT ts::DATE AS day, user_id % 20 AS thread, count(*) AS calls, count(DISTINCT event_type) AS tools FROM events GROUP BY 1, 2")
def usage(spark, sf):
    return t.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), (F.col("user_id") % 20).alias("thread")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("event_type").alias("tools"))


@query("ag17_tier_fusion", """SELECT user_id, least(4, max(event_id % 5) + 0)::BIGINT AS tier, CASE WHEN count(*) FILTER (event_type = 'error') >= 3 THEN 4 ELSE least(4, max(event_id % 5) + count(*) FILTER (event_type = 'error')) END::BIGINT AS after_conflicts FROM events GROUP BY 1""")
def tiers(spark, sf):
    conflicts = F.count_if(F.col("event_type") == "error")
    worst = F.max(F.col("event_id") % 5)  # pessimistic: the least trusted of the sources
    return t.table(spark, sf, "events").groupBy("user_id").agg(F.least(F.lit(4), worst).cast("long").alias("tier"), F.when(conflicts >= 3, 4).otherwise(F.least(F.lit(4), worst + conflicts)).cast("long").alias("after_conflicts"))


@query("sm3_job_ledger", """WITH RECURSIVE e AS (SELECT l_orderkey AS job, CASE WHEN l_returnflag = 'R' THEN 'fail' WHEN l_returnflag = 'A' AND l_linenumber > 3 THEN 'done' ELSE 'start' END AS event, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS k FROM lineitem),
    f AS (SELECT DISTINCT job, 0::BIGINT AS k, 'pending' AS state, 0 AS fails FROM e UNION ALL SELECT f.job, e.k, CASE WHEN f.state IN ('done', 'failed') THEN f.state WHEN e.event = 'done' THEN 'done' WHEN e.event = 'fail' THEN CASE WHEN f.fails + 1 >= 3 THEN 'failed' ELSE 'pending' END ELSE 'running' END,
          CASE WHEN f.state IN ('done', 'failed') OR e.event <> 'fail' THEN f.fails ELSE f.fails + 1 END FROM f JOIN e ON f.job = e.job AND e.k = f.k + 1)
    SELECT job, arg_max(state, k) AS state, arg_max(fails, k) AS fails FROM f GROUP BY job""")
def job_ledger(spark, sf):
    kind = F.when(F.col("l_returnflag") == "R", "fail").when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") > 3), "done").otherwise("start")
    events = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job"), F.struct("l_linenumber", "l_returnflag").alias("seq"), kind.alias("event"))
    return o.fold_jobs(events)


@query("sm4_backoff", """SELECT event_id, CASE event_type WHEN 'view' THEN 'quota' WHEN 'error' THEN 'fatal' WHEN 'click' THEN 'auth' WHEN 'purchase' THEN 'network' ELSE 'other' END AS error,
    CASE event_type WHEN 'view' THEN 1440.0 WHEN 'error' THEN NULL WHEN 'click' THEN 120.0 WHEN 'purchase' THEN least(120.0, 5 * pow(2.0, event_id % 8)) ELSE least(60.0, pow(2.0, event_id % 8)) END::DOUBLE AS minutes FROM events""")
def backoff(spark, sf):
    kind = F.col("event_type")
    error = F.when(kind == "view", "quota").when(kind == "error", "fatal").when(kind == "click", "auth").when(kind == "purchase", "network").otherwise("other")
    return t.table(spark, sf, "events").select("event_id", error.alias("error"), o.backoff_minutes(error, F.col("event_id") % 8 + 1).alias("minutes"))


@query("sm5_enqueue_policy", """WITH a AS (SELECT o_orderkey AS job, o_custkey % 9 AS priority, 1 AS attempts FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS job, o_custkey % 5 AS priority, 2 AS attempts FROM orders WHERE o_orderkey % 2 = 0)
    SELECT coalesce(a.job, b.job) AS job, least(a.priority, b.priority) AS priority, greatest(a.attempts, b.attempts) AS attempts FROM a FULL JOIN b ON a.job = b.job""")
def enqueue(spark, sf):
    x = t.table(spark, sf, "orders")
    a = x.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("job"), (F.col("o_custkey") % 9).alias("priority"), F.lit(1).alias("attempts"))
    b = x.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("job"), (F.col("o_custkey") % 5).alias("priority"), F.lit(2).alias("attempts"))
    return u.upsert(a, b, ["job"], {"priority": "least", "attempts": "greatest"})


@query("sm6_claim_order", "SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderstatus <> 'F' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 50")
def claim(spark, sf):
    due = t.table(spark, sf, "orders").filter((F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp")) & (F.col("o_orderstatus") != "F"))
    return due.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority", "o_orderdate")


@query("sm7_checkpoints", f"{with_(RUNS)} SELECT task, max(started_at) FILTER (status = 'success') AS watermark, max(started_at) AS last_attempt, count(*) AS attempts FROM runs GROUP BY 1")
def checkpoints(spark, sf):
    return o.checkpoints(t.runs(spark, sf))


@query("sm8_run_totals", f"{with_(RUNS)} SELECT date_trunc('hour', started_at) AS hour, kind, count(*) AS events, count(*) FILTER (status = 'failed') AS failed FROM runs GROUP BY 1, 2")
def totals(spark, sf):
    return t.runs(spark, sf).groupBy(F.date_trunc("hour", "started_at").alias("hour"), "kind").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("status") == "failed").alias("failed"))


@query("flt5_open_signals", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('purchase', 'click') AND value > 50 AND json_extract(props, '$.k') IS NOT NULL")
def open_signals(spark, sf):
    k = F.get_json_object("props", "$.k")
    return t.table(spark, sf, "events").filter(F.col("event_type").isin("purchase", "click") & (F.col("value") > 50) & k.isNotNull()).select("event_id", "event_type", "value")
