"""Operations: readiness, alerts, job ledgers and backoff, as whole-table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.folds import sorted_fold


def newest_and_success(runs: DataFrame) -> DataFrame:
    """Each task's newest run with the time of its last success, in one aggregation."""
    return runs.groupBy("task").agg(F.max(F.struct("started_at", "run_id", "status", "records")).alias("x"), F.max(F.when(F.col("status") == "success", F.col("started_at"))).alias("last_success")).select("task", "x.run_id", "x.status", "x.started_at", "x.records", "last_success")


def freshness(sources: DataFrame, lag: Column, limit: Column) -> DataFrame:
    """fresh, stale or missing by lag; a failed sync makes fresh stale, and stale or missing failed."""
    base = F.when(F.col("last_success").isNull(), "missing").when(lag <= limit, "fresh").otherwise("stale")
    state = F.when(F.col("status") == "failed", F.when(base == "fresh", "stale").otherwise("failed")).otherwise(base)
    return sources.select("task", "last_success", lag.alias("lag"), state.alias("state"))


def overall(states: DataFrame) -> DataFrame:
    """One row: fresh if all are, unavailable if none is, else degraded."""
    out = states.agg(F.count_if(F.col("state") == "fresh").alias("fresh"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("overall", F.when(F.col("fresh") == F.col("total"), "fresh").when(F.col("fresh") == 0, "unavailable").otherwise("degraded"))


def alerts(runs: DataFrame, streak: int = 3, rate: float = 0.5, drop: float = 0.8) -> DataFrame:
    """(task, alert): failures in a row at the end, failure rate, and a drop of records against the success before.

    Runs are summed by island (a success and the failures after it) before they are summed by task, so nothing is a list.
    """
    order = Window.partitionBy("task").orderBy("started_at", "run_id")
    ok = Window.partitionBy("task", "status").orderBy("started_at", "run_id")
    marked = runs.withColumn("island", F.sum(F.when(F.col("status") != "failed", 1).otherwise(0)).over(order)).withColumn("before", F.when(F.col("status") == "success", F.lag("records").over(ok)))
    islands = marked.groupBy("task", "island").agg(F.max(F.struct("started_at", "run_id", "status", "records", "before")).alias("x"), F.count_if(F.col("status") == "failed").alias("failed"), F.count(F.lit(1)).alias("n"))
    per = islands.groupBy("task").agg(F.max(F.struct("island", "x", "failed")).alias("last"), (F.sum("failed") / F.sum("n")).alias("rate")).select("task", "rate", "last.x", F.col("last.failed").alias("tail"))
    found = F.array_compact(
        F.array(
            F.when(F.col("tail") >= streak, "consecutive_failures"),
            F.when(F.col("rate") >= rate, "failure_rate"),
            F.when((F.col("x.status") == "success") & (F.col("x.before") > 0) & (F.col("x.records") < F.col("x.before") * (1 - drop)), "record_drop"),
        )
    )
    return per.select("task", F.explode(found).alias("alert"))


def backoff_minutes(error: Column, attempts: Column) -> Column:
    """Minutes to wait: a day for quota errors, none (dead) for fatal ones, 120 for auth, and doubling up to a limit else."""
    return (
        F.when(error == "quota", 1440.0).when(error == "fatal", F.lit(None).cast("double")).when(error == "auth", 120.0)
        .when(error == "network", F.least(F.lit(120.0), 5 * F.pow(F.lit(2.0), attempts - 1))).otherwise(F.least(F.lit(60.0), F.pow(F.lit(2.0), attempts - 1)))
    )


def fold_jobs(events: DataFrame, retries: int = 3) -> DataFrame:
    """Last state of each job (job, seq, event): a failure goes back to pending until ``retries``, then it is failed."""

    def step(state: tuple, x: dict) -> tuple:
        status, fails = state
        if status in ("done", "failed"):
            return state
        if x["event"] == "fail":
            return ("failed" if fails + 1 >= retries else "pending"), fails + 1
        return ("done" if x["event"] == "done" else "running"), fails

    kind = events.schema["job"].dataType.simpleString()
    return sorted_fold(events, "job", ["seq", "event"], f"job {kind}, state string, fails int", lambda: ("pending", 0), step, lambda s: s)


def checkpoints(runs: DataFrame) -> DataFrame:
    """Watermark of each task: moved by successes only; attempts by any run."""
    return runs.groupBy("task").agg(F.max(F.when(F.col("status") == "success", F.col("started_at"))).alias("watermark"), F.max("started_at").alias("last_attempt"), F.count(F.lit(1)).alias("attempts"))


def log_stats(logs: DataFrame, level: str, service: str) -> DataFrame:
    """Counts by level, by service and in all, in one pass of grouping sets."""
    grouped = logs.groupingSets([[level], [service], []], level, service).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("errors"))
    return grouped.select(F.col(level).alias("level"), F.col(service).alias("service"), "n", "errors")
