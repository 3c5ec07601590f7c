"""Evidence into signals and their propagation along paths: one micro-batch writes both tables, exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import rule_signals as op
from ledgerloom.operators.store import BUCKETS, TableSet
from ledgerloom.operators.upsert import keep_first

# Columns that a later row of the same signal or propagation refreshes; the others stay as first written.
REFRESHED = {
    "signals": ("detected_at", "freshness", "value", "summary", "excerpt"),
    "propagations": ("confidence", "reasoning"),
}
STREAM = "evidence"


def propagation_id(*parts: Column) -> Column:
    return F.concat(F.lit("PROP:"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20))


def signals_and_propagations(payloads: DataFrame, subject: Column, paths: DataFrame, detected_at: Column, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The two tables' rows of some evidence: rule signals, and one propagation for each path of a signal's subject.

    With ``tasks`` both come dealt over so many, signals by id and propagations by subject.
    """
    found = op.rule_signals(payloads).withColumn("subject", subject).withColumn("detected_at", detected_at)
    found = keep_first(found.repartition(tasks, "signal_id") if tasks else found, ["signal_id"], ["source_type", "source_id"])
    spread = op.path_propagation(found.select("signal_id", "subject", "kind", "polarity", "strength", "confidence"), paths, ("subject",), tasks)
    spread = spread.withColumn("reasoning", F.concat_ws(": ", "secondary_type", "relation_path")).withColumn("propagation_id", propagation_id(F.col("signal_id"), F.col("target"), F.col("relation_path")))
    return found, spread


def evidence_sink(store: TableSet, subject: Column, paths: DataFrame, detected_at: Column, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: both tables of a batch come in by one commit that also notes the batch.

    ``paths`` is a written table (subject, nodes, rels, weights) that every batch reads.  Propagations are kept in buckets of their
    subject, which their id stands for, so they are written where they are made.
    """

    def write(batch: DataFrame, n: int) -> None:
        found, spread = signals_and_propagations(batch, subject, paths, detected_at, buckets)
        refreshed = {name: dict.fromkeys(columns, "take_new") for name, columns in REFRESHED.items()}
        merges = {"signals": (found, ["signal_id"], refreshed["signals"], "keep_old", ["signal_id"]), "propagations": (spread, ["propagation_id"], refreshed["propagations"], "keep_old", ["subject"])}
        store.merge(merges, STREAM, n, buckets)

    return write
