"""Keyed merges of an incoming batch into a table, with a policy for each column.

A merge is one shuffle by key of the union of both sides and one aggregation, so map-side combine applies and no side
need fit in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What becomes of a column when both sides have the key.
POLICIES = ("take_new", "keep_old", "coalesce_new", "coalesce_old", "greatest", "least")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the first in ``order``."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], policies: dict[str, str] | None = None, default: str = "take_new") -> DataFrame:
    """``target`` after ``incoming``: at most one row of each key on either side; other keys stay or come in."""
    policies = policies or {}
    if unknown := ({*policies.values(), default}) - set(POLICIES):
        raise ValueError(f"unknown policies {sorted(unknown)}")
    rest = [c for c in target.columns if c not in keys]
    sided = target.select(*keys, F.struct(*rest).alias("old"), F.lit(None).cast(target.select(F.struct(*rest)).schema[0].dataType).alias("new")).unionByName(
        incoming.select(*keys, F.lit(None).cast(target.select(F.struct(*rest)).schema[0].dataType).alias("old"), F.struct(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in rest]).alias("new"))
    )
    merged = sided.groupBy(*keys).agg(F.max("old").alias("old"), F.max("new").alias("new"))

    def chosen(c: str):
        old, new, p = F.col(f"old.{c}"), F.col(f"new.{c}"), policies.get(c, default)
        both = {"take_new": new, "keep_old": old, "coalesce_new": F.coalesce(new, old), "coalesce_old": F.coalesce(old, new), "greatest": F.greatest(old, new), "least": F.least(old, new)}[p]
        return F.when(F.col("old").isNull(), new).when(F.col("new").isNull(), old).otherwise(both).alias(c)

    return merged.select(*keys, *[chosen(c) for c in rest])


def insert_absent(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key the target lacks; what an insert that ignores conflicts would add."""
    return incoming.join(target.select(*keys), keys, "left_anti")


def first_non_empty_source(sources: DataFrame, key: str, priority: str) -> DataFrame:
    """Rows of each key's best source only, and whether that wasn't the first choice."""
    best = F.min(priority).over(Window.partitionBy(key))
    marked = sources.withColumn("_best", best)
    return marked.filter(F.col(priority) == F.col("_best")).withColumn("fallback_used", F.col(priority) > 1).drop("_best")


def missing_from(universe: DataFrame, have: DataFrame, key: str, date: str, as_of, back_days: int) -> DataFrame:
    """What to fetch for each key: from the day after its newest date, or ``back_days`` back; keys up to date drop out."""
    newest = have.groupBy(key).agg(F.max(date).alias("newest"))
    start = F.coalesce(F.date_add("newest", 1), F.date_sub(as_of, back_days))
    return universe.join(newest, key, "left").select(key, start.alias("start"), F.lit(as_of).alias("stop")).filter(F.col("start") <= F.col("stop"))


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc, idx, change) of chunks that changed, were added or went, by their hashes."""
    both = old.select("doc", "idx", F.col("hash").alias("was")).join(new.select("doc", "idx", F.col("hash").alias("now")), ["doc", "idx"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("doc", "idx", change.alias("change")).filter("change is not null")


def extract_again(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(doc, action): whether a document is to be extracted, by its last status and hash."""
    s = F.col("status")
    action = F.when(s.isNull(), "new").when(s == "running", "skip").when(s.isin("failed", "skipped"), "retry").when(F.col("done_hash") == F.col("hash"), "skip").otherwise("changed")
    return docs.join(ledger.select("doc", "status", F.col("hash").alias("done_hash")), "doc", "left").select("doc", action.alias("action"))


def retention(df: DataFrame, date: str, as_of, keep_days: dict[str, int], kind: str) -> DataFrame:
    """Rows younger than their kind's days; kinds without a limit stay."""
    limit = F.lit(None).cast("int")
    for k, d in sorted(keep_days.items()):
        limit = F.when(F.col(kind) == k, d).otherwise(limit)
    return df.filter(limit.isNull() | (F.datediff(as_of, F.col(date)) <= limit))


def affected(touched: DataFrame, edges: DataFrame) -> DataFrame:
    """Summary keys that go stale: of touched entities and of both ends of edges that touch them.

    A company makes its own level 1 stale and levels 2 and 3 of what it is linked with; a product its levels 2 and 3.
    """
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
    near = ends.join(touched.select("id").distinct(), "id").select(F.col("other").alias("id"))
    every = touched.select("id").union(near).distinct()
    levels = F.when(F.col("id").startswith("C:"), F.array(F.lit(1))).otherwise(F.array(F.lit(2), F.lit(3)))
    return every.select("id", F.explode(levels).alias("level")).select("id", "level", F.concat(F.lit("summary:L"), F.col("level"), F.lit(":"), F.col("id")).alias("summary_key"))
