"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crc_bucket(id_col: str, buckets: int):
    """crc32 of the id as text, modulo ``buckets``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(buckets)).cast("int")


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, held_out: tuple[int, int], bound: int) -> DataFrame:
    """(text, y) of labelled ids outside the held-out fold: all of them, or about ``bound`` chosen by a hash of the id.

    ``held_out``: (modulus, remainder) of the crc32 of the id as text.  Only ids and labels of the sample are
    broadcast, so their number is bounded, and only the sample's texts are shuffled.  An id counts once however often
    it is repeated: with its largest label, and the largest of its texts.
    """
    modulus, remainder = held_out
    usable = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (crc_bucket("doc_id", modulus) != remainder)).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = usable.count()
    share = min(1.0, 0.95 * bound / max(1, n))
    if share < 1:
        usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < int(share * (1 << 24)))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(usable), "doc_id")
    return found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y")).select("text", "y")
