"""Exact vector search and rank fusion over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double precision; null where either has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def _blocks(size: int):
    """Rows (id, embedding) -> blocks of at most ``size`` unit vectors, packed; null vectors drop out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["embedding"].notna()]
            for at in range(0, len(batch), size):
                x = np.array(batch["embedding"].iloc[at : at + size].tolist(), dtype=np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                yield pd.DataFrame({"ids": [batch["id"].iloc[at : at + size].to_numpy(dtype=np.int64).tobytes()], "units": [x.tobytes()]})

    return run


def top_k(corpus: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, vec_id, score, rank): each query's k nearest vectors by cosine, exact.

    ``queries`` is a stated set.  Both sides are packed in blocks, and each pair of blocks is one matrix product that
    keeps its own k best of each query, so no vector passes the driver and what is shuffled is bounded by blocks x
    queries x k; a window takes the best of those.
    """
    packed = "ids binary, units binary"
    q = queries.select(F.col("query_id").alias("id"), "embedding").mapInPandas(_blocks(block), packed)
    c = corpus.select(F.col("vec_id").alias("id"), "embedding").mapInPandas(_blocks(block), packed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                qids, ids = np.frombuffer(r.qids, dtype=np.int64), np.frombuffer(r.ids, dtype=np.int64)
                s = np.frombuffer(r.qunits).reshape(len(qids), -1) @ np.frombuffer(r.units).reshape(len(ids), -1).T
                best = np.lexsort((np.broadcast_to(ids, s.shape), -np.round(s, 9)), axis=1)[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(qids, best.shape[1]), "vec_id": ids[best].ravel(), "score": np.take_along_axis(s, best, axis=1).ravel()})

    pairs = c.crossJoin(q.select(F.col("ids").alias("qids"), F.col("units").alias("qunits")))
    near = pairs.mapInPandas(run, "query_id long, vec_id long, score double")
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id"))
    return near.withColumn("rank", rn).filter(F.col("rank") <= k)


def rank_fusion(ranked: DataFrame, top: int, constant: int = 60) -> DataFrame:
    """(query_id, vec_id, fused): sum over lists of 1 / (constant + rank), and the best ``top`` of each query."""
    fused = ranked.groupBy("query_id", "vec_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("fused"), F.count(F.lit(1)).alias("lists"))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "vec_id"))
    return fused.withColumn("rn", rn).filter(F.col("rn") <= top).drop("rn")


def placeholder_embedding(text: Column, width: int = 64) -> Column:
    """A unit vector from the SHA-256 of a text: its bytes, zero-padded."""
    h = F.sha2(F.coalesce(text, F.lit("")), 256)
    raw = F.transform(F.sequence(F.lit(1), F.lit(min(32, width))), lambda i: F.conv(F.substring(h, i * 2 - 1, F.lit(2)), 16, 10).cast("double"))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, v: s + v * v))
    return F.concat(F.transform(raw, lambda v: v / norm), F.array_repeat(F.lit(0.0), max(0, width - 32)))
