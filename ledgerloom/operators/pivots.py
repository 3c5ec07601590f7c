"""Exact nearest vectors that skip blocks by the triangle inequality: vectors lie in shells around pivots, and a shell too far
from a block of queries can hold none of their neighbours.

Angles are a metric on unit vectors.  A block has one pivot and the least and greatest angle to it; a block of queries has
its least and greatest angle to every pivot.  A first pass over each query block's nearest vector blocks bounds the angle
of every query's k-th neighbour; only blocks within that bound are compared after it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.graph import cut
from ledgerloom.sources.folders import ship_package

#: Slack for angles (an arc cosine near 1 is good to 1e-8), and for scores that round alike.
ANGLE_SLACK, TIE = 1e-7, 2e-9
#: The pivot of vectors without a length, which no bound speaks of.
NOWHERE = -1


class Search(NamedTuple):
    """Neighbours (query_id, vec_id, score, rank), and block pairs (seeds, compared after them, all)."""

    neighbours: DataFrame
    pairs: DataFrame


def _units(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(frame["embedding"].tolist(), dtype=np.float64)
    norm = np.linalg.norm(x, axis=1)
    return x / np.maximum(norm, 1e-300)[:, None], norm > 0


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _shells(pivots):
    """(id, embedding) -> (pivot, angle, id, unit) by the nearest pivot."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[frame["embedding"].notna()]
            for at in range(0, len(frame), 1024):
                some = frame.iloc[at : at + 1024]
                units, ok = _units(some)
                angles = _angles(units, pivots.value)
                near = angles.argmin(axis=1)
                yield pd.DataFrame({"pivot": np.where(ok, near, NOWHERE), "angle": np.where(ok, angles[np.arange(len(near)), near], 0.0), "id": some["id"].to_numpy(), "unit": [u.tobytes() for u in units]})

    return run


def _pack(pivots, size: int, one_pivot: bool):
    """Sorted (pivot, angle, id, unit) rows -> blocks with their bounds; a block of vectors has one pivot."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made, held = TaskContext.get().partitionId() << 32, 0, []

        def out(rows: list[tuple]) -> pd.DataFrame:
            pivot = [r[0] for r in rows]
            units = np.frombuffer(b"".join(r[3] for r in rows)).reshape(len(rows), -1)
            base = {"block": [task + made], "pivot": [pivot[0]], "n": [len(rows)], "ids": [np.array([r[2] for r in rows], dtype=np.int64).tobytes()], "units": [units.tobytes()]}
            if one_pivot:
                return pd.DataFrame({**base, "lo": [[min(r[1] for r in rows)]], "hi": [[max(r[1] for r in rows)]]})
            angles = _angles(units, pivots.value)
            # the last place stands for the vectors without a length
            return pd.DataFrame({**base, "lo": [[*angles.min(axis=0), 0.0]], "hi": [[*angles.max(axis=0), 0.0]]})

        for frame in frames:
            for row in zip(frame["pivot"].tolist(), frame["angle"].tolist(), frame["id"].tolist(), frame["unit"]):
                if held and (len(held) == size or (row[0] != held[0][0] and (one_pivot or NOWHERE in (row[0], held[0][0])))):
                    yield out(held)
                    made, held = made + 1, []
                held.append(row)
        if held:
            yield out(held)

    return run


def _best(k: int):
    """Pairs of blocks -> each query's k best of the vector block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                qids, ids = np.frombuffer(r.qids, dtype=np.int64), np.frombuffer(r.ids, dtype=np.int64)
                s = np.frombuffer(r.qunits).reshape(len(qids), -1) @ np.frombuffer(r.units).reshape(len(ids), -1).T
                best = np.lexsort((np.broadcast_to(ids, s.shape), -np.round(s, 9)), axis=1)[:, :k]
                yield pd.DataFrame({"qblock": r.qblock, "query_id": np.repeat(qids, best.shape[1]), "vec_id": ids[best].ravel(), "score": np.take_along_axis(s, best, axis=1).ravel()})

    return run


def pruned_top_k(corpus: DataFrame, queries: DataFrame, k: int, pivots: int = 64, block: int = 1024, query_block: int = 256, seeds: int = 2) -> Search:
    """Each query's k nearest vectors by cosine, exact, as ``vectors.top_k`` gives them.

    ``corpus``: vec_id, embedding; ``queries``: query_id (unique), embedding, a stated set.  Null vectors drop out; those without a
    length score 0.  Pivots are the vectors whose hashed ids are smallest; they and a block's bounds are all that is broadcast or
    collected.  A pivot that most vectors are nearest to is split by angle and id, as blocks are cut by ranges of all three.
    """
    spark = corpus.sparkSession
    ship_package(spark)
    vectors = corpus.select(F.col("vec_id").alias("id"), "embedding").filter("embedding is not null")
    chosen = vectors.filter(F.exists("embedding", lambda v: v != 0)).orderBy(F.xxhash64("id"), "id").limit(pivots).select("embedding").toPandas()
    if not len(chosen):
        chosen = vectors.limit(1).select("embedding").toPandas()
    empty = spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    if not len(chosen):
        return Search(empty, spark.createDataFrame([], "seeds long, compared long, pairs long"))
    centres = spark.sparkContext.broadcast(_units(chosen)[0])
    count = len(chosen)

    def blocks(rows: DataFrame, size: int, one_pivot: bool) -> DataFrame:
        shells = cut(rows.mapInPandas(_shells(centres), "pivot int, angle double, id long, unit binary"))
        ordered = shells.repartitionByRange("pivot", "angle", "id").sortWithinPartitions("pivot", "angle", "id")
        return cut(ordered.mapInPandas(_pack(centres, size, one_pivot), "block long, pivot int, n int, ids binary, units binary, lo array<double>, hi array<double>"))

    found = blocks(vectors, block, True)
    asked = blocks(queries.select(F.col("query_id").alias("id"), "embedding").filter("embedding is not null"), query_block, False)
    shells = found.select("block", F.when(F.col("pivot") == NOWHERE, count).otherwise(F.col("pivot")).alias("p"), "n", F.col("lo")[0].alias("lo"), F.col("hi")[0].alias("hi"))
    spread = asked.select(F.col("block").alias("qblock"), F.posexplode(F.arrays_zip(F.col("lo").alias("qlo"), F.col("hi").alias("qhi"))).alias("p", "x"))
    far = F.greatest(F.lit(0.0), F.col("lo") - F.col("x.qhi"), F.col("x.qlo") - F.col("hi"))
    met = spread.join(shells, "p").select("qblock", "block", "n", far.alias("far"))
    met = met.withColumn("place", F.row_number().over(Window.partitionBy("qblock").orderBy("far", F.desc("n"), "block")))
    met = cut(met)

    packed = asked.select(F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("units").alias("qunits"))

    def compared(pairs: DataFrame) -> DataFrame:
        both = pairs.select("qblock", "block").join(found.select("block", "ids", "units"), "block").join(packed, "qblock")
        return both.select("qblock", "qids", "qunits", "ids", "units").mapInPandas(_best(k), "qblock long, query_id long, vec_id long, score double")

    def ranked(rows: DataFrame) -> DataFrame:
        rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id"))
        return rows.withColumn("rank", rn).filter(F.col("rank") <= k)

    first = cut(ranked(compared(met.filter(F.col("place") <= seeds))).drop("rank"))
    kth = first.groupBy("qblock", "query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"), F.max(F.abs("score")).alias("most"))
    # a query with fewer than k so far, or without a length, may have neighbours anywhere
    bound = F.when((F.col("n") < k) | (F.col("most") == 0), math.pi).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score")) - TIE)))
    reach = kth.groupBy("qblock").agg((F.max(bound) + ANGLE_SLACK).alias("reach"))
    near = cut(met.filter(F.col("place") > seeds).join(reach, "qblock").filter("far <= reach"))
    out = ranked(first.unionByName(compared(near))).select("query_id", "vec_id", "score", "rank")
    report = met.agg(F.count_if(F.col("place") <= seeds).alias("seeds"), F.count(F.lit(1)).alias("pairs")).crossJoin(F.broadcast(near.agg(F.count(F.lit(1)).alias("compared"))))
    return Search(out, report.select("seeds", "compared", "pairs"))
