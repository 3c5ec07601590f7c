"""Folds over a key's rows in order, without ever holding them: rows are sorted by key and order and read as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ledgerloom.sources.folders import ship_package


def sorted_fold(rows: DataFrame, key: str, order: list[str], schema: str, begin: Callable[[], Any], step: Callable[[Any, dict], Any], finish: Callable[[Any], tuple]) -> DataFrame:
    """One row of ``schema`` (the key first) for each key: ``finish`` of the state that ``step`` made of its rows in ``order``.

    A worker holds one state and one Arrow batch, however many rows a key has; the sort spills.
    """
    ship_package(rows.sparkSession)
    names = [f.name for f in _parse_datatype_string(schema).fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state, open_ = None, None, False
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                here = row[key]
                if open_ and not (here == name or (here != here and name != name)):
                    out.append((name, *finish(state)))
                    open_ = False
                if not open_:
                    name, state, open_ = here, begin(), True
                state = step(state, row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if open_:
            yield pd.DataFrame([(name, *finish(state))], columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def lag_in_blocks(rows: DataFrame, key: str, order: str, value: str, name: str, block: int = 1 << 16) -> DataFrame:
    """``rows`` with the ``value`` of the row before in ``order`` (a whole number, one row each) within ``key``, as ``name``.

    For keys of few values, each with a great part of all rows: windows are cut at every ``block`` of the order, and a
    block's first row takes the last value of the key's block before it, from a table of one row a block and key.  The
    first row of a key has null; values themselves should not be null, and neither should the order.
    """
    rows = rows.withColumn("_block", F.floor(F.col(order) / block))
    ends = rows.groupBy(key, "_block").agg(F.max_by(value, order).alias("_end"))
    before = F.lag("_end").over(Window.partitionBy(key).orderBy("_block"))
    ends = ends.select(F.col(key).alias("_key"), F.col("_block").alias("_at"), before.alias("_carried"))
    here = Window.partitionBy(key, "_block").orderBy(order)
    inside = rows.withColumn("_inside", F.lag(value).over(here))
    found = inside.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at")))
    return found.withColumn(name, F.coalesce("_inside", "_carried")).drop("_block", "_key", "_at", "_carried", "_inside")
