"""Exact dedup: two passes with a Bloom filter; only rows that may be copies are shuffled.

Pass 1: each task sets two bits for each text's hash, and notes the bits that it sets a second time.  Tasks hand on
compressed bitmaps (about three bytes a row, whatever the texts), which are merged bucket by bucket: a bit counts as
repeated if a task hit it twice or two tasks hit it once.  Pass 2 broadcasts the repeated bits: a row whose two bits are
not both among them is the only one with its text and passes straight through; the others are grouped by their
SHA-256.  The filter grows with the number of rows up to MOST_BITMAPS (32 MB); beyond that more and more rows go
through the shuffle, of digests and ids only, and the result stays exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BITS, Scratch, in_bitmaps, ship_package

#: Bits of the filter for each row, and bitmaps of BITS bits at least and at most (powers of two).
BITS_A_ROW, LEAST_BITMAPS, MOST_BITMAPS = 32, 8, 8_192
SIZE = BITS // 8


def filter_buckets(rows: int) -> int:
    return min(MOST_BITMAPS, max(LEAST_BITMAPS, 1 << max(0, rows * BITS_A_ROW // BITS - 1).bit_length()))


def places(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The two bits of each key, as places in the whole filter; one where both are the same."""
    a, b = (keys >> 12) & (BITS - 1), (keys >> 33) & (BITS - 1)
    start = (keys & (buckets - 1)) * BITS
    return np.concatenate([start + a, (start + b)[a != b]])


def hit(once: np.ndarray, twice: np.ndarray, bits: np.ndarray) -> None:
    """Set ``bits`` in the bitmap ``once``, and in ``twice`` those that were set or come more than once."""
    bits, counts = np.unique(bits, return_counts=True)
    byte, mask = bits >> 3, np.left_shift(1, bits & 7).astype(np.uint8)
    again = (counts > 1) | (once[byte] & mask > 0)
    np.bitwise_or.at(twice, byte[again], mask[again])
    np.bitwise_or.at(once, byte, mask)


def _task_bitmaps(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(buckets * SIZE, dtype=np.uint8), np.zeros(buckets * SIZE, dtype=np.uint8)
        for batch in batches:
            hit(once, twice, places(batch.column(0).to_numpy(zero_copy_only=False), buckets))
        used = np.flatnonzero(once.reshape(buckets, SIZE).any(axis=1))
        for at in range(0, len(used), 1024):
            some = used[at : at + 1024]
            packed = [[zlib.compress(x[k * SIZE : (k + 1) * SIZE].tobytes(), 1) for k in some] for x in (once, twice)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary())], ["bucket", "once", "twice"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> the bits of each bucket that are hit twice."""
    now, once, twice = None, None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([twice.tobytes()], pa.binary())], ["bucket", "bits"])

    for batch in batches:
        for bucket, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now:
                if now is not None and twice.any():
                    yield out()
                now, once, twice = bucket, np.zeros(SIZE, dtype=np.uint8), np.zeros(SIZE, dtype=np.uint8)
            a, b = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in (a, b))
            twice |= b | (once & a)
            once |= a
    if now is not None and twice.any():
        yield out()


def repeated_bits(keys: DataFrame, buckets: int) -> DataFrame:
    """(bucket, bits): of the filter of all 64-bit keys, the bits that two rows or more hit."""
    parts = keys.mapInArrow(_task_bitmaps(buckets), "bucket long, once binary, twice binary")
    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merge, "bucket long, bits binary")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty.  The row with the largest id stays; of rows that
    repeat that id with the same text, one does.  A null id never stays beside one that is not null.  An empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "exact-dedup")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.cut(rows, "rows")
    key, buckets = F.xxhash64("text_sha256"), filter_buckets(rows.count())
    bits = scratch.cut(repeated_bits(rows.select(key.alias("key")), buckets), "bits")
    marked = in_bitmaps(rows, key, bits, "may_repeat", buckets)
    alone = marked.filter(~F.col("may_repeat")).select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    maybe = scratch.cut(marked.filter("may_repeat").select("doc_id", "text_sha256", "row"), "maybe")
    # both sides of this join are written tables: a text that a third of all rows share is split by adaptive execution
    groups = maybe.groupBy("text_sha256").agg(F.max(F.struct("doc_id", (-F.col("row")).alias("row"))).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = scratch.cut(groups.select("text_sha256", F.col("keep.doc_id").alias("keep_id"), (-F.col("keep.row")).alias("keep_row"), "group_size"), "groups")
    found = maybe.join(groups, "text_sha256").select("doc_id", "text_sha256", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))
    return alone.unionByName(found).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
