"""Target-distribution importance resampling over hashed n-grams, with a seeded draw without replacement.

Texts stay bytes: a table of 256 bytes lower-cases A-Z and blanks every separator, ``bytes.split`` yields the words,
and the CRC of a longer n-gram goes on from the CRC of the shorter one.  Pass 1 counts the buckets of all documents and
of the target; a bucket's gain is the logarithm of the two smoothed shares.  Pass 2 adds up gains and noise for each
document.  The highest scores are ranked by ranges of scores: the only thing that passes the driver is one count for each
bucket and one for each range.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, ship_package

#: Byte -> itself, a lower-case letter or a blank: words are runs of ASCII letters, digits and bytes above 127.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Bytes of a text that are split at a time; a slice ends at a separator.
SLICE = 1 << 20


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a slice at a time, so that a very long text is never a list of all its words."""
    at = 0
    while at < len(data):
        end = at + SLICE
        piece = data[at:end].translate(WORD_BYTES)
        while end < len(data) and piece[-1] != 32:
            more = data[end : end + SLICE].translate(WORD_BYTES)
            cut = more.find(b" ") + 1 or len(more)
            piece, end = piece + more[:cut], end + cut
        yield piece.split()
        at = end


def features(data: bytes | None, n: int) -> Iterator[tuple[Counter, int]]:
    """For each slice of a text: CRC -> count of the runs of 1 to ``n`` words that end in it, and its words."""
    tail: list[bytes] = []
    for words in words_of(data or b""):
        found, seq = Counter(map(crc32, words)), [*tail, *words]
        runs = list(map(crc32, seq)) if n > 1 else []
        for k in range(2, n + 1):
            runs = [crc32(b" " + w, seed) for seed, w in zip(runs, seq[k - 1 :])]
            found.update(runs[max(0, len(tail) - k + 1) :])
        tail = seq[max(0, len(seq) - n + 1) :] if n > 1 else []
        yield found, len(words)


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> dict[int, int]:
    """bucket -> features of all rows of a one-column table; a task hands on one row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                for found, _ in features(text.as_py(), n):
                    at = np.fromiter(found.keys(), dtype=np.int64, count=len(found)) % buckets
                    np.add.at(total, at, np.fromiter(found.values(), dtype=np.int64, count=len(found)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r.bucket: r.n for r in rows.collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """For each bucket, floor(1000 ln(share in the target / share in the corpus)), both smoothed by one."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def _weigh(gain, n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = gain.value
        for batch in batches:
            words, count, weight = [], [], []
            for text in batch.column(1):
                w = c = total = 0
                for found, some in features(text.as_py(), n):
                    w, c = w + some, c + sum(found.values())
                    total += sum(of[crc % buckets] * k for crc, k in found.items())
                words.append(w), count.append(c), weight.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, count, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(seed: int, key: Column) -> Column:
    """Gumbel noise in thousandths, from the digest of ``seed:key`` alone; a null key counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3... over all rows in that order), by ranges: no task sees more than its range."""
    # a sort by order alone can't split rows that repeat the same keys; the row's number can
    rows = scratch.cut(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    placed = rows.repartitionByRange(*order, F.col("_row")).sortWithinPartitions(*order, F.col("_row")).drop("_row")
    placed = scratch.cut(placed.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts = zip([p for p, _ in sizes], accumulate([0, *(n for _, n in sizes)]))
    before = rows.sparkSession.createDataFrame(list(starts), "_part long, _before long")
    numbered = placed.join(F.broadcast(before), part == F.col("_part"))
    return numbered.withColumn("rank", F.col("_before") + F.col("_at") - F.shiftleft(part, 33) + 1).drop("_part", "_before", "_at")


def importance_resample(
    docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``, by likeness to the texts of ``target``.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred (rounded down) are drawn: those with the
    highest scores, ties to the smaller id, null ids last; rows that repeat an id and a score count one by one, in no
    stated order.  Undrawn rows have a null rank.  Null and empty texts have no features and weigh 0; an empty
    ``target`` gives smoothed shares; an empty table gives no rows.  Texts of any length are read whole, a slice at a
    time.  Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "resample")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    gain = gains(bucket_counts(rows.select("text"), n, buckets), bucket_counts(target.select(F.col(text_col).cast("binary")), n, buckets), buckets)
    gain = spark.sparkContext.broadcast(gain)  # one number for each bucket
    kind = rows.schema["doc_id"].dataType.simpleString()
    weighed = rows.mapInArrow(_weigh(gain, n, buckets), f"doc_id {kind}, n_words long, n_features long, weight long")
    weighed = scratch.cut(weighed.withColumn("score", F.col("weight") + noise(seed, F.col("doc_id"))), "weighed")
    may = F.col("n_words") >= least_words
    draws = weighed.filter(may).count() * percent // 100
    drawn = ranked(weighed.filter(may), [F.desc("score"), F.asc_nulls_last("doc_id")], scratch).withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    rest = weighed.filter(~may).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
