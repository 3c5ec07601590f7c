"""Shared pieces of the corpus operators: scratch tables, bounded bitmaps and connected components.

Scratch tables live in the folder that ``spark.checkpoint.dir`` names, so every executor can read them again
after another executor is lost.  Only a session on this machine alone may lack the setting and gets a folder of its own.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits in one bitmap of ``bitmap_construct_agg``, a property of that function.
BITS = 32_768
#: Bitmaps in one membership table: at most 4096 x 4 KB = 16 MB, whatever the size of the corpus.
BITMAPS = 4_096
#: Bytes of an Arrow batch at most while a scratch table is written: a task has a few of them in both processes.
BATCH_BYTES, BATCH_SETTING = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Give executors this package where neither PYTHONPATH nor the working folder has it."""
    root = Path(__file__).resolve().parents[2]
    known = [Path(p or ".").resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]]
    if root in known or getattr(spark, "_ledgerloom_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "ledgerloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    spark._ledgerloom_shipped = True


_STATE: dict = {}


def worker_state(key, make):
    """What a worker process keeps between tasks of one operator (``make()`` the first time); any other's is let go."""
    if key not in _STATE:
        if _STATE:
            _STATE.clear()
            _give_back()
        _STATE[key] = make()
    return _STATE[key]


def _give_back() -> None:
    """Return freed memory to the system, as a worker that is used again would keep it through later operators."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES at most for the jobs started inside, unless the session has a setting of its own."""
    if spark.conf.get(BATCH_SETTING, None):
        yield
        return
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING)


class Scratch:
    """Tables that cut a plan's lineage, written once to shared storage and read again."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="ledgerloom-scratch-")
        self.spark, self.base, self.paths = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}", {}

    def cut(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        path = f"{self.base}/{name}-{len(self.paths)}"
        self.paths[name] = [*self.paths.get(name, []), path]
        self.paths[path] = []
        with small_batches(self.spark):
            df.write.parquet(path, compression=codec)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove the tables of that name, when nothing that is still to run reads them."""
        for path in self.paths.pop(name, []):
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def _bit_places(key: Column) -> list[Column]:
    return [F.pmod(F.shiftright(key, 12), F.lit(BITS)).cast("long"), F.pmod(F.shiftright(key, 33), F.lit(BITS)).cast("long")]


def bitmaps(df: DataFrame, key: Column) -> DataFrame:
    """(bucket, bits): a blocked Bloom filter over a 64-bit key, two bits a key, at most 16 MB in all.

    Setting bits is a plain aggregation with map-side combine.
    """
    bit = df.select(F.pmod(key, F.lit(BITMAPS)).alias("bucket"), F.explode(F.array(*_bit_places(key))).alias("bit"))
    return bit.groupBy("bucket").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits"))


def in_bitmaps(df: DataFrame, key: Column, bits: DataFrame, name: str, buckets: int = BITMAPS) -> DataFrame:
    """``df`` with a boolean column: whether the bitmaps may hold the key.  Broadcasts ``bits`` (4 KB for each bucket)."""
    bucket = F.pmod(key, F.lit(buckets))
    small = bits.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    joined = df.withColumn("_key", key).join(F.broadcast(small), bucket == F.col("_bucket"), "left")

    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1, F.lit(False))

    a, b = _bit_places(F.col("_key"))
    return joined.withColumn(name, is_set(a) & is_set(b)).drop("_bucket", "_bits", "_key")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, label): the smallest id that undirected ``edges`` (a, b) lead to, for every id on an edge.

    Labels hook onto the smallest grandparent that a neighbour knows and then point at it (pointer jumping), so the
    number of rounds grows with the logarithm of a chain's length.  Each round is joins between two written tables,
    which adaptive execution can split where a hub has most of the edges; only a count comes to the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = scratch.cut(both, f"{name}-edges")
    first = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("f"))
    labels, step = scratch.cut(first, f"{name}-labels"), 0
    while True:
        parent = labels.select(F.col("id").alias("f"), F.col("f").alias("gf"))
        grand = scratch.cut(labels.join(parent, "f").select("id", "f", "gf"), f"{name}-grand-{step}")
        near = both.join(grand.select(F.col("id").alias("b"), "gf"), "b").groupBy("a").agg(F.min("gf").alias("m"))
        near = near.join(grand.select(F.col("id").alias("a"), "f", "gf"), "a")
        hooks = near.select(F.explode(F.array(F.struct(F.col("f").alias("id"), F.col("m").alias("v")), F.struct(F.col("a").alias("id"), F.least("m", "gf").alias("v")))).alias("x")).select("x.*")
        low = hooks.groupBy("id").agg(F.min("v").alias("v"))
        new = grand.join(low, "id").select("id", F.least("v", "gf").alias("f"), (F.least("v", "gf") != F.col("f")).alias("moved"))
        new = scratch.cut(new, f"{name}-new-{step}")
        moved = new.filter("moved").limit(1).count()
        scratch.drop(f"{name}-grand-{step}")
        scratch.drop(f"{name}-labels" if step == 0 else f"{name}-new-{step - 1}")
        labels, step = new.select("id", "f"), step + 1
        if not moved:
            scratch.drop(f"{name}-edges")
            return labels.select("id", F.col("f").alias("label"))
