"""Bucketed tables on shared storage that a merge writes to: only the buckets that hold incoming keys already are rewritten.

Incoming rows are written once, by bucket: where a bucket has none of their keys, that folder is added to it as it is.
A set of tables has one manifest for each version: which folders hold each bucket, and how far each stream has got.
Folders are never changed once written, so a merge is invisible until its manifest is renamed into place, and one rename
commits all tables of a merge.  What the driver handles is ``FOLDERS`` paths for each bucket at most.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerloom.operators.upsert import keep_first, upsert

#: Buckets of a new table; a property of the table from then on.
BUCKETS = 64
#: Folders of a bucket from which the next merge into it rewrites it as one.
FOLDERS = 8


class Conflict(RuntimeError):
    """Another writer committed the same version first."""


class TableSet:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._drafts = spark, folder.rstrip("/"), []
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests ------------------------------------------------------------------------------------------------
    def manifest(self) -> dict:
        """The newest version: {"version", "streams": {name: last batch}, "tables": {name: {"schema", "buckets", "at": {bucket: folder or list of folders}}}}."""
        names = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(names):
            return {"version": 0, "streams": {}, "tables": {}}
        newest = max((s.getPath().getName() for s in self._fs.listStatus(names) if s.getPath().getName().endswith(".json")), default=None)
        return self._read(f"{self.folder}/manifests/{newest}") if newest else {"version": 0, "streams": {}, "tables": {}}

    def _read(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        target = f"{self.folder}/manifests/{manifest['version']:012d}.json"
        draft = self._draft()
        out = self._fs.create(self._path(draft))
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))
        # a rename onto a name that exists fails, so of two writers of one version only the first commits
        if self._fs.exists(self._path(target)) or not self._fs.rename(self._path(draft), self._path(target)):
            raise Conflict(target)

    def _draft(self) -> str:
        self._drafts.append(f"{self.folder}/drafts/{uuid.uuid4().hex}")
        return self._drafts[-1]

    # ---- reading --------------------------------------------------------------------------------------------------
    def table(self, name: str, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The table as of a manifest (the newest by default), or some of its buckets; None where it was never written."""
        entry = (manifest or self.manifest())["tables"].get(name)
        if entry is None:
            return None
        schema = StructType.fromJson(entry["schema"])
        paths = sorted(p for b in entry["at"] if buckets is None or int(b) in buckets for p in self._folders(entry, b))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ---- writing --------------------------------------------------------------------------------------------------
    @staticmethod
    def _folders(entry: dict, bucket: int | str) -> list[str]:
        at = entry["at"].get(str(bucket), [])
        return [at] if isinstance(at, str) else at

    @staticmethod
    def _bucket(keys: list[str], buckets: int, by: list[str] | None) -> Column:
        # Spark deals rows by this hash, so rows dealt ``by`` over as many tasks lie a bucket in a task
        return F.pmod(F.hash(*by), F.lit(buckets)) if by else F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    @staticmethod
    def _content(rows: DataFrame, columns: list[str]) -> dict[int, tuple]:
        """bucket -> (rows, sum of row hashes), for each bucket: what tells whether a merge changed anything."""
        sums = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*columns))).cast("decimal(38,0)")).alias("h"))
        return {r["_bucket"]: (r.n, r.h) for r in sums.collect()}

    def _hit(self, old: DataFrame, new: DataFrame, keys: list[str]) -> set[int]:
        """Buckets of ``new`` with a key that ``old`` has: only hashes of keys are exchanged (equal ones of two keys rewrite a bucket in vain)."""
        key = F.xxhash64(*keys).alias("k")
        both = old.select(key, F.lit(0).alias("side"), F.lit(None).cast("int").alias("_bucket")).unionByName(new.select(key, F.lit(1).alias("side"), "_bucket"))
        met = both.groupBy("k").agg(F.min("side").alias("least"), F.max("side").alias("most"), F.collect_set("_bucket").alias("b")).filter("least < most")
        return {r["_bucket"] for r in met.select(F.explode("b").alias("_bucket")).distinct().collect()}

    def _stage(self, name: str, entry: dict | None, incoming: DataFrame, keys: list[str], policies: dict[str, str], default: str, buckets: int, by: list[str] | None = None) -> dict:
        """Write the buckets of one table that ``incoming`` changes, and return its new entry."""
        columns = incoming.columns
        entry = entry or {"schema": json.loads(incoming.schema.json()), "buckets": buckets, "at": {}, **({"by": by} if by else {})}
        bucket = self._bucket(keys, entry["buckets"], entry.get("by"))
        data = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
        rows = incoming.withColumn("_bucket", bucket)
        rows = rows if by and by == entry.get("by") else rows.repartition(entry["buckets"], "_bucket")
        rows.write.partitionBy("_bucket").parquet(data)
        new = self.spark.read.schema(StructType([*incoming.schema.fields, StructField("_bucket", IntegerType())])).parquet(data)
        touched = sorted(r["_bucket"] for r in new.select("_bucket").distinct().collect())
        if not touched:
            self._drafts.append(data)
            return entry
        fresh = {b: f"{data}/_bucket={b}" for b in touched}
        held = [b for b in touched if self._folders(entry, b)]
        hit = {b for b in held if len(self._folders(entry, b)) >= FOLDERS}
        if held:
            hit |= self._hit(self.table(name, {"tables": {name: entry}}, held), new.filter(F.col("_bucket").isin(held)), keys)
        at = {**entry["at"], **{str(b): [*self._folders(entry, b), fresh[b]] if b in held else fresh[b] for b in touched if b not in hit}}
        if hit:
            old, met = self.table(name, {"tables": {name: entry}}, sorted(hit)), new.filter(F.col("_bucket").isin(sorted(hit)))
            merged = upsert(old.select(*columns), met.select(*columns), keys, policies, default).withColumn("_bucket", bucket)
            data = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
            merged.repartition(F.col("_bucket")).write.partitionBy("_bucket").parquet(data)
            was = self._content(old.withColumn("_bucket", bucket), columns)
            now = self._content(self.spark.read.schema(new.schema).parquet(data), columns)
            at |= {str(b): f"{data}/_bucket={b}" for b in now if now[b] != was.get(b)}
            self._drafts += [fresh[b] for b in sorted(hit)]
        return {**entry, "at": at}

    def merge(self, merges: dict[str, tuple], stream: str | None = None, batch: int | None = None, buckets: int = BUCKETS) -> int:
        """Merge {table: (incoming, keys, policies, default policy)} and commit all of it at once; returns the version.

        ``incoming`` has one row of a key at most.  A fifth member, columns that are the same in all rows of a key, makes a new
        table's buckets by these; ``incoming`` must then be dealt by them, over as many tasks as buckets, and isn't exchanged here.  A merge that changes no row commits nothing.  With ``stream``, a batch
        that isn't newer than the last one committed does nothing, so a replay changes nothing, and a merge that broke off
        is made again from the start.
        """
        manifest = self.manifest()
        if stream is not None and batch <= manifest["streams"].get(stream, -1):
            return manifest["version"]
        tables = {name: self._stage(name, manifest["tables"].get(name), incoming, keys, policies, default, buckets, *by) for name, (incoming, keys, policies, default, *by) in merges.items()}
        after = {**manifest, "tables": {**manifest["tables"], **tables}, "streams": {**manifest["streams"], **({stream: batch} if stream is not None else {})}}
        version = manifest["version"] + (after != manifest)
        if version > manifest["version"]:
            self._commit({**after, "version": version})
        while self._drafts:
            self._fs.delete(self._path(self._drafts.pop()), True)
        return version


def upsert_sink(store: TableSet, name: str, keys: list[str], order: list, policies: dict[str, str] | None = None, default: str = "take_new", stream: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that merges each batch's first row of a key (in ``order``) exactly once."""

    def write(batch: DataFrame, n: int) -> None:
        store.merge({name: (keep_first(batch, keys, order), keys, policies or {}, default)}, stream or name, n)

    return write
