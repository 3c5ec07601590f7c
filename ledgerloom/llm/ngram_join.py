"""N-gram Jaccard join: a count-vector R-tree over word shingles, spread over the cluster.

A document is the set of its 5-word shingles.  Shingles are hashed into groups, and the number of a document's
shingles in each group is a point; the overlap of two sets is at most the sum of the coordinate minima of their
points, so a pair whose bound falls short of the needed overlap is skipped, and only pairs that pass are verified on
the sets themselves.

1. Each text is hashed once; equal sets become one set.  Fine groups are counted over all documents (a table of
   fixed size).
2. The root of the tree sends a set to the coordinates (finest groups: single shingles) at which it can meet a
   linked set first: taken in one common order, rarest group first, the first n - ceil(0.75 n) + 1 coordinates.  Two
   sets that share none of these have too small a sum of minima, so no link is lost.  At a coordinate, two sets are
   connected if their sizes, what is left of both in that order, and the number of coordinates they share allow the
   overlap; what connects is a cell.
3. Cells are packed into leaves of bounded size; only here do sets travel.  Leaves meet in tasks of their own: nodes
   (runs of points, with the largest coordinates as their box) are compared first, then points, then sets.  A cell's
   leaves meet themselves and its first leaf; leaves of which all sets are then connected need no further meeting.

Links come out as forests, a task's links never exceed its rows, and the classes are connected components of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, bitmaps, components, in_bitmaps, ship_package, worker_state

#: Fine groups of which the frequency is counted: 2**FINE, in segments of SEGMENT.
FINE, SEGMENT = 22, 1 << 16
#: Sets at one coordinate up to which every two are looked at; more are chained by size.
SMALL = 64
ENOUGH = 1 << 31
#: Coordinates of a point, sets and shingles in a leaf on average at most, and points in a node.
DIMS, LEAF_SETS, LEAF_SHINGLES, NODE = 128, 384, 400_000, 16
#: Words that a worker remembers the hashes of, and the longest of them.
WORD_CACHE, WORD_LENGTH = 60_000, 64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= WORD_LENGTH:
            self[word] = h
        return h


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; A-Z count as a-z, words end at ASCII white space."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    if len(tokens) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens))], dtype=np.uint64)
    known = worker_state("words", _Hashes)
    if len(known) > WORD_CACHE:
        known.clear()
    h = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    n = len(h) - words + 1
    s = h[:n].copy()
    for j in range(1, words):
        s = (s ^ (s >> np.uint64(29))) * _ODD[1] + h[j : n + j] * _ODD[0]
    s ^= s >> np.uint64(32)
    s *= _ODD[2]
    s ^= s >> np.uint64(29)
    return np.unique(s)


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def needed_overlap(n, m, percent: int):
    """Smallest overlap at which 100 |A & B| >= percent |A | B|."""
    return -(-percent * (n + m) // (100 + percent))


def point(s: np.ndarray) -> np.ndarray:
    return np.bincount((s & np.uint64(DIMS - 1)).astype(np.int64), minlength=DIMS).astype(np.int32)


def _sets_and_counts(words: int):
    """Tasks give one row for each document, and at their end the counts of fine groups, by segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << FINE, dtype=np.uint8)  # full at 255 in one task, which is common enough to come last
        columns = ["doc_id", "set_id", "n", "segment", "counts"]
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingle_set(text, words)
                key = set_key(s) if len(s) else 0
                if len(s) and key not in seen:
                    seen.add(key)
                    at = (s >> np.uint64(64 - FINE)).astype(np.int64)
                    counts[at] += counts[at] < 255
                rows.append((doc_id, key if len(s) else None, len(s), -1, None))
            out = pd.DataFrame(rows, columns=columns, dtype=object)
            yield out
        if counts.any():
            parts = counts.reshape(-1, SEGMENT)
            yield pd.DataFrame([(None, None, 0, i, zlib.compress(p.tobytes(), 1)) for i, p in enumerate(parts)], columns=columns, dtype=object)

    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment -> (segment, level); one sum is held, however many tasks counted a segment."""
    now, total = None, None

    def out() -> pa.RecordBatch:
        # quarter powers of two are fine enough to tell a common group from a rare one
        level = np.floor(4 * np.log2(total.astype(np.float64) + 1)).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["segment", "level"])

    for batch in batches:
        for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if segment != now:
                if now is not None:
                    yield out()
                now, total = segment, np.zeros(SEGMENT, dtype=np.uint64)
            total += np.frombuffer(zlib.decompress(counts.as_buffer()), dtype=np.uint8)
    if now is not None:
        yield out()


def _coordinates(words: int, percent: int, levels):
    """(key, size_at, set_id): the coordinates by which the root of the tree sends each set, with the set's size and the
    coordinate's place in its order (size << 32 | place)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level = np.frombuffer(zlib.decompress(levels.value), dtype=np.uint8)
        seen: set[int] = set()
        for batch in batches:
            keys, ids, places = [], [], []
            for text in batch["text"]:
                s = shingle_set(text, words)
                n = len(s)
                if not n or (name := set_key(s)) in seen:
                    continue
                seen.add(name)
                rank = level[(s >> np.uint64(64 - FINE)).astype(np.int64)]
                first = s[np.argsort(rank, kind="stable")[: n + (-percent * n // 100) + 1]]
                keys.append(first)
                ids.append(np.full(len(first), name, dtype=np.int64))
                places.append(np.arange(len(first), dtype=np.int64) + (n << 32))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "size_at": np.concatenate(places), "set_id": np.concatenate(ids)})

    return run


def _meetings(percent: int):
    """Rows sorted by (key, size_at) -> (a, b, sizes, place, shared): two sets that share coordinates, both sizes (of
    a << 32 | of b), the first places at which they do (likewise), and how many they share in this task.

    Where more than SMALL sets share a coordinate, each meets the first of its run of near sizes only, with a count
    that always suffices.
    """

    def connect(ids: np.ndarray, size_at: np.ndarray, out: list) -> None:
        n, at = (size_at >> 32).tolist(), (size_at & 0xFFFFFFFF).tolist()
        ids = ids.tolist()
        if len(ids) > SMALL:
            hub = 0
            for k in range(1, len(ids)):
                if 100 * n[k - 1] < percent * n[k]:
                    hub = k
                elif ids[k] != ids[hub]:
                    out.append((ids[hub], ids[k], n[k] << 32 | n[k], 0, ENOUGH))
            return
        for k in range(1, len(ids)):
            for h in range(k - 1, -1, -1):
                if 100 * n[h] < percent * n[k]:
                    break
                if ids[h] != ids[k]:
                    x, y = (h, k) if ids[h] < ids[k] else (k, h)
                    out.append((ids[x], ids[y], n[x] << 32 | n[y], at[x] << 32 | at[y], 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def summed(out: list) -> pd.DataFrame:
            rows = pd.DataFrame(out, columns=["a", "b", "sizes", "place", "shared"], dtype="int64")
            return rows.groupby(["a", "b"], sort=False, as_index=False).agg({"sizes": "max", "place": "min", "shared": "sum"})

        held: list[list[np.ndarray]] = []  # rows of the key that may go on in the next batch
        out: list = []
        for batch in batches:
            rows = [batch[c].to_numpy() for c in ("key", "size_at", "set_id")]
            if held and len(rows[0]) and held[0][0][0] == rows[0][0] == rows[0][-1]:
                held.append(rows)
                continue
            key, size_at, ids = (np.concatenate(c) for c in zip(*held, rows, strict=True))
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(1, dtype=np.int64)
            last = starts[-1]
            lengths = np.diff(np.append(starts, len(key)))[:-1]
            for a, c in zip(starts[:-1][lengths > 1].tolist(), lengths[lengths > 1].tolist(), strict=True):
                connect(ids[a : a + c], size_at[a : a + c], out)
            held = [[key[last:], size_at[last:], ids[last:]]]
            if len(out) > 200_000:
                yield summed(out)
                out = []
        if held and sum(len(h[0]) for h in held) > 1:
            _, size_at, ids = (np.concatenate(c) for c in zip(*held, strict=True))
            connect(ids, size_at, out)
        yield summed(out)

    return run


def may_link(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the meetings that can be links, by two bounds on the overlap.

    What is left of either set at the first shared place must hold the needed overlap.  And whichever set's
    coordinates end first in the common order, the rest of that set is all that the overlap can have besides the
    coordinates that both sent, so they must share the difference.
    """
    every = pairs.groupBy("a", "b").agg(F.max("sizes").alias("sizes"), F.min("place").alias("place"), F.sum("shared").alias("shared"))
    low = (1 << 32) - 1
    n, m = F.shiftright("sizes", 32), F.col("sizes").bitwiseAND(F.lit(low))
    i, j = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit(low))
    need = F.floor((percent * (n + m) + 99 + percent) / (100 + percent))
    rest = F.greatest(*[F.floor((percent * x + 99) / 100) - 1 for x in (n, m)])
    return every.filter((F.least(n - i, m - j) >= need) & (F.col("shared") >= need - rest)).select("a", "b")


def _sets(words: int):
    """Chosen texts -> their sets; rows that repeat a chosen id with another text are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["text"]]
            out = batch[["set_id", "cell", "leaf"]].assign(shingles=[x.tobytes() for x in sets])
            yield out[[k == set_key(x) for k, x in zip(batch["set_id"].tolist(), sets, strict=True)]]

    return run


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leaves -> (set_id, cell, shingles)."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            ids, ends = np.frombuffer(r.ids, dtype=np.int64), np.cumsum(np.frombuffer(r.sizes, dtype=np.int32).astype(np.int64)) * 8
            yield pd.DataFrame({"set_id": ids, "cell": r.cell, "shingles": [r.sets[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]})


def pack_leaf(rows: pd.DataFrame) -> pd.DataFrame:
    """The sets of one leaf, in the order of their sizes and points, as one row."""
    rows = rows.drop_duplicates("set_id")
    sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["shingles"]]
    points = np.array([point(s) for s in sets])
    order = np.lexsort((points[:, 1], points[:, 0], [len(s) for s in sets]))
    out = {"cell": int(rows["cell"].iloc[0]), "leaf": int(rows["leaf"].iloc[0])}
    labels = rows["label" if "label" in rows else "set_id"].to_numpy(dtype=np.int64)
    out |= {"ids": rows["set_id"].to_numpy(dtype=np.int64)[order].tobytes(), "labels": labels[order].tobytes()}
    out |= {"sizes": np.array([len(sets[i]) for i in order], dtype=np.int32).tobytes(), "sets": b"".join(sets[i].tobytes() for i in order)}
    return pd.DataFrame([out])


class Leaf:
    """A leaf of the tree: points in order, and nodes of NODE points with the box around each."""

    def __init__(self, ids, labels, sizes, sets):
        self.ids, self.labels = np.frombuffer(ids, dtype=np.int64), np.frombuffer(labels, dtype=np.int64)
        self.n = np.frombuffer(sizes, dtype=np.int32).astype(np.int64)
        self.sets = np.split(np.frombuffer(sets, dtype=np.uint64), np.cumsum(self.n)[:-1])
        self.points = np.array([point(s) for s in self.sets])
        starts = np.arange(0, len(self.n), NODE)
        self.nodes = [slice(i, i + NODE) for i in starts]
        self.high = np.maximum.reduceat(self.points, starts)
        self.least = np.minimum.reduceat(self.n, starts)
        self.most = np.maximum.reduceat(self.n, starts)


class Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x] = root
            x = y
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def overlaps(s: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """The number of shingles that a sorted set shares with each of others."""
    if not others:
        return []
    every = np.concatenate(others)
    at = np.searchsorted(s, every)
    same = s[np.minimum(at, len(s) - 1)] == every
    return np.add.reduceat(same, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64).tolist()


def meet(x: Leaf, y: Leaf | None, percent: int, forest: Forest) -> list[tuple[int, int]]:
    """Links that connect what ``forest`` doesn't connect yet, between two leaves or (y None) within one."""
    own, y, links = y is None, x if y is None else y, []
    x_ids, y_ids = x.ids.tolist(), y.ids.tolist()
    bound = np.minimum(x.high[:, None, :], y.high[None, :, :]).sum(axis=2)
    near = (bound >= needed_overlap(x.least[:, None], y.least[None, :], percent)) & (100 * x.most[:, None] >= percent * y.least[None, :]) & (100 * y.most[None, :] >= percent * x.least[:, None])
    for i, j in np.argwhere(near):
        if own and j < i:
            continue
        a, b = x.nodes[i], y.nodes[j]
        sums = np.minimum(x.points[a][:, None, :], y.points[b][None, :, :]).sum(axis=2)
        need = needed_overlap(x.n[a][:, None], y.n[b][None, :], percent)
        for p, close in enumerate(sums >= need):
            p += a.start
            left = (np.flatnonzero(close) + b.start).tolist()
            if own:
                left = [q for q in left if q > p]
            # in growing runs, as one link may spare the others
            u, width = x_ids[p], 1
            while left:
                root = forest.find(u)
                left = [q for q in left if forest.find(y_ids[q]) != root]
                some, left, width = left[:width], left[width:], 2 * width
                for q, n in zip(some, overlaps(x.sets[p], [y.sets[q] for q in some]), strict=True):
                    if n >= needed_overlap(int(x.n[p]), int(y.n[q]), percent) and forest.join(u, y_ids[q]):
                        links.append((u, y_ids[q]))
    return links


def _links(x: Leaf, y: Leaf | None, percent: int) -> list[tuple[int, int]]:
    forest = Forest()
    for leaf in (x, y) if y else (x,):
        for u, v in zip(leaf.ids.tolist(), leaf.labels.tolist(), strict=True):
            forest.join(u, v)
    return meet(x, y, percent, forest)


def _meet_leaves(percent: int, two: bool):
    """Links between the two leaves of each row, or within its one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):  # sets are read where they lie in the batch
                x, y = (Leaf(*[batch.column(c + end)[k].as_buffer() for c in LEAF]) if two or not end else None for end in ("", "2"))
                out += _links(x, y, percent)
            links = np.array(out, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return run


def _leaves(sets: DataFrame) -> DataFrame:
    """(cell, part, leaves): over how many leaves the sets of a part of a cell are to be dealt."""
    size = sets.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("sum_n"))
    return size.select("cell", "part", F.ceil(F.greatest(F.col("c") / LEAF_SETS, F.col("sum_n") / LEAF_SHINGLES)).cast("int").alias("leaves"))


def _leaf_of(start, leaves) -> Column:
    return start + F.pmod(F.xxhash64("set_id"), leaves).cast("int")


PACKED = "cell long, leaf int, ids binary, labels binary, sizes binary, sets binary"


LINK = "a long, b long"
LEAF = ("ids", "labels", "sizes", "sets")


def _second(packed: DataFrame) -> DataFrame:
    return packed.select("cell", F.col("leaf").alias("other"), *[F.col(c).alias(f"{c}2") for c in LEAF])


def ngram_jaccard_join(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id that links lead to, itself included).

    Two rows link when 100 |A & B| >= percent |A | B| for their sets of distinct ``words``-word shingles; a text of
    fewer words is one shingle.  Null, empty and blank texts have no shingles and link with nothing, so they are
    their own component.  Rows with equal sets link whatever their ids; rows that repeat an id are separate rows with
    links of their own.  A null id is never the smallest: a component of null ids only has a null component_id.  An
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pass1 = scratch.cut(docs.mapInPandas(_sets_and_counts(words), "doc_id long, set_id long, n int, segment int, counts binary"), "pass1")
    members = pass1.filter("segment = -1").select("doc_id", "set_id", "n")
    # of equal sets one document stands for all; a bitmap keeps (nearly) all others from being sent
    first = members.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"))
    first = scratch.cut(first.withColumn("doc_id", F.coalesce("least", F.lit(0).cast("long"))), "first")
    keyed = docs.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), "text")

    def among(chosen: DataFrame, name: str) -> DataFrame:
        bits = scratch.cut(bitmaps(chosen, F.xxhash64("doc_id")), name)
        return in_bitmaps(keyed, F.xxhash64("doc_id"), bits, "wanted").filter("wanted").select("doc_id", "text")

    counted = pass1.filter("segment >= 0").select("segment", "counts").repartition(F.col("segment")).sortWithinPartitions("segment")
    level = counted.mapInArrow(_levels, "segment int, level binary")
    table = np.zeros(1 << FINE, dtype=np.uint8)  # fixed size: 4 MB
    for r in level.collect():
        table[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(r.level, dtype=np.uint8)
    levels = spark.sparkContext.broadcast(zlib.compress(table.tobytes()))

    # the root: sets meet at shared coordinates
    sent = among(first, "first-bits").select("text").mapInPandas(_coordinates(words, percent, levels), "key long, size_at long, set_id long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(parts, "key").sortWithinPartitions("key", "size_at", "set_id")
    met = sent.mapInPandas(_meetings(percent), "a long, b long, sizes long, place long, shared long")
    chained = scratch.cut(may_link(met, percent), "chained")
    cells = scratch.cut(components(chained, scratch, "cells").select(F.col("id").alias("set_id"), F.col("label").alias("cell")), "cells")
    for name in ("chained", "first-bits"):
        scratch.drop(name)

    # every cell's leaves, before any set travels
    chosen = scratch.cut(cells.join(first, "set_id").select("set_id", "cell", "n", "doc_id", F.lit(0).cast("long").alias("part")), "chosen")
    leaves = scratch.cut(_leaves(chosen), "leaf-counts")
    chosen = scratch.cut(chosen.join(leaves, ["cell", "part"]).select("set_id", "doc_id", "cell", "n", "leaves", _leaf_of(F.lit(0), F.col("leaves")).alias("leaf")), "dealt")

    # the texts of cells travel once, their sets once more, into leaves
    texts = among(chosen, "bits").join(chosen.select("doc_id", "set_id", "cell", "leaf"), "doc_id")
    sets = texts.select("set_id", "cell", "leaf", "text").mapInPandas(_sets(words), "set_id long, cell long, leaf int, shingles binary")
    packed = scratch.cut(sets.groupBy("cell", "leaf").applyInPandas(pack_leaf, PACKED), "leaves-1")
    for name in ("bits", "cells", "chosen", "leaf-counts"):
        scratch.drop(name)

    # each leaf meets itself; a cell's other leaves meet its first
    found = scratch.cut(packed.mapInArrow(_meet_leaves(percent, False), LINK), "links-0")
    more = chosen.filter("leaves > 1")
    several = more.limit(1).count() > 0
    if several:
        met = packed.filter("leaf > 0").join(_second(packed.filter("leaf = 0")), "cell").mapInArrow(_meet_leaves(percent, True), LINK)
        found = scratch.cut(found.union(met), "links-1")
        scratch.drop("links-0")
    labels = scratch.cut(components(found, scratch, "classes-1"), "labels-1")
    if several:
        # cells that are one class by now are done; in others, leaves are dealt anew, by class where it is large
        marked = more.select("set_id", "cell", "n").join(labels.select(F.col("id").alias("set_id"), "label"), "set_id", "left").select("set_id", "cell", "n", F.coalesce("label", "set_id").alias("label"))
        marked = scratch.cut(marked, "marked")
        classes = marked.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("c"))
        mixed = classes.groupBy("cell").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("cell")
        parts_of = classes.join(mixed, "cell").select("cell", "label", F.when(F.col("c") >= LEAF_SETS, F.col("label")).otherwise(F.lit(0)).alias("part"))
        marked = scratch.cut(marked.join(scratch.cut(parts_of, "parts"), ["cell", "label"]), "mixed")
        leaves = _leaves(marked)
        before = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        leaves = scratch.cut(leaves.select("*", F.coalesce(F.sum("leaves").over(before), F.lit(0)).cast("int").alias("start")), "starts")
        if leaves.limit(1).count():
            marked = scratch.cut(marked.join(leaves, ["cell", "part"]).select("set_id", "label", _leaf_of(F.col("start"), F.col("leaves")).alias("leaf")), "assigned")
            again = packed.join(scratch.cut(leaves.select("cell").distinct(), "mixed-cells"), "cell", "left_semi").mapInPandas(_unpacked, "set_id long, cell long, shingles binary")
            packed = scratch.cut(again.join(marked, "set_id").groupBy("cell", "leaf").applyInPandas(pack_leaf, PACKED), "leaves-2")
            # a part of one class needs no meeting among its own leaves; part 0 holds the small classes
            ends = leaves.groupBy("cell").agg(F.max(F.col("start") + F.col("leaves")).alias("total"))
            each = leaves.join(ends, "cell").select("*", F.explode(F.sequence("start", F.col("start") + F.col("leaves") - 1)).alias("leaf"))
            low = F.when(F.col("part") == 0, F.col("leaf")).otherwise(F.col("start") + F.col("leaves"))
            pairs = each.filter(low < F.col("total")).select("cell", "leaf", F.explode(F.sequence(low, F.col("total") - 1)).alias("other"))
            pairs = scratch.cut(pairs, "pairs-2")
            alone = packed.join(pairs.filter("leaf = other").select("cell", "leaf"), ["cell", "leaf"], "left_semi")
            met = pairs.filter("leaf <> other").join(packed, ["cell", "leaf"]).join(_second(packed), ["cell", "other"])
            found = scratch.cut(found.union(alone.mapInArrow(_meet_leaves(percent, False), LINK)).union(met.mapInArrow(_meet_leaves(percent, True), LINK)), "links-2")
            scratch.drop("leaves-2")
            labels = scratch.cut(components(found, scratch, "classes-2"), "labels-2")
    scratch.drop("leaves-1")

    # back to documents: classes of sets first, then the rows of each set
    by_set = first.join(labels.select(F.col("id").alias("set_id"), "label"), "set_id", "left").select("set_id", "least", F.coalesce("label", "set_id").alias("label"))
    by_set = scratch.cut(by_set, "by-set")
    for name in ("first", "dealt", "labels-1", "labels-2", "links-0", "links-1", "links-2", "marked", "parts", "mixed", "starts", "assigned", "mixed-cells", "pairs-2"):
        scratch.drop(name)
    least = scratch.cut(by_set.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    named = scratch.cut(by_set.join(least, "label").select("set_id", "component_id"), "named")
    for name in ("by-set", "least"):
        scratch.drop(name)
    blank = members.filter("set_id is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return members.filter("set_id is not null").join(named, "set_id").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionByName(blank)
