"""Embedding near-dedup by an epsilon grid order join.

Unit vectors of cosine c or more lie within epsilon = sqrt(2 - 2 c) of each other, and no projection makes them
farther apart.  Vectors are projected on the leading principal dimensions (of a covariance that tasks sum),
put in the order of their grid cells of side epsilon, and cut into sequence intervals (blocks) of bounded size.
Blocks meet only if no grid dimension holds their boxes more than epsilon apart; within a meeting, intervals are
halved and halves that are provably distant are skipped, down to small squares that get exact double products.  What a
meeting copies is two blocks, so large blocks keep the shuffle near the vectors' own size; vectors travel as they came
(four bytes a component where that is exact) and become unit vectors in double precision where they meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, components, ship_package
from ledgerloom.llm.ngram_join import Forest

#: Leading principal dimensions of the grid, vectors in a block at most, and the side of an exact square.
GRID_DIMS, BLOCK, SQUARE = 6, 8_192, 64
#: Components among which principal dimensions are looked for, so a covariance takes 8 MB at most.
WIDE = 1_024
#: Rounding that projections and products may add.
SLACK = 1e-9


def _raw(v) -> tuple[int, bytes] | None:
    """Number of components and their bytes (single precision where that is exact); None for null, zero and non-finite ones."""
    if v is None:
        return None
    x = np.array([np.nan if c is None else c for c in v], dtype=np.float64)
    if not len(x) or not np.isfinite(x).all() or not x.any():
        return None
    with np.errstate(over="ignore", under="ignore"):
        single = x.astype("<f4")
    return len(x), (single if (single.astype(np.float64) == x).all() else x).tobytes()


def unit_rows(raw: bytes, d: int, width: int) -> np.ndarray:
    """Unit vectors of ``d`` components, ``width`` bytes each, in double precision."""
    x = np.frombuffer(raw, dtype=f"<f{width}").reshape(-1, d).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(vec_id, label, d, raw), d and raw null for vectors that link with nothing."""
    for batch in batches:
        found = [_raw(v) for v in batch["embedding"]]
        d = pd.array([None if f is None else f[0] for f in found], dtype="Int32")
        yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "d": d, "raw": [None if f is None else f[1] for f in found]})


def _kinds(batch: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(d, width, places, unit vectors) of the vectors of each shape."""
    shape = list(zip(batch["d"].tolist(), (len(r) for r in batch["raw"]), strict=True))
    for d, size in set(shape):
        at = np.array([k for k, x in enumerate(shape) if x == (d, size)])
        yield d, size // d, at, unit_rows(b"".join(batch["raw"].iloc[k] for k in at), d, size // d)


def _moments(wide: int):
    """(d, row, sums): of a task's vectors with a 1 before their first ``wide`` components, the rows of x.T @ x."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, _, x in _kinds(batch):
                x = np.column_stack([np.ones(len(x)), x[:, :wide]])
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            yield pd.DataFrame({"d": d, "row": range(len(m)), "sums": [r.tobytes() for r in m]})

    return run


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (d, row) -> their sums, one held at a time."""
    now, total, columns = None, None, ["d", "row", "sums"]
    for batch in batches:
        for d, row, sums in zip(batch["d"], batch["row"], batch["sums"], strict=True):
            if (d, row) != now:
                if now:
                    yield pd.DataFrame([(*now, total.tobytes())], columns=columns)
                now, total = (d, row), 0
            total = total + np.frombuffer(sums)
    if now:
        yield pd.DataFrame([(*now, total.tobytes())], columns=columns)


def principal_axes(vectors: DataFrame, wide: int = WIDE) -> dict[int, np.ndarray]:
    """d -> (d, GRID_DIMS) leading axes of all vectors of d components, within their first ``wide`` components.

    Tasks' sums are added up by matrix row over the cluster, so the driver sees one matrix for each d, of a bounded
    size.  A projection onto any such axes lengthens no distance, so wider vectors lose no pair by it.
    """
    parts = vectors.select("d", "raw").mapInPandas(_moments(wide), "d int, row int, sums binary")
    sums: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.repartition("d", "row").sortWithinPartitions("d", "row").mapInPandas(_added, "d int, row int, sums binary").collect():
        sums.setdefault(r.d, {})[r.row] = np.frombuffer(r.sums)
    out = {}
    for d, rows in sums.items():
        m = np.array([rows[k] for k in range(len(rows))])
        mean = m[0, 1:] / m[0, 0]
        _, axes = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        leading = axes[:, ::-1][:, :GRID_DIMS]
        out[d] = np.zeros((d, leading.shape[1]))
        out[d][: len(leading)] = leading
    return out


def _place(axes, epsilon: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            widths, cells = np.zeros(len(batch), dtype=np.int32), np.empty(len(batch), dtype=object)
            for d, width, at, x in _kinds(batch):
                widths[at] = width
                for k, c in zip(at, np.floor(x @ axes.value[d] / epsilon).astype(np.int32).tolist(), strict=True):
                    cells[k] = c
            yield batch.assign(width=widths, cells=cells)[["class_id", "label", "copies", "d", "width", "raw", "cells"]]

    return run


def _blocks(axes):
    """Rows sorted by (label, d, width, cells) -> blocks of one label and kind of vector, with boxes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []
        columns = ["block", "label", "d", "width", "low", "high", "ids", "copies", "raws"]

        def block(rows: list) -> pd.DataFrame:
            nonlocal number
            d, width, raws = rows[0].d, rows[0].width, b"".join(r.raw for r in rows)
            at = unit_rows(raws, d, width) @ axes.value[d]
            number += 1
            ids, copies = (np.array([getattr(r, c) for r in rows], dtype=np.int64).tobytes() for c in ("class_id", "copies"))
            one = [(part << 32) + number, rows[0].label, d, width, at.min(axis=0).tolist(), at.max(axis=0).tolist(), ids, copies, raws]
            return pd.DataFrame([one], columns=columns)

        for batch in batches:
            for r in batch.itertuples(index=False):
                if held and ((held[0].label, held[0].d, held[0].width) != (r.label, r.d, r.width) or len(held) >= BLOCK):
                    yield block(held)
                    held = []
                held.append(r)
        if held:
            yield block(held)

    return run


def join_blocks(a: np.ndarray, b: np.ndarray, pa: np.ndarray, pb: np.ndarray, cosine: float, epsilon: float, own: bool):
    """(i, j) index arrays of pairs with cosine or more; ``own``: a is b and i < j."""
    found_i, found_j, todo = [], [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if own and j1 <= i0:
            continue
        x, y = pa[i0:i1], pb[j0:j1]
        gap = np.maximum(np.maximum(y.min(axis=0) - x.max(axis=0), x.min(axis=0) - y.max(axis=0)), 0)
        if gap @ gap > epsilon * epsilon + SLACK:
            continue  # provably distant
        if max(i1 - i0, j1 - j0) <= SQUARE:
            i, j = np.nonzero(a[i0:i1] @ b[j0:j1].T >= cosine - SLACK)
            i, j = i + i0, j + j0
            if own:
                i, j = i[i < j], j[i < j]
            near = np.einsum("ij,ij->i", a[i], b[j])
            keep = near >= cosine
            found_i.append(i[keep])
            found_j.append(j[keep])
            continue
        im, jm = (i0 + i1) // 2, (j0 + j1) // 2
        todo += [(p, q, r, s) for p, q in ((i0, im), (im, i1)) for r, s in ((j0, jm), (jm, j1)) if p < q and r < s]
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.empty(0, int), np.empty(0, int))


def _meet_blocks(axes, cosine: float, epsilon: float):
    """(a, b, links): for each vector the number of rows linked to it in this meeting, and a forest (a, b) of 0 links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                own = r.block == r.other  # then there is no second block in the row
                a, ia, ca = unit_rows(r.raws, r.d, r.width), np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.copies, dtype=np.int64)
                b, ib, cb = (a, ia, ca) if own else (unit_rows(r.raws2, r.d, int(r.width2)), np.frombuffer(r.ids2, dtype=np.int64), np.frombuffer(r.copies2, dtype=np.int64))
                i, j = join_blocks(a, b, a @ axes.value[r.d], b @ axes.value[r.d], cosine, epsilon, own)
                na, nb = np.bincount(i, cb[j], len(a)).astype(np.int64), np.bincount(j, ca[i], len(b)).astype(np.int64)
                out += [(x, x, n) for x, n in [*zip(ia[na > 0].tolist(), na[na > 0].tolist()), *zip(ib[nb > 0].tolist(), nb[nb > 0].tolist())]]
                forest = Forest()
                out += [(u, v, 0) for u, v in zip(ia[i].tolist(), ib[j].tolist()) if forest.join(u, v)]
            yield pd.DataFrame(out, columns=["a", "b", "links"], dtype="int64")

    return run


def embedding_near_dedup(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", wide: int = WIDE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id (smallest id that links lead to), kept.

    Rows link when their labels are equal and not null and their vectors' cosine in double precision is ``cosine`` or
    more; vectors of different lengths, and null, zero or non-finite ones, link with nothing.  Equal vectors of one
    label are handled once and their copies counted.  Of longer vectors, the grid's axes are found among the first
    ``wide`` components, which loses no pair.  Rows that repeat an id are separate rows; a null id is never
    the smallest.  An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    scratch, epsilon = Scratch(spark, "embed-dedup"), math.sqrt(2 - 2 * cosine)
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("embedding"))
    rows = raw.mapInPandas(_vectors, "vec_id long, label string, d int, raw binary")
    # equal vectors of one label are one class, named by 128 bits, and numbered where the table is written
    usable = F.col("label").isNotNull() & F.col("raw").isNotNull()
    names = ["name1", "name2"]
    rows = scratch.cut(rows.withColumn("raw", F.when(usable, F.col("raw"))).withColumn("name1", F.when(usable, F.xxhash64("label", "raw"))).withColumn("name2", F.when(usable, F.xxhash64(F.lit("second"), "raw", "label"))), "rows")
    named = rows.filter("raw is not null").select("vec_id", *names)
    classes = rows.filter("raw is not null").groupBy(*names).agg(F.first("label").alias("label"), F.first("d").alias("d"), F.first("raw").alias("raw"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.cut(classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    axes = spark.sparkContext.broadcast(principal_axes(classes, wide))
    placed = classes.select("class_id", "label", "copies", "d", "raw").mapInPandas(_place(axes, epsilon), "class_id long, label string, copies long, d int, width int, raw binary, cells array<int>")
    order = ["label", "d", "width", "cells", "class_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = scratch.cut(placed, "placed").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = scratch.cut(ordered.mapInPandas(_blocks(axes), "block long, label string, d int, width int, low array<double>, high array<double>, ids binary, copies binary, raws binary"), "blocks")

    # blocks meet by the cells of the first dimension, then by their boxes: 1/BLOCK of the rows, without vectors
    box = blocks.select("block", "label", "d", "low", "high", F.floor(F.element_at("low", 1) / epsilon).alias("from"), F.floor(F.element_at("high", 1) / epsilon).alias("to"))
    left = box.withColumn("cell", F.explode(F.sequence("from", "to")))
    right = box.select(F.col("block").alias("other"), "label", "d", F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(F.sequence(F.col("from") - 1, F.col("to") + 1)).alias("cell"))
    gap = F.zip_with(F.zip_with("low2", "high", lambda x, y: x - y), F.zip_with("low", "high2", lambda x, y: x - y), lambda p, q: F.pow(F.greatest(p, q, F.lit(0.0)), 2))
    pairs = left.join(right, ["label", "d", "cell"]).filter("block < other").withColumn("gap", F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))
    pairs = pairs.filter(F.col("gap") <= epsilon * epsilon + SLACK).select("block", "other").distinct()
    # a block meets itself as one copy; two blocks as one of each
    pairs, vectors_of = scratch.cut(pairs, "pairs"), ("width", "ids", "copies", "raws")
    first = blocks.select("block", "d", *vectors_of)
    second = blocks.select(F.col("block").alias("other"), *[F.col(c).alias(f"{c}2") for c in vectors_of])
    met = pairs.join(first, "block").join(second, "other")
    alone = first.withColumn("other", F.col("block")).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in second.schema if f.name != "other"])
    met = met.unionByName(alone)
    met = scratch.cut(met.mapInPandas(_meet_blocks(axes, cosine, epsilon), "a long, b long, links long"), "met")

    links = met.filter("links > 0").groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links"))
    labels = components(met.filter("links = 0").select("a", "b"), scratch, "classes").select(F.col("id").alias("class_id"), F.col("label").alias("root"))
    known = classes.select("class_id", *names, "least", "copies").join(links, "class_id", "left").join(labels, "class_id", "left")
    known = scratch.cut(known.select(*names, "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "class_id").alias("root")), "known")
    least = scratch.cut(known.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    found = scratch.cut(known.join(least, "root").select(*names, "n_links", "component_id"), "named")
    linked = named.join(found, names).select("vec_id", "n_links", "component_id")
    alone = rows.filter("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
