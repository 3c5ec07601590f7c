"""Merges into bucketed tables: rows, files that stay, replays and merges that break off."""

import hashlib
import os

import pytest

from ledgerloom.operators.store import Conflict, TableSet
from ledgerloom.operators.upsert import upsert

SCHEMA = "id long, kind string, score double, note string"


def files(folder):
    out = {}
    for d, _, names in os.walk(os.path.join(folder, "data")):
        for n in names:
            if n.startswith("part-"):
                with open(os.path.join(d, n), "rb") as f:
                    out[os.path.join(d, n)] = hashlib.sha256(f.read()).hexdigest()
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merges(spark, tmp_path):
    store = TableSet(spark, f"file://{tmp_path}/s")
    old = spark.createDataFrame([(i, "a", float(i), None) for i in range(100)], SCHEMA)
    new = spark.createDataFrame([(5, "b", 1.0, "x"), (6, "b", 99.0, None), (200, "c", 2.0, None)], SCHEMA)
    policies = {"kind": "keep_old", "score": "greatest", "note": "coalesce_new"}
    assert store.table("t") is None and store.manifest()["version"] == 0
    assert store.merge({"t": (old, ["id"], policies, "take_new")}, buckets=8) == 1
    before, entry = files(f"{tmp_path}/s"), store.manifest()["tables"]["t"]
    assert store.merge({"t": (new, ["id"], policies, "take_new")}) == 2
    assert rows(store.table("t")) == rows(upsert(old, new, ["id"], policies))
    after, now = files(f"{tmp_path}/s"), store.manifest()["tables"]["t"]
    assert all(after[f] == h for f, h in before.items())
    moved = [b for b in now["at"] if now["at"][b] != entry["at"].get(b)]
    assert 1 <= len(moved) <= 3 and len(now["at"]) == 8
    # once more: nothing changes, and no version comes of it
    assert store.merge({"t": (new, ["id"], policies, "take_new")}) == 2 and store.manifest()["tables"]["t"] == now
    # an older version can still be read
    assert rows(store.table("t", {"tables": {"t": entry}})) == rows(old)
    assert store.merge({"t": (new.limit(0), ["id"], {}, "take_new")}) == 2


def test_new_keys_are_added_and_nothing_is_rewritten(spark, tmp_path):
    store = TableSet(spark, f"file://{tmp_path}/s")
    batch = lambda a, b: spark.createDataFrame([(i, f"g{i % 5}", float(i), None) for i in range(a, b)], SCHEMA)
    merge = lambda a, b: store.merge({"t": (batch(a, b).repartition(4, "kind"), ["id"], {}, "keep_old", ["kind"])}, buckets=4)
    assert merge(0, 100) == 1
    first = files(f"{tmp_path}/s")
    assert len(first) == len(store.manifest()["tables"]["t"]["at"])  # a bucket comes from one task
    assert merge(100, 200) == 2
    assert len(files(f"{tmp_path}/s")) == 2 * len(first)  # as many files again: no old row is written once more
    assert rows(store.table("t")) == rows(batch(0, 200))
    assert merge(150, 160) == 2  # known rows change nothing
    for k in range(2, 12):
        merge(k * 100, k * 100 + 100)
    assert rows(store.table("t")) == rows(batch(0, 1200))
    assert max(len(at) for at in store.manifest()["tables"]["t"]["at"].values() if isinstance(at, list)) <= 8


def test_insert_only_and_null_keys(spark, tmp_path):
    store = TableSet(spark, f"file://{tmp_path}/s")
    a = spark.createDataFrame([(1, "a", 1.0, None), (None, "n", 0.0, None)], SCHEMA)
    b = spark.createDataFrame([(1, "z", 9.0, "z"), (2, "b", 2.0, None), (None, "m", 5.0, None)], SCHEMA)
    store.merge({"t": (a, ["id"], {}, "keep_old")}, buckets=4)
    store.merge({"t": (b, ["id"], {}, "keep_old")})
    assert sorted((r.id or 0, r.kind) for r in store.table("t").collect()) == [(0, "n"), (1, "a"), (2, "b")]


def test_batches_once(spark, tmp_path):
    store = TableSet(spark, f"file://{tmp_path}/s")
    batch = lambda k, score: (spark.createDataFrame([(k, "a", score, None)], SCHEMA), ["id"], {}, "take_new")
    assert store.merge({"t": batch(1, 1.0), "u": batch(1, 1.0)}, "s", 0, 4) == 1
    assert store.merge({"t": batch(1, 2.0), "u": batch(1, 2.0)}, "s", 0, 4) == 1  # a replay
    assert rows(store.table("t")) == [(1, "a", 1.0, None)]
    held = TableSet._stage
    calls = []

    def breaks(self, name, *rest):
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("killed between the tables")
        return held(self, name, *rest)

    TableSet._stage = breaks
    try:
        with pytest.raises(RuntimeError):
            store.merge({"t": batch(2, 5.0), "u": batch(2, 5.0)}, "s", 1, 4)
    finally:
        TableSet._stage = held
    again = TableSet(spark, f"file://{tmp_path}/s")
    assert rows(again.table("t")) == rows(again.table("u")) == [(1, "a", 1.0, None)] and again.manifest()["streams"] == {"s": 0}
    assert again.merge({"t": batch(2, 5.0), "u": batch(2, 5.0)}, "s", 1, 4) == 2
    assert rows(again.table("t")) == rows(again.table("u")) == [(1, "a", 1.0, None), (2, "a", 5.0, None)]


def test_two_writers(spark, tmp_path):
    store = TableSet(spark, f"file://{tmp_path}/s")
    store._commit({"version": 1, "streams": {}, "tables": {}})
    with pytest.raises(Conflict):
        store._commit({"version": 1, "streams": {}, "tables": {}})
