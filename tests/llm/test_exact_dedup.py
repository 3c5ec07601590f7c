import hashlib
from collections import defaultdict

import numpy as np

from ledgerloom.llm.common import BITS
from ledgerloom.llm.exact_dedup import exact_dedup, filter_buckets, hit, places, repeated_bits

SCHEMA = "doc_id long, text string, kept string, group_size string"


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out, stays = [], set()
    for i, t, *_ in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        kept = (keep is None or i == keep) and (t or "") not in stays  # of rows that repeat the id, one
        stays |= {t or ""} if kept else set()
        out.append((i, keep, len(groups[t or ""]), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def test_against_brute_force(spark):
    rows = [(1, "a", "x", "y"), (2, "a", None, None), (3, "b", "", ""), (3, "b", "", ""), (4, None, "", ""), (5, "", "", ""), (None, "q", "", ""), (7, "A", "", ""), (8, "a ", "", ""), (9, "long " * 20000, "", ""), (10, "long " * 20000, "", "")]
    rows += [(100 + i, f"unique {i}", "", "") for i in range(300)] + [(1000 + i, "hot", "", "") for i in range(200)]
    got = [tuple(r) for r in exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()]
    got = [(a, b, c, bool(d), e) for a, b, c, d, e in got]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_bits(spark):
    keys = [int(x) for x in np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 4000)]
    keys += keys[:700] + [0, 0, -1, -1]  # keys of which both bits are the same too
    buckets = 4
    counts = np.zeros(buckets * BITS, dtype=int)
    for k in keys:
        for p in {(k % buckets) * BITS + (k >> 12) % BITS, (k % buckets) * BITS + (k >> 33) % BITS}:
            counts[p] += 1
    df = spark.createDataFrame([(k,) for k in keys], "key long").repartition(5)
    got = np.zeros(buckets * BITS, dtype=bool)
    for r in repeated_bits(df, buckets).collect():
        got[r.bucket * BITS : (r.bucket + 1) * BITS] = np.unpackbits(np.frombuffer(r.bits, dtype=np.uint8), bitorder="little")
    assert (got == (counts > 1)).all()
    once, twice = np.zeros(buckets * BITS // 8, dtype=np.uint8), np.zeros(buckets * BITS // 8, dtype=np.uint8)
    hit(once, twice, places(np.array(keys), buckets))
    assert (np.unpackbits(once, bitorder="little") == (counts > 0)).all() and [filter_buckets(n) for n in (0, 10**5, 10**9)] == [8, 128, 8192]
