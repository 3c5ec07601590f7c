import random
import re
import zlib

import numpy as np
import pyarrow as pa

from ledgerloom.llm import ngram_join as nj
from ledgerloom.llm.ngram_join import ngram_jaccard_join

SCHEMA = "doc_id long, text string, component_id string, n string"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows, k = [], 0
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 8, 20, 60, 150]))]
        for _ in range(r.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            rows.append((k, " ".join(t) if r.random() < 0.9 else " ".join(t).upper(), None, None))
            k += 1
    return rows


def group_of_near_copies(k, count, seed, edits):
    r = random.Random(seed)
    base = ["b%d" % i for i in range(60)]
    rows = []
    for i in range(count):
        t = list(base)
        for _ in range(r.choice(edits)):
            t[r.randrange(len(t))] = "e%d" % r.randrange(10**6)
        rows.append((k + i, " ".join(t), None, None))
    return rows


def test_against_brute_force(spark):
    rows = corpus(1) + [(5000, None, None, None), (5001, "", None, None), (5002, " \t\n", None, None), (5003, "one two", None, None), (5004, "One\x0btwo", None, None), (3, "repeated id with another text here now", None, None), (None, "null id of a text that nobody else has at all", None, None)]
    rows += rows[:4]
    got = sorted((tuple(x) for x in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_cells_of_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(nj, "LEAF_SETS", 12)
    rows = group_of_near_copies(0, 120, 5, [0, 1, 1, 2, 3, 4]) + group_of_near_copies(1000, 40, 6, [2, 3, 4]) + corpus(2, 15)[:20]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = sorted((tuple(x) for x in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_long(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join("x%d" % i for i in range(30000))
    got = {r.doc_id: r for r in ngram_jaccard_join(spark.createDataFrame([(1, long, None, None), (2, long + " y", None, None), (3, long[:1000], None, None)], SCHEMA)).collect()}
    assert got[2].component_id == 1 and got[3].component_id == 3 and got[1].n_shingles == 29996


def test_bound_never_falls_below_the_overlap():
    r = random.Random(9)
    for _ in range(50):
        w = ["q%d" % r.randrange(300) for _ in range(r.randint(5, 200))]
        v = w[: r.randrange(len(w))] + ["q%d" % r.randrange(300) for _ in range(r.randint(0, 50))]
        a, b = nj.shingle_set(" ".join(w)), nj.shingle_set(" ".join(v))
        import numpy as np

        assert np.minimum(nj.point(a), nj.point(b)).sum() >= len(np.intersect1d(a, b))


def test_meetings_lose_no_link():
    """Every linked pair shares enough coordinates, whatever the common order."""
    r = random.Random(11)
    for _ in range(400):
        n = r.randint(1, 60)
        a = r.sample(range(200), n)
        b = [x for x in a if r.random() < 0.9] + r.sample(range(200, 300), r.randint(0, 10))
        if not b:
            continue
        order = {x: r.random() for x in range(300)}
        sa, sb = (sorted(x, key=order.get) for x in (a, b))
        pa, pb = (s[: len(s) + (-75 * len(s) // 100) + 1] for s in (sa, sb))
        overlap, need = len(set(a) & set(b)), nj.needed_overlap(len(a), len(b), 75)
        assert (100 * overlap >= 75 * (len(a) + len(b) - overlap)) == (overlap >= need)
        if overlap >= need:
            shared = set(pa) & set(pb)
            first = min(shared, key=order.get)
            rest = max(len(a) - len(pa), len(b) - len(pb))
            assert len(shared) >= need - rest and min(len(a) - sa.index(first), len(b) - sb.index(first)) >= need
            assert rest == max(-(-75 * x // 100) - 1 for x in (len(a), len(b)))


def test_a_dense_group_and_a_licence_that_all_share(spark, monkeypatch):
    """Copies of which most pairs aren't linked (about 0.6 to 0.75), and unrelated texts with one long passage in common."""
    monkeypatch.setattr(nj, "LEAF_SETS", 16)
    r = random.Random(21)
    base = ["b%d" % i for i in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        for at in r.sample(range(120), r.choice([1, 2, 3, 3, 4, 4])):
            t[at] = "e%d" % r.randrange(10**6)
        rows.append((i, " ".join(t), None, None))
    licence = " ".join("licence%d" % i for i in range(60))
    rows += [(1000 + i, " ".join("own%d" % r.randrange(10**6) for _ in range(r.choice([0, 3, 12, 60, 200]))) + " " + licence, None, None) for i in range(120)]
    got = sorted((tuple(x) for x in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_overlaps_of_many():
    r = random.Random(4)
    s = nj.shingle_set(" ".join("a%d" % i for i in range(80)))
    others = [nj.shingle_set(" ".join("a%d" % (i + r.randrange(90)) if r.random() < 0.05 else "a%d" % i for i in range(r.randint(5, 100)))) for _ in range(40)]
    assert nj.overlaps(s, others) == [len(set(s.tolist()) & set(o.tolist())) for o in others] and nj.overlaps(s, []) == []


def test_levels_are_summed_row_by_row():
    """Counts of many tasks, cut into batches anywhere, give each segment's level once."""
    r = np.random.default_rng(3)
    parts = [(s, r.integers(0, 256, nj.SEGMENT).astype(np.uint8)) for s in (0, 0, 0, 2, 3, 3)]
    table = pa.table({"segment": pa.array([s for s, _ in parts], pa.int32()), "counts": [zlib.compress(c.tobytes()) for _, c in parts]})
    for size in (1, 2, 6):
        got = {row["segment"]: row["level"] for b in nj._levels(iter(table.to_batches(size))) for row in b.to_pylist()}
        for s in (0, 2, 3):
            total = sum(c.astype(float) for k, c in parts if k == s)
            assert got[s] == np.floor(4 * np.log2(total + 1)).astype(np.uint8).tobytes()
        assert sorted(got) == [0, 2, 3]
    assert not list(nj._levels(iter([])))
