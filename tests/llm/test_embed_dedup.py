import math

import numpy as np

from ledgerloom.llm import embed_dedup as ed
from ledgerloom.llm.embed_dedup import embedding_near_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def unit(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
        return None
    x = np.array(v, dtype=np.float32).astype(np.float64)
    return x / np.linalg.norm(x)


def brute(rows):
    us, n = [unit(r[1]) for r in rows], len(rows)
    up, links = list(range(n)), [0] * n

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if us[i] is not None and us[j] is not None and len(us[i]) == len(us[j]) and rows[i][2] is not None and rows[i][2] == rows[j][2] and us[i] @ us[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], least.get(find(i)), least.get(find(i)) is None or r[0] == least.get(find(i))) for i, r in enumerate(rows)), key=str)


def make(seed, n=150, d=16):
    g = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = g.normal(size=d)
        for k in range(int(g.choice([1, 1, 2, 5]))):
            v = c + g.normal(size=d) * g.choice([0, 0.1, 0.15, 0.2])
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(g.integers(3)), None))
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 32)
    monkeypatch.setattr(ed, "SQUARE", 8)
    rows = make(4)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 15 + [None], [1.0, 2.0], [2.0, 4.0]]
    rows += [(2000 + i, v, 1, "x") for i, v in enumerate(odd)] + [(3000, rows[0][1], None, "x"), (3001, rows[0][1], None, "x"), rows[1], (None, rows[2][1], rows[2][2], "x")]
    rows += [(4000 + i, rows[5][1], rows[5][2], None) for i in range(50)]
    got = sorted((tuple(r) for r in embedding_near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert embedding_near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_vectors_wider_than_the_covariance(spark):
    """Axes among the first components only lose no pair, and add up over tasks as one matrix does."""
    rows = make(4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = sorted((tuple(r) for r in embedding_near_dedup(df, wide=5).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == brute(rows)
    x = np.array([u for r in rows if (u := unit(r[1])) is not None and len(u) == 16])
    raw = spark.createDataFrame([(16, bytearray(u.astype("<f8").tobytes())) for u in x], "d int, raw binary").repartition(5)
    axes = ed.principal_axes(raw, 5)[16]
    assert axes.shape == (16, 5) and not axes[5:].any()
    assert np.allclose(np.linalg.eigvalsh(np.cov(x[:, :5].T, bias=True))[::-1], ((x - x.mean(axis=0)) @ axes).var(axis=0))


def test_a_very_long_vector(spark):
    long = [1.0] + [0.0] * 199_999
    rows = [(1, long, 1, None), (2, long, 1, None), (3, [0.0, *long[:-1]], 1, None), (4, [1.0, 0.0], 1, None)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}
