"""Neighbours by pivots against all pairs, and how many block pairs clusters spare."""

import numpy as np
import pytest

from ledgerloom.operators.pivots import pruned_top_k
from ledgerloom.operators.vectors import top_k


def frames(spark, x, queries):
    corpus = spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    return corpus.repartition(3), corpus.filter(corpus.vec_id.isin(*queries)).select(corpus.vec_id.alias("query_id"), "embedding")


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_same_neighbours(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(12, 16)), 50, axis=0) + rng.normal(size=(600, 16)) * 0.05
    elif kind == "noise":
        x = rng.normal(size=(500, 8))
    else:
        x = np.repeat(rng.normal(size=(3, 4)), [300, 5, 40], axis=0)
    x = [*x, None, np.zeros(x.shape[1]), np.zeros(x.shape[1])]
    asked = [*range(0, len(x), 37), len(x) - 1]
    corpus, queries = frames(spark, x, asked)
    found = pruned_top_k(corpus, queries, 7, pivots=10, block=16, query_block=1 if kind == "clusters" else 4)
    assert rows(found.neighbours) == rows(top_k(corpus, queries, 7))
    seeds, compared, pairs = found.pairs.first()
    assert seeds + compared <= pairs
    if kind == "clusters":  # the zero query has to meet everything; the others hardly anything
        assert seeds + compared < pairs * 0.4


def test_few_and_none(spark):
    corpus, queries = frames(spark, [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]], [0, 2])
    assert rows(pruned_top_k(corpus, queries, 10).neighbours) == rows(top_k(corpus, queries, 10))
    assert pruned_top_k(corpus.limit(0), queries, 3).neighbours.count() == 0
    assert pruned_top_k(corpus, queries.limit(0), 3).neighbours.count() == 0
