"""Packages, divergence, details, work lists, searches and folds against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerloom.operators import graph as g
from ledgerloom.operators import packages as p
from ledgerloom.operators.folds import lag_in_blocks, sorted_fold
from ledgerloom.operators.search import entity_search, holding, resolved


def test_stated_values(spark):
    rows = [("120亿",), ("约 1.5 万亿元",), ("3万",), ("7元",), ("没有",), (None,), ("第2季度 9亿",), ("8百",)]
    got = [x for (x,) in spark.createDataFrame(rows, "t string").select(p.stated_value(F.col("t"))).collect()]
    assert got == [1.2e10, 1.5e12, 3e4, 7.0, None, None, 2.0, 8.0]


def test_divergence(spark):
    rows = [("C", "m", "Fact", "未披露", 1), ("C", "m", "Fact", "100亿", 3), ("C", "m", "Fact", "90亿", 2), ("C", "m", "Estimate", "135亿", 5), ("C", "m", "Claim", "x", 1), ("C", "k", "Claim", "5亿", 1), ("D", "m", "Fact", "0", 1), ("D", "m", "Estimate", "1", 1), ("D", "n", "Estimate", None, 1)]
    got = {(r.entity, r.metric): (r.facts, r.estimates, r.claims, r.fact_value, r.gap_pct, r.direction) for r in p.divergence(spark.createDataFrame(rows, "entity string, metric string, stmt_type string, text string, seq int")).collect()}
    assert got == {("C", "m"): (3, 1, 1, 9e9, 50.0, "bullish"), ("D", "m"): (1, 1, 0, 0.0, None, None), ("D", "n"): (0, 1, 0, None, None, None)}


def test_material(spark):
    day = dt.date(2026, 1, 1)
    rows = [("s", day + dt.timedelta(days=i % 9), i, f"q{i}", None if i == 80 else "a" * 400) for i in range(90)] + [("t", day, 1, None, "short")]
    got = {r.k: r for r in p.material_package(spark.createDataFrame(rows, "k string, day date, seq int, question string, answer string"), "k", "day", "seq").collect()}
    assert got["s"].pairs == 50 and len(got["s"].material) == 50 and got["s"].last_day == dt.date(2026, 1, 9)
    newest = sorted((r for r in rows if r[0] == "s"), key=lambda r: (r[1], r[2]), reverse=True)[:50]
    assert [m.question for m in got["s"].material] == [r[3] for r in newest] and got["s"].first_day == min(r[1] for r in newest)
    assert {len(m.answer) for m in got["s"].material} == {0, 300} and got["t"].material[0].question == ""


def test_details(spark):
    signals = spark.createDataFrame([(1, "a"), (2, "b")], "signal_id int, kind string")
    spread = spark.createDataFrame([(1, "x", "p", "d", 0.2), (1, "y", "p", "d", 0.9), (1, "a", "p", "d", 0.2)], "signal_id int, target string, relation_path string, direction string, confidence double")
    got = {r.signal_id: [x.target for x in r.propagations] for r in p.signal_details(signals, spread).collect()}
    assert got == {1: ["y", "a", "x"], 2: []}


def test_vector_work(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    attempts = spark.createDataFrame([(1, 1, False), (2, 1, True), (2, 2, False), (3, 1, False), (3, 2, False), (3, 3, False), (4, 1, False), (4, 2, True), (9, 1, False)], "id long, seq long, ok boolean")
    got = sorted(tuple(r) for r in p.vector_work(ids(1, 2, 3, 4, 5, 6), ids(6), attempts).collect())
    assert got == [(1, "retry", 1), (2, "retry", 1), (3, "give_up", 3), (4, "index", 1), (5, "index", 0)]
    assert p.vector_work(ids(1).limit(0), ids(6), attempts).count() == 0


def test_holding_and_resolving(spark):
    rng = random.Random(7)
    names = ["".join(rng.choice("ab#0") for _ in range(rng.randint(0, 9))) for _ in range(80)]
    asked = ["".join(rng.choice("ab#0") for _ in range(rng.randint(1, 5))) for _ in range(60)] + ["zzz", "abz"]
    texts = spark.createDataFrame(list(enumerate(names)), "id int, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, low string")
    got = sorted((r.query_id, r.id) for r in holding(texts, queries).select("query_id", "id").collect())
    assert got == sorted((i, j) for i, q in enumerate(asked) for j, n in enumerate(names) if q in n)
    people = spark.createDataFrame([(7, "x7"), (12, "seven 7"), (3, "7")], "id long, name string")
    wants = [(1, "7"), (2, "x7"), (3, "eve"), (4, "no"), (5, ""), (6, None), (7, "12")]
    found = {r.query_id: (r.id, r.score) for r in resolved(people, spark.createDataFrame(wants, "query_id int, query string")).collect()}
    assert found == {1: (7, 1.0), 2: (7, 0.9), 3: (12, 0.7), 7: (12, 1.0)}


def test_search_by_a_beginning_that_all_share(spark):
    entities = spark.createDataFrame([(f"C:{i}", f"60{i:04d}.SH", f"Supplier#{i:05d}", None, 1) for i in range(200)], "id string, code string, name string, aliases array<string>, rank int")
    queries = spark.createDataFrame([(1, "supplier#00017"), (2, "C:5"), (3, "#0019")], "query_id int, query string")
    got = entity_search(entities, queries, 3).collect()
    assert [r.id for r in got if r.query_id == 1] == ["C:17"] and [r.id for r in got if r.query_id == 2] == ["C:5"]
    assert sorted(r.id for r in got if r.query_id == 3) == ["C:190", "C:191", "C:192"]


def test_folds(spark):
    rows = [(k, i) for k in (1, 2, None) for i in range(1000)]
    frame = spark.createDataFrame(rows, "k long, i long").repartition(5)
    got = sorted_fold(frame, "k", ["i"], "k long, last long, n long, rising boolean", lambda: (-1, 0, True), lambda s, r: (r["i"], s[1] + 1, s[2] and r["i"] > s[0]), lambda s: s).collect()
    assert sorted(map(str, got)) == sorted(f"Row(k={k}, last=999, n=1000, rising=True)" for k in (1, 2, None))
    votes = spark.createDataFrame([(1, i, "confirm", 0.0) for i in range(30)] + [(2, 1, "correct", 0.1), (2, 2, "reject", 0.0), (9, 1, "confirm", 0.0)], "edge long, seq int, kind string, value double")
    edges = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.4)], "edge long, weight double")
    assert sorted(tuple(r) for r in g.feedback(edges, votes).collect()) == [(1, 0.5, 1.0), (2, 0.9, 0.35)]


def test_lag_across_blocks_equals_one_window(spark):
    """Blocks of any size, gaps, negative numbers, a null key and an empty table: as one window for each key."""
    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), i, f"v{r.randint(0, 9)}") for i in r.sample(range(-400, 400), 300)] + [("once", 5000, "v")]
    df, last, want = spark.createDataFrame(rows, "key string, at long, value string"), {}, set()
    for key, at, value in sorted(rows, key=lambda x: x[1]):
        want.add((key, at, value, last.get(key)))
        last[key] = value
    for block in (1, 7, 1 << 16):
        got = lag_in_blocks(df, "key", "at", "value", "before", block).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert not lag_in_blocks(df.limit(0), "key", "at", "value", "before").collect()
