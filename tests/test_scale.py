"""Steps that must grow no faster than their tables, and rules that leave nothing to chance."""

import datetime as dt
import itertools
import random
import re

import duckdb
from pyspark.sql import functions as F

from ledgerloom.operators import graph as g
from ledgerloom.operators import packages as p
from ledgerloom.operators import records as r
from ledgerloom.operators import rule_signals
from ledgerloom.operators import signals as signals_op
from ledgerloom.plans import registry, rule_queries
from ledgerloom.sources import tables as t

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_peers_shuffle_lists_and_no_pairs(spark):
    rows = [(a, d) for a in range(40) for d in range(30) if (a * 7 + d * d) % 5 < 2]
    edges = spark.createDataFrame(rows + rows[:9], "src long, dst long")
    targets = {a: {d for x, d in rows if x == a} for a in range(40)}
    shared = {(a, b): sorted(targets[a] & targets[b]) for a, b in itertools.permutations(range(40), 2)}
    peers, lists = g.peers(edges, 4), g.peer_lists(edges, 5)
    assert {tuple(r) for r in peers.collect()} == {(a, b, len(s)) for (a, b), s in shared.items() if a < b and len(s) >= 4}
    want = set()
    for a in range(40):
        near = sorted((b for b in range(40) if b != a and shared[a, b]), key=lambda b: (-len(shared[a, b]), b))[:5]
        want |= {(a, b, len(shared[a, b]), tuple(shared[a, b]), k) for k, b in enumerate(near, 1)}
    assert {(r.a, r.b, r.shared, tuple(r.products), r.place) for r in lists.collect()} == want
    assert not re.search(r"hashpartitioning\(a#\d+L?, b#", plan(peers))


def test_lists_of_a_target_are_bounded(spark):
    edges = spark.createDataFrame([(a, 1) for a in range(10)] + [(3, 2)], "src long, dst long")
    got = g._target_lists(edges, 4).collect()
    assert max(len(r.near) for r in got) == 4
    assert sorted(b for r in got if (r.src, r.dst) == (3, 1) for b in r.near) == list(range(10))


def test_first_statement_of_one_place_is_no_chance(spark):
    rows = [("C:1", "M:1", "Fact", 8, "约3亿"), ("C:1", "M:1", "Fact", 8, "约2亿"), ("C:1", "M:1", "Fact", 8, "没有"), ("C:1", "M:1", "Estimate", 9, "4亿"), ("C:1", "M:1", "Estimate", 9, "5亿")]
    for order in (rows, rows[::-1]):
        got = p.divergence(spark.createDataFrame(order, "entity string, metric string, stmt_type string, seq long, text string").coalesce(1)).first()
        assert (got.fact_value, got.estimate_value) == (2e8, 4e8)


def test_a_drop_of_four_fifths_is_no_alert_in_either(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(2 * k + i, day + dt.timedelta(hours=i), k, "view", v, "{}") for k in range(1, 300) for i, v in enumerate((5 * k / 100, k / 100))]
    rows += [(1000, day, 1000, "view", 5.0, "{}"), (1001, day + dt.timedelta(hours=1), 1000, "view", 0.99, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = [tuple(r) for r in registry.QUERIES["rd5_alerts"](spark, str(tmp_path)).collect()]
    assert got == con.execute(registry.ORACLE_SQL["rd5_alerts"]).fetchall() == [(1000, "record_drop")]


def test_chains_begin_at_few_edges(spark):
    rows = [("s", f"m{i:03d}", i / 1000) for i in range(200)] + [(f"m{i:03d}", f"t{j}", j / 100) for i in range(200) for j in range(30)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    first = g.first_hops(edges, edges, 5).collect()
    assert sorted(r.mid for r in first) == [f"m{i:03d}" for i in range(195, 200)]
    want = sorted(((-round(i / 1000 + j / 100, 4), 2, f"t{j}", f"m{i:03d}") for i in range(200) for j in range(30)))[:5]
    got = g.paths_to_two(edges, None, 5).filter("src = 's'").orderBy("rn").collect()
    assert [(-r.score, r.hops, r.dst, r.mid) for r in got] == want


def test_paths_meet_half_way(spark):
    # three hops from the left, and a thousand neighbours of the right end that the left one's walk never needs
    rows = [("a", "b"), ("b", "c"), ("d", "c"), ("e", "e")] + [("d", f"x{i}") for i in range(1000)]
    edges = spark.createDataFrame([(*r, 1.0) for r in rows], "src string, dst string, weight double")
    pairs = spark.createDataFrame([("a", "d"), ("a", "x7"), ("a", "a"), ("a", "e"), ("d", "a")], "src string, dst string")
    assert {tuple(r) for r in g.shortest_paths(edges, pairs, 6).collect()} == {("a", "d", 3), ("a", "x7", 4), ("d", "a", 3)}
    assert g.shortest_paths(edges, pairs, 2).count() == 0


def test_copies_of_names_are_no_pairs(spark):
    rows = [(i, n, "Company", s) for i, (n, s) in enumerate([("Acme 12 Ltd", None)] * 50 + [("Acme 12 Lt", None), ("天地科技", ["x"]), ("地天科技", ["x"]), ("天地科技", ["y"]), ("平", None), ("平", None), ("Zed", None)])]
    names = spark.createDataFrame(rows, "id long, name string, kind string, sectors array<string>")
    classes = g.entity_classes(names).collect()
    assert len(classes) == 49 + 2  # copies of the first name, its near one, and the two names of the same characters and sector
    first = {r.id: r.id for r in names.collect()} | {r.b: r.a for r in classes if r.link == "copy"}
    near = {(r.a, r.b) for r in classes if r.link == "near"}
    linked = {(a, b) for a in first for b in first if a < b and ((first[a] == first[b]) or (min(first[a], first[b]), max(first[a], first[b])) in near)}
    assert linked == {tuple(r) for r in g.entity_candidates(names).collect()}


def test_pairs_of_names_are_all_there(spark):
    rows = [(i, n, "Company", s) for i, (n, s) in enumerate([("Acme 12 Ltd", None)] * 9 + [("Acme 12 Lt", None), ("ACME 12 ltd", None), ("天地科技", ["x"]), ("地天科技", ["x"]), ("天地科技", ["y"]), ("平", None), ("平", None), ("Zed", None)])]
    names = spark.createDataFrame(rows, "id long, name string, kind string, sectors array<string>")
    for pairs, classes, want in ((g.entity_pairs, g._entity_classes(names, None), g.entity_candidates(names)), (g.similar_name_pairs, g._classes(names, F.lower("name"), g.similar_names), g.similar_names(names))):
        want = sorted(tuple(r) for r in want.collect())
        assert sorted(tuple(r) for r in pairs(names).collect()) == want and (0, 8) in want and (3, 9) in want
        assert sorted(tuple(r) for r in g._class_pairs(*classes, size=2).collect()) == want
    for name in ("kg6_similar_names", "kg6_entity_candidates"):
        assert registry.QUERIES[name](spark, SF).columns == ["a", "b"]
    # all pairs of the four spellings of one set of characters, not only those with the first
    names = spark.createDataFrame([(i, n, "Company", None) for i, n in enumerate(("天地科技", "地天科技", "科技天地", "技科天地"))], "id long, name string, kind string, sectors array<string>")
    assert sorted(tuple(r) for r in g.entity_pairs(names).collect()) == [(a, b) for a in range(4) for b in range(a + 1, 4)]


def test_tasks_of_edges_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(t, "TASK_ROWS", 100, raising=False)
    used = t.edges(spark, SF).filter("rel = 'USED_BY'").select("src", "dst", "weight")
    held = used.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    assert held[1] > 5_000 and held[0] < 600


def test_chains_by_part_exchange_lines_and_orders_only(spark):
    for name in ("kg9_two_hops_whole", "sg5_path_view_whole"):
        assert plan(registry.QUERIES[name](spark, SF)).count("Exchange hashpartitioning") <= 4
    into, out = t.part_edges(spark, SF)
    edges = t.edges(spark, SF).select("src", "dst", "weight")
    split = into.select("src", F.col("mid").alias("dst"), F.col("first").alias("weight")).union(out.select(F.concat(F.lit("P:"), "part"), "dst", "second"))
    assert split.exceptAll(edges).count() == 0 and split.count() == edges.count()


def test_best_paths_write_their_edges_once(spark):
    rows = [("s", f"m{i}", "SUPPLIES", 0.5 + i / 100) for i in range(6)] + [(f"m{i}", f"z{j}", "USED_BY", 0.2 + j / 10) for i in range(6) for j in range(3)]
    paths = g.detailed_paths(spark.createDataFrame(rows, "src string, dst string, rel string, weight double"), 4, F.col("src") == "s")
    assert "Scan ExistingRDD" not in plan(paths) and "FileScan" in plan(paths)
    got = {(tuple(r.nodes), tuple(r.rels), tuple(r.weights)) for r in paths.collect()}
    assert got == {(("s", m, "z2"), ("SUPPLIES", "USED_BY"), (w, 0.4)) for m, w in (("m5", 0.55), ("m4", 0.54), ("m3", 0.53), ("m2", 0.52))}


def test_documents_are_paired_without_a_join(spark):
    mentions = [(1, 9, 5), (1, 10, 5), (1, 9, 6), (2, 9, None), (2, 10, None), (None, 1, 1)]
    out = r.co_occurrences(spark.createDataFrame(mentions, "doc long, company long, product long"))
    assert {tuple(x) for x in out.collect()} == {(9, 10, "peer", 0.6, 2), (9, 5, "product", 0.7, 1), (9, 6, "product", 0.7, 1), (10, 5, "product", 0.7, 1), (10, 6, "product", 0.7, 1)}
    assert "Join" not in plan(registry.QUERIES["jn13_company_products"](spark, SF))


def test_signal_feed_keeps_all_cores_at_work(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rule_queries, "shared_folder", lambda *_: str(tmp_path / "feed"))
    registry.QUERIES["sm2_signal_stream"](spark, SF)
    assert len(list((tmp_path / "feed" / "in").glob("part-*.parquet"))) >= 2 * spark.sparkContext.defaultParallelism


def test_concept_figures_are_made_once_for_a_set(spark):
    assert re.search(r"min\(code#", plan(registry.QUERIES["jn6_scores_with_concepts"](spark, SF)))


def test_paths_through_parts_are_those_of_all_edges(spark):
    r = random.Random(13)
    weight = lambda: r.choice([0.5, 0.50004, 0.50008, 0.9, r.randrange(100) / 100])
    into = [(p, c, weight()) for c in range(12) for p in range(60) if r.random() < 0.6] + [(7, None, 0.8), (None, 3, 0.95), (None, None, 0.7)]
    # parts from 45 have no edges out, and customers 100 to 139 give part 0 and part 1 many ties
    out = [(p, u, weight()) for p in range(45) for u in range(30) if r.random() < 0.4] + [(p, u, 0.9) for p in (0, 1) for u in range(100, 140)] + [(None, 5, 0.9), (None, 6, 0.1)]
    into, out = spark.createDataFrame(into, "part long, of long, first double"), spark.createDataFrame(out, "part long, to long, second double")
    kinds = {"of": "C:", "part": "P:", "to": "U:"}
    name = lambda kind, number: F.concat(F.lit(kinds[kind]), number)
    edges = into.select(name("of", F.col("of")).alias("src"), name("part", F.col("part")).alias("dst"), F.col("first").alias("weight"))
    edges = edges.union(out.select(name("part", F.col("part")), name("to", F.col("to")), "second"))
    got = g.paths_through(into, out, 20, 4, name)
    want = g.paths_to_two(edges, None, 20).select(got.columns)
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.filter("src is null and hops = 2").count() and got.filter("src is null and hops = 1").count() == 4


def test_detailed_paths_through_parts_write_no_edges(spark):
    r = random.Random(31)
    weight = lambda: r.choice([0.5, 0.50004, 0.50008, 0.9, r.randrange(100) / 100])
    into = [(p, c, weight()) for c in range(9) for p in range(50) if r.random() < 0.6] + [(7, None, 0.8), (None, 3, 0.95), (None, None, 0.7)]
    out = [(p, u, weight()) for p in range(40) for u in range(25) if r.random() < 0.4] + [(0, u, 0.9) for u in range(100, 130)] + [(None, 5, 0.9), (3, None, 0.9)]
    into, out = spark.createDataFrame(into, "part long, of long, first double"), spark.createDataFrame(out, "part long, to long, second double")
    kinds = {"of": "C:", "part": "P:", "to": "U:"}
    name = lambda kind, number: F.concat(F.lit(kinds[kind]), number)
    edges = into.select(name("of", F.col("of")).alias("src"), name("part", F.col("part")).alias("dst"), F.lit("SUPPLIES").alias("rel"), F.col("first").alias("weight"))
    edges = edges.union(out.select(name("part", F.col("part")), name("to", F.col("to")), F.lit("USED_BY"), "second"))
    got = g.detailed_paths_through(into, out, 20, 4, name, ("SUPPLIES", "USED_BY"))
    want = g.detailed_paths(edges, 20, F.col("src").startswith("C:"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect())) and got.count() == 180
    for query in ("sg4_path_signals", "jn8_signal_details", "sg5_paths", "kg20_path_edge_scores"):
        assert "/graph-" not in plan(registry.QUERIES[query](spark, SF))


def test_propagation_through_parts_exchanges_no_chains(spark):
    r = random.Random(17)
    weight = lambda: r.randrange(101) / 100
    into = [(p, c, weight()) for c in range(9) for p in range(50) if r.random() < 0.6] + [(7, None, 0.8), (None, 3, 0.25), (None, 4, 0.95), (None, None, 0.7)]
    out = [(p, u, weight()) for p in range(40) for u in (*range(24), 65535, 65536, 2**40 + 7, -3) if r.random() < 0.4] + [(None, 5, 0.9), (3, None, 0.4)]
    signals = spark.createDataFrame([(i, i % 12, 10.0 * (i % 9), 0.5 + i % 5 / 10) for i in range(30)], "signal_id long, subject long, strength double, source_confidence double")
    into, out = spark.createDataFrame(into, "part long, of long, first double"), spark.createDataFrame(out, "part long, to long, second double")
    kinds = {"of": "C:", "part": "P:", "to": "U:"}
    name = lambda kind, number: F.concat(F.lit(kinds[kind]), number)
    edges = into.select(name("of", F.col("of")).alias("src"), name("part", F.col("part")).alias("dst"), F.col("first").alias("weight")).union(out.select(name("part", F.col("part")), name("to", F.col("to")), "second"))
    want = signals_op.graph_propagation(signals.withColumn("subject", name("of", F.col("subject"))), edges)
    told = lambda df: sorted((x.signal_id, x.target or "", x.hops, round(x.confidence, 9)) for x in df.collect())
    for size in (1024, 3):
        got = signals_op.propagation_through(signals, into, out, 4, name, size)
        assert told(got) == told(want) and any(not x[1] for x in told(got))
    whole = registry.QUERIES["sg4_graph_propagation_whole"](spark, SF)
    # lines by part, lines and orders by order, their join by part, lists by source, signals by subject
    assert plan(whole).count("Exchange hashpartitioning") <= 7 and not re.search(r"hashpartitioning\(src#", plan(whole))


def test_lists_of_peers_are_exchanged_once(spark):
    lists = registry.QUERIES["kg13_peer_lists"](spark, SF)
    lists.collect()
    done = plan(lists).split("== Initial Plan ==")[0]
    dealt = [x for x in done.splitlines() if re.search(r"Exchange hashpartitioning\(a#\d+L?, \d+\), REPARTITION_BY_NUM", x)]
    assert len(dealt) == len([x for x in dealt if "Reused" in x]) + 1 and any("Reused" in x for x in done.splitlines())


def _signals_and_paths(spark):
    kinds = ("risk", "order", "policy", "other")
    signals = [(f"s{i}", f"c{i % 7}", kinds[i % 4], ("positive", "risk")[i % 3 == 0], i, i / 40) for i in range(40)]
    paths = [(f"c{c}", [f"c{c}", f"p{k}", f"u{k % 3}"][: 2 + k % 2], ["SUPPLIES", "USED_BY"][: 1 + k % 2], [k / 10, 0.5][: 1 + k % 2]) for c in range(6) for k in range(8)]
    signals = spark.createDataFrame(signals + signals[:5], "signal_id string, subject string, kind string, polarity string, strength int, confidence double")
    return signals, spark.createDataFrame(paths + paths[:9], "subject string, nodes array<string>, rels array<string>, weights array<double>")


def test_propagations_are_not_exchanged(spark):
    signals, paths = _signals_and_paths(spark)
    spread = rule_signals.path_propagation(signals, paths)
    rows = spread.collect()
    # signal 6 of 7 has no path; each other one counts once, and so does each path
    assert len(rows) == len({(r.signal_id, r.target, r.relation_path) for r in rows}) == 8 * sum(i % 7 < 6 for i in range(40))
    assert not re.search(r"Exchange hashpartitioning\(signal_id[^)]*relation_path", plan(spread))


def test_details_are_made_from_a_list_of_paths(spark):
    signals, paths = _signals_and_paths(spark)
    stated = lambda c: F.round(c, 1)
    got = rule_signals.path_details(signals, paths, stated)
    spread = rule_signals.path_propagation(signals, paths)
    want = p.signal_details(signals.select("signal_id", "kind").distinct(), spread.withColumn("confidence", stated(F.col("confidence"))))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 40
    assert "explode" not in plan(got).lower() and not re.search(r"Exchange hashpartitioning\(signal_id[^)]*\), (?!ENSURE)", plan(got))


def test_best_paths_of_all_nodes_exchange_lines_and_sources_only(spark):
    paths = registry.QUERIES["kg10_best_paths_whole"](spark, SF)
    paths.collect()
    done = plan(paths).split("== Initial Plan ==")[0]
    assert "/graph-" not in done
    exchanges = [line for line in done.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    # lines by part, lines and orders by order, their join by part, edges into parts by source, the chosen by part and by source
    assert 1 < len(exchanges) <= 7 + 2  # two of them of the lines without a part


def test_heaviest_edges_are_ranked_where_their_lines_are(spark):
    top = t.heaviest_edges(spark, SF, 3)
    # lines by supplier, lines and orders by order, their join by part: as many tasks as the lines need, and no exchange of edges
    assert plan(top).count("Exchange hashpartitioning") == plan(top).count("REPARTITION_BY_NUM") == 4
    want = g.heaviest(t.edges(spark, SF).select("src", "dst", "weight"), 3).drop("rn")
    assert top.exceptAll(want).count() == 0 and top.count() == want.count() > 500


def test_steps_of_a_walk_are_dealt_as_the_edges_need(spark, monkeypatch):
    monkeypatch.setattr(t, "TASK_ROWS", 100)
    plans, cut = [], g.cut
    monkeypatch.setattr(g, "cut", lambda df: plans.append(plan(df)) or cut(df))
    rows = [(f"a{i}", f"b{(i * j) % 300}") for i in range(300) for j in range(1, 5)] + [(f"b{i}", f"c{i % 200}") for i in range(300)]
    edges = spark.createDataFrame(rows, "src string, dst string").withColumn("weight", F.lit(1.0))
    seeds = spark.createDataFrame([(f"a{i}",) for i in range(1, 300)], "id string")
    want = {f"a{i}": 0 for i in range(1, 300)} | {b: 1 for a, b in rows if a[0] == "a" and a != "a0"}
    want |= {c: 2 for b, c in rows if want.get(b) == 1}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for most in (limit, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            plans.clear()
            assert {r.id: r.hops for r in g.reach(edges, seeds, 3).collect()} == want
            steps = [p for p in plans if "Join" in p]
            dealt = [int(n) for p in steps for n in re.findall(r"Exchange hashpartitioning\([^)]*, (\d+)\)", p)]
            assert len(steps) == 3 and dealt and set(dealt) == {15}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
