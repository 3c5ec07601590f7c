"""Merges, identifiers, rules, documents and graph folds on small cases."""

import datetime as dt
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import ids, rules
from ledgerloom.functions.rules import Rule
from ledgerloom.operators import documents as d
from ledgerloom.operators import graph as g
from ledgerloom.operators import upsert as u


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "x string").select(expr.alias("v")).first().v


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k long, s string, w double")
    new = spark.createDataFrame([(2, None, 0.5), (3, "c", 2.0)], "k long, s string, w double")
    once = u.upsert(old, new, ["k"], {"s": "coalesce_new", "w": "greatest"})
    twice = u.upsert(once, new, ["k"], {"s": "coalesce_new", "w": "greatest"})
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a", 1.0), (2, "b", 0.5), (3, "c", 2.0)]
    with pytest.raises(ValueError):
        u.upsert(old, new, ["k"], {"s": "newest"})


def test_identifiers(spark):
    x = F.col("x")
    assert one(spark, ids.text_checksum(x), "　 a b \n") == hashlib.sha256(b"a b").hexdigest()
    assert one(spark, ids.uuid5(x), "key") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "key"))
    assert one(spark, ids.news_id(x), " t ") == "EV:" + hashlib.sha256(b"t").hexdigest()[:16]
    assert one(spark, ids.evidence_id(F.lit("t"), x, F.lit(0), F.lit("c")), None) == "EV:" + hashlib.sha256(b"t\n\n0\nc").hexdigest()


def test_first_rule_wins(spark):
    table = [Rule("半年度", "half"), Rule("年度", "annual"), Rule("问询", "inquiry", "skip")]
    hit = rules.first_match(F.col("x"), table, Rule("", "other", "skip"))
    assert one(spark, hit["label"], "2025半年度报告") == "half"
    assert one(spark, hit["label"], "2025年度报告") == "annual"
    assert one(spark, hit["action"], "关于问询函") == "skip"
    assert one(spark, hit["label"], "") == "other"


@pytest.mark.parametrize(("raw", "want"), [("sh.600000", "600000.SH"), ("000001", "000001.SZ"), ("600000.sh", "600000.SH"), ("830001", "830001.BJ"), ("x", None), ("600000.US", None)])
def test_codes(spark, raw, want):
    assert one(spark, rules.normalised_code(F.col("x")), raw) == want


def test_numbers_and_tokens(spark):
    assert one(spark, rules.unit_number(F.col("x")), "约3.5亿元") == 3.5e8
    assert one(spark, rules.unit_number(F.col("x")), "2万亿") == 2e12
    assert one(spark, rules.unit_number(F.col("x")), "none") is None
    assert one(spark, rules.estimated_tokens(F.col("x")), "中文ab") == 3
    assert one(spark, rules.polarity(F.col("x"), ["增长"], ["下滑"]), "增长后下滑") == "conflict"


def test_chapters_and_chunks(spark):
    docs = spark.createDataFrame([(1, "pre\n# One\na b\nc\n# Two\nd"), (2, ""), (3, "no heading")], "doc_id long, body string")
    got = {(r.doc_id, r.chapter, r.heading) for r in d.chapters(docs).collect()}
    assert got == {(1, 0, ""), (1, 1, "# One"), (1, 2, "# Two"), (3, 0, "")}
    assert [(r.idx, r.chunk, r.words) for r in d.chunks(docs.filter("doc_id = 1"), 3).orderBy("idx").collect()] == [(0, "pre\n# One", 3), (1, "a b\nc", 3), (2, "# Two\nd", 3)]
    assert d.chunks(docs.filter("doc_id = 2"), 3).count() == 0


def test_chunk_diff(spark):
    old = spark.createDataFrame([(1, 0, "a")], "doc long, idx int, hash string")
    new = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc long, idx int, hash string")
    assert [tuple(r) for r in u.chunk_diff(old, new).collect()] == [(1, 1, "added")]


def test_scd2_closes_and_merges(spark):
    rows = [("a", "b", dt.date(2026, 1, 1), 0.5, "x", "Claim", "e1"), ("a", "b", dt.date(2026, 1, 1), 0.7, "y", "Fact", "e2"), ("a", "b", dt.date(2026, 3, 1), 0.4, "z", "Estimate", "e3")]
    out = g.scd2(spark.createDataFrame(rows, "src string, dst string, valid_from date, weight double, text string, stmt_type string, evidence string")).orderBy("valid_from").collect()
    assert (out[0].weight, out[0].texts, out[0].stmt_type, out[0].evidence_ids, out[0].valid_to) == (0.7, ["x", "y"], "Fact", ["e1", "e2"], dt.date(2026, 2, 28))
    assert out[1].valid_to is None


def test_components_and_shortest_paths(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    assert {(r.id, r.root) for r in g.connected(chain).collect()} == {(i, 0) for i in range(21)} | {(100, 100), (101, 100)}
    edges = spark.createDataFrame([("a", "b", 1.0), ("c", "b", 1.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    pairs = spark.createDataFrame([("a", "d"), ("a", "c"), ("a", "x")], "src string, dst string")
    assert {tuple(r) for r in g.shortest_paths(edges, pairs, 3).collect()} == {("a", "d", 3), ("a", "c", 2)}


def test_feedback(spark):
    edges = spark.createDataFrame([("e", 0.9), ("f", 0.95)], "edge string, weight double")
    votes = spark.createDataFrame([("e", 1, "confirm", 0.0), ("e", 2, "reject", 0.0), ("f", 1, "correct", 0.1)], "edge string, seq int, kind string, value double")
    assert {(r.edge, r.after) for r in g.feedback(edges, votes).collect()} == {("e", 0.8), ("f", 0.5)}


def test_similar_names_equal_brute_force(spark):
    names = ["Nvidia Corp", "NVIDIA Corp.", "Nvidea Corp", "800G module", "400G module", "Innolight Tech", "Innolite Tech", "Semi Manufacturing"]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    digits = lambda s: "".join(c for c in s if c.isdigit())
    want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and digits(a) == digits(b) and distance(a.lower(), b.lower()) <= min(len(a), len(b)) // 4}
    assert {tuple(r) for r in g.similar_names(rows).collect()} == want and want
