"""Spans, compliance, query analysis and dictionary tags against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import query_rules as r
from ledgerloom.functions.spans import leftmost_longest, merged, replaced, spans
from ledgerloom.operators import text_scans as s


def made(seed, n=200):
    rng = random.Random(seed)
    bits = ["买入", "建议买入", "强烈推荐买入", "卖", "目标价位", "有望", "未公开", "风险提示", "或将", "一", "ab", "，", "仅供参考", "内幕消息", "第一目标", ""]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def plain_compliance(text):
    found = [(m.start(), m.end(), name) for pattern, name in r.FORBIDDEN for m in re.finditer(pattern, text)]
    hit = [False] * len(text)
    out, at = [], 0
    islands = []
    for a, b, _ in sorted(found):
        if islands and a <= islands[-1][1]:
            islands[-1][1] = max(islands[-1][1], b)
        else:
            islands.append([a, b])
    for a, b in islands:
        out += [text[at:a], r.REDACTED]
        at = b
    left = "".join(out) + text[at:]
    count = lambda rules, of: [(name, of(pattern, name)) for pattern, name in rules if of(pattern, name)]
    return not found, count(r.FORBIDDEN, lambda _, n: sum(x[2] == n for x in found)), count(r.WARNINGS, lambda p, _: len(re.findall(p, left))), left


def test_compliance(spark):
    texts = [*made(1), "", None, "建议买入目标价", "强烈推荐买入买入做多", "目标价位", "没有问题", "🙂买🙂"]
    rows = s.compliance(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        got = (row.passed, [tuple(v) for v in row.violations], [tuple(v) for v in row.warnings], row.redacted)
        assert got == plain_compliance(text or ""), text
    once = s.compliance(spark.createDataFrame([(1, "建议买入目标价，强烈推荐买入")], "doc_id int, text string")).first()
    assert once.redacted == "[已脱敏]，[已脱敏]" and [tuple(v) for v in once.violations] == [("禁止买卖建议", 1), ("禁止买卖信号", 2), ("禁止目标价", 1)]


def test_spans(spark):
    rows = spark.createDataFrame([("aXbbXc",), ("X",), ("",), ("none",), ("XX",), ("中X文",)], "t string")
    got = [[(x.start, x.end, x.text) for x in q[0]] for q in rows.select(spans(F.col("t"), "X", "k")).collect()]
    assert got == [[(1, 2, "X"), (4, 5, "X")], [(0, 1, "X")], [], [], [(0, 1, "X"), (1, 2, "X")], [(1, 2, "X")]]
    both = F.concat(spans(F.col("t"), "ab|b+", "one"), spans(F.col("t"), "abb|bX", "two"))
    row = spark.createDataFrame([("abbbX-b",)], "t string").select(leftmost_longest(both).alias("l"), merged(both).alias("m"), replaced(F.col("t"), merged(both), "#").alias("r")).first()
    assert [(x.start, x.end, x.kind) for x in row.l] == [(0, 3, "two"), (3, 5, "two"), (6, 7, "one")]
    assert [tuple(x) for x in row.m] == [(0, 5), (6, 7)] and row.r == "#-#"


def analysed(spark, *queries):
    frame = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    return s.query_analysis(frame).orderBy("query_id").collect()


@pytest.mark.parametrize(
    "query,entities,kind,intent,strategy",
    [
        ("查询300750.SZ的供应商", {"300750.SZ"}, "entity_relation", "find_relations", "relation"),
        ("贵州茅台的供应商有哪些", {"贵州茅台"}, "entity_relation", "find_relations", "relation"),
        ("新能源行业现状", {"新能源"}, "industry_state", "assess_state", "entity"),
        ("茅台和五粮液的关系", {"茅台", "五粮液"}, "path_finding", "find_path", "path"),
        ("随便问点什么", set(), "entity_search", "find_entity", "entity"),
        ("宁德时代和比亚迪在锂电产业链的关系", {"宁德时代", "比亚迪", "锂电"}, "path_finding", "find_path", "path"),
        ("", set(), "entity_search", "find_entity", "entity"),
        (None, set(), "entity_search", "find_entity", "entity"),
    ],
)
def test_queries(spark, query, entities, kind, intent, strategy):
    (row,) = analysed(spark, query)
    assert entities <= set(row.entities) and (row.query_type, row.intent, row.strategy) == (kind, intent, strategy)
    assert all((query or "")[x.start : x.end] == x.text for x in row.spans)


def plain_entities(q):
    found = [(m.start(), m.end(), m[0]) for p in (r.CODE, r.COMPANY, r.INDUSTRY) for m in re.finditer(p, q)]
    once = [x for i, x in enumerate(found) if x[2] not in {y[2] for y in found[:i]}]
    names, taken = [x[2] for x in once], [x[:2] for x in once]
    c = re.search(r.CONNECTOR, q)
    if c:
        left, right = re.search(r.LEFT_NAME, q[: c.start()]), re.match(r.RIGHT_NAME, q[c.end() :])
        if left and right and len(right[1]) >= 2:
            names += [left[0], right[1]]
            taken.append((left.start(), c.end() + right.end()))
    for m in re.finditer(r.OWNER, q):
        if not re.search("[和与跟]", m[0][:-1]) and not any(m.start() < e and m.end() - 1 > s for s, e in taken):
            names.append(m[0][:-1])
    return list(dict.fromkeys(names))


def test_entities_against_plain_python(spark):
    rng = random.Random(4)
    bits = ["茅台", "五粮液", "和", "与", " 跟 ", "的", "的", "600000.SH", "隆基股份", "光伏", "AI", "供应商", "关系", "x", "？", "白酒", "了"]
    queries = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(300)]
    for row, q in zip(analysed(spark, *queries), queries, strict=True):
        assert row.entities == plain_entities(q), q
        assert all(q[x.start : x.end] == x.text for x in row.spans)
        assert all(x.end <= y.start for x, y in zip(row.spans, row.spans[1:])) and {x.text for x in row.spans} <= set(row.entities)


@pytest.mark.parametrize("shard", [2_000_000, 40])
def test_dictionary_tags(spark, shard):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abc中") for _ in range(rng.randint(1, 4))) for _ in range(60)}) + ["", None, "ab", "ab"]
    texts = ["".join(rng.choice("abc中d") for _ in range(rng.randint(0, 15))) for _ in range(100)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = s.dictionary_tags(docs, spark.createDataFrame([(n,) for n in names], "name string"), "doc_id", "text", shard).collect()
    want = [(i, n) for i, t in enumerate(texts) for n in {n for n in names if n} if n in (t or "")]
    assert sorted(tuple(x) for x in got) == sorted(want)
    assert s.dictionary_tags(docs, spark.createDataFrame([], "name string"), "doc_id", "text").count() == 0
