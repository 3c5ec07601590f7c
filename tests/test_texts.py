"""Headings, stages, rules and name search on small cases in the languages that they are for."""

import random

from pyspark.sql import functions as F

from ledgerloom.functions import rules, signal_rules, stages
from ledgerloom.operators import headings, rule_signals
from ledgerloom.operators import stages as stage_moves
from ledgerloom.operators.search import entity_search


def texts(spark, rows, column="body"):
    return spark.createDataFrame(list(enumerate(rows)), f"doc_id int, {column} string")


def test_headings_of_several_styles(spark):
    cases = {
        "一、公司简介\n公司成立于2000年\n\n二、主要业务\n主营业务包括...": [("公司简介", 1, "公司成立于2000年"), ("主要业务", 1, "主营业务包括...")],
        "一、概况\n内容1\n\n第一节 业务\n内容2\n\n二、财务\n内容3": [("概况", 1, "内容1\n\n第一节 业务\n内容2"), ("财务", 1, "内容3")],
        "1. 概况\n内容1\n\n1.1 业务\n内容2\n\n1.2 人员\n内容3\n\n2. 财务\n内容4": [("概况", 1, "内容1"), ("1 业务", 1, "内容2"), ("2 人员", 1, "内容3"), ("财务", 1, "内容4")],
        "# 公司简介\n公司成立于2000年\n\n## 主要业务\n主营业务包括...": [("公司简介", 1, "公司成立于2000年"), ("主要业务", 2, "主营业务包括...")],
        "这是纯文本内容，没有标题结构。": [("", 1, "这是纯文本内容，没有标题结构。")],
        "# 概述\n内容1\n\n1. 详情\n内容2\n\n一、补充\n内容3": [("概述", 1, "内容1"), ("详情", 1, "内容2"), ("补充", 1, "内容3")],
        "# 只有标题": [("", 0, "# 只有标题")],
        "二、\n正文": [("第二、", 1, "正文")],
        "前言\n\n被截断的\n\n# 标题\n\n又一段\n\n接着。\n\n新": [("", 1, "前言\n\n被截断的"), ("标题", 1, "又一段\n接着。\n\n新")],
        "1. 表 | 格\n正文": [("", 1, "1. 表 | 格\n正文")],
    }
    rows = [*cases, None, "", " \n\t\n"]
    got = headings.headed_chapters(texts(spark, rows)).collect()
    for k, t in enumerate(rows):
        mine = [(r.heading, r.level, r.body) for r in sorted(got, key=lambda r: r.chapter) if r.doc_id == k]
        assert mine == cases.get(t, []), t


def test_small_chapters_go_together(spark):
    def grouped(tokens, target):
        rows = [(1, i, f"h{i}", 1 + i % 2, f"b{i}", n) for i, n in enumerate(tokens)]
        df = spark.createDataFrame(rows, "doc_id int, chapter int, heading string, level int, body string, tokens int")
        return [(r.heading, r.level, r.body, r.parts) for r in headings.grouped_chapters(df, target=target).orderBy("chapter").collect()]

    assert grouped([100, 100, 100], 2048) == [("h0", 1, "b0\n\nb1\n\nb2", 3)]
    assert grouped([1000], 2000) == [("h0", 1, "b0", 1)]
    assert [g[2] for g in grouped([100, 150, 60, 1000, 199], 250)] == ["b0\n\nb1", "b2", "b3", "b4"]


def test_stage_moves(spark):
    rows = [
        "公司已从研发阶段进入中试。",
        "此前产品处于送样。现在已规模量产。",
        "该技术在实验室研究。随后小试。然后小批量量产。",
        "行业需求下降。",
        "没有任何阶段",
        None,
        "",
    ]
    got = stage_moves.stage_moves(texts(spark, rows, "text")).collect()
    moves = {k: {(r.from_stage, r.to_stage): (r.source_type, r.direction) for r in got if r.doc_id == k} for k in range(len(rows))}
    assert moves[0] == {("RND", "PILOT"): ("adjacent_states", "positive")}
    assert moves[1] == {("PILOT", "GROWTH"): ("current_vs_historical", "positive")}
    assert moves[2] == {("LAB", "RND"): ("cross_sentence_progression", "positive"), ("RND", "EARLY_ADOPTION"): ("cross_sentence_progression", "positive")}
    assert not moves[3] and not moves[4] and not moves[5] and not moves[6]
    signals = {r.doc_id: (r.signal, r.urgency, r.level) for r in stage_moves.move_signal(stage_moves.stage_moves(texts(spark, rows, "text"))).collect()}
    assert signals[1] == ("PRODUCTION_INFLECTION", 5, "A+") and signals[2] == ("STATE_ADVANCE", 3, "B") and 4 not in signals


def test_words_inside_words(spark):
    one = spark.createDataFrame([("小批量量产后稳定量产",)], "s string").select(stages.shown_stages(F.col("s")).alias("x")).first().x
    assert one == ["EARLY_ADOPTION", "MATURITY"]


def test_rule_signals(spark):
    rows = [
        ("evidence", "a", "公告", None, "公司签订重大合同，相关产品进入规模化交付阶段。", None),
        ("news", "b", None, "", "十五五规划提出算力建设。资本开支显著增加；存在风险", None),
        ("news", "c", "", None, "", None),
        ("news", "d", None, None, None, None),
    ]
    got = rule_signals.rule_signals(spark.createDataFrame(rows, "source_type string, source_id string, title string, summary string, content string, published_at date")).collect()
    by = {(r.source_id, r.kind): r for r in got}
    assert {k for k in by} == {("a", "mass_production"), ("a", "order"), ("b", "policy"), ("b", "capex"), ("b", "risk")}
    order = by["a", "order"]
    assert (order.keyword, order.strength, order.confidence, order.value, order.subject_name) == ("签订重大合同", 86, 0.78, 75, "公告")
    assert (by["b", "policy"].subject_name, by["b", "capex"].strength, by["b", "risk"].polarity) == ("算力基础设施", 84, "risk")


def test_paths_are_scored_one_by_one(spark):
    signals = spark.createDataFrame([("s", "中际旭创", "mass_production", "positive", 88, 0.9), ("t", "nobody", "risk", "risk", 50, 0.5)], "signal_id string, subject string, kind string, polarity string, strength int, confidence double")
    rows = [("中际旭创", ["中际旭创", "800G光模块", "光芯片"], ["PRODUCES", "UPSTREAM"], [0.9, 0.8]), ("中际旭创", ["中际旭创", "x", "y", "z"], ["A", "B", "C"], [1.0, 1.0, 1.0])]
    paths = spark.createDataFrame(rows, "subject string, nodes array<string>, rels array<string>, weights array<double>")
    got = rule_signals.path_propagation(signals, paths).collect()
    assert [(r.target, r.direction, r.secondary_type, r.hops, round(r.confidence, 3)) for r in got] == [("光芯片", "beneficiary", "supply_chain_validation", 2, 0.834)]
    assert got[0].relation_path == "中际旭创 -[PRODUCES]-> 800G光模块 -[UPSTREAM]-> 光芯片"
    assert [r.signal_id for r in rule_signals.without_path(signals, paths).collect()] == ["t"]


def test_relation_types_and_codes(spark):
    rows = ["公司主营化工行业", "已通过客户认证并开始供货", "与同行竞争", "没有规则", None]
    got = [r.x for r in texts(spark, rows, "t").orderBy("doc_id").select(signal_rules.relation_type(F.col("t")).alias("x")).collect()]
    assert got == ["BELONGS_TO", "DIRECTLY_SUPPLIES_TO", "COMPETES_WITH", "SUPPLIES_TO", "SUPPLIES_TO"]
    codes = texts(spark, ["1.SH", "2.BJ", "3.nq", "4.SZ"], "c")
    assert [r.c for r in codes.filter(rules.is_supported(F.col("c"))).collect()] == ["1.SH", "4.SZ"]


def test_search_loses_no_holder(spark):
    r = random.Random(8)
    names = ["".join(r.choice("中芯国际电 aB") for _ in range(r.randint(1, 9))) for _ in range(80)]
    entities = [(f"C:{k}", f"{k}.SH", n, [names[k - 1]] if k % 3 == 0 else None, 1 + k % 4) for k, n in enumerate(names)]
    queries = [(k, q) for k, q in enumerate([n[a : a + b] for n in names[:40] for a, b in [(r.randint(0, 3), r.randint(1, 4))]] + ["C:7", "9.SH", "", None, "zzz"])]
    got = entity_search(spark.createDataFrame(entities, "id string, code string, name string, aliases array<string>, rank int"), spark.createDataFrame(queries, "query_id int, query string"), 1000)
    found = {}
    for x in got.collect():
        found.setdefault(x.query_id, set()).add(x.id)
    for k, q in queries:
        q = (q or "").strip(" ")
        direct = {e[0] for e in entities if q in (e[0], e[1])}
        held = {e[0] for e in entities if q and any(q.lower() in n.lower() for n in [e[2], *(e[3] or [])])}
        assert found.get(k, set()) == (direct or held), q
