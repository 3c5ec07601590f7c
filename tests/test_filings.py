"""Rule tables of filings on real sentences."""

from pyspark.sql import functions as F

from ledgerloom.functions import filing_rules as r
from ledgerloom.operators import filings as op


def values(spark, rows, schema, *columns):
    return [tuple(x) for x in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_titles(spark):
    titles = ["2024年半年度报告", "2024年年度报告摘要", "2025年第三季度业绩预告", "关于季度报告的公告", "关于签订重大合同的公告", "关于对外投资设立子公司的公告", "投资者关系活动记录表", "关于召开股东大会的通知", "", None, "中标签约及重大资产重组"]
    got = values(spark, [(t,) for t in titles], "t string", r.title_class(F.col("t"), r.ANNOUNCEMENT_TITLES)["doc_type"].alias("k"), r.title_class(F.col("t"), r.ANNOUNCEMENT_TITLES)["action"].alias("a"))
    kinds = ["half_report", "annual_report", "quarter_report", "quarter_report", "contract", "investment", "research_survey", "other", "unknown", "unknown", "contract"]
    assert got == [(k, "skip" if k in ("other", "unknown") else "save") for k in kinds]
    reports = ["半导体行业深度：国产替代", "光伏产业链跟踪", "铜价周报", "宏观点评", "某公司首次覆盖", "策略专题", "晨会纪要"]
    got = values(spark, [(t,) for t in reports], "t string", r.title_class(F.col("t"), r.REPORT_TITLES)["doc_type"])
    assert [k for (k,) in got] == ["industry", "industry_chain", "commodity", "macro", "company", "special_topic", "other"]


ANSWERS = [
    ("", "答复", "unknown"),
    ("问题", None, "empty_answer"),
    ("问题", " nan ", "empty_answer"),
    ("问题", "好的，谢谢。", "short_answer"),
    ("请问最新股东人数？", "感谢您的关注，请留意公司的定期报告内容。", "shareholder_no_data"),
    ("请问最新股东户数？", "感谢您的关注，截至月底共有 32,118 户。", "shareholder_count"),
    ("公司怎么看天气？", "感谢您的关注，祝您生活愉快，一切顺利。", "template_answer"),
    ("公司怎么看天气？", "感谢您的关注，公司产能将在明年逐步释放。", "production"),
    ("贵公司的供应商有哪些？", "具体请以披露的文件为准，谢谢理解与支持。", "industry_chain"),
    ("项目怎么样了？", "一切顺利，我们会持续努力并及时告知大家。", "major_event"),
    ("人形机器人有吗？", "目前没有这方面的安排，未来会考虑的，请放心。", "industry_tech"),
    ("请问您好，在吗？", "在的，我们会一直在这里，欢迎您随时来电联系。", "pure_greeting"),
    ("为什么股价一直跌？", "二级市上的波动受多种因素影响，请理性看待。", "low_value_irrelevant"),
    ("明天会下雨吗？", "这个问题我们无法回答，还请您多多包涵谅解。", "low_value"),
    ("未来的规划是什么？", "我们会按照既定的安排一步一步往前走，请放心。", "other"),
]
SAVED = ("shareholder_count", "production", "industry_chain", "major_event", "industry_tech", "other")


def test_answer_filter(spark):
    got = values(spark, [x[:2] for x in ANSWERS], "q string, a string", r.answer_filter(F.col("q"), F.col("a")).alias("x"))
    assert [tuple(x) for (x,) in got] == [(want, "save" if want in SAVED else "skip") for *_, want in ANSWERS]


GRADES = [
    ("尊敬的投资者，您好。感谢您对公司的关注。", "empty", 0),
    ("您好，感谢关注。", "empty", 0),
    ("", "empty", 0),
    ("   ", "empty", 0),
    (None, "empty", 0),
    ("公司围绕主业稳步推进各项工作，持续提升治理水平。" * 20, "complex", 2),
    ("经营数据请以公告为准。感谢您的关注！", "defer", 0),
    ("如有重组计划，公司将会及时信披。", "defer", 0),
    ("尊敬的投资者您好！截至月底，股东总户数为19849户，感谢关注！", "data", 1),
    ("三年营收分别为34.12亿元与57.53亿元。", "data", 1),
    ("海外增速达到20%。", "data", 1),
    ("公司目前没有相关计划。", "simple", 1),
    ("尊敬的投资者，您好！该项目将于年内择机投产。感谢您对公司的关注！", "simple", 1),
]


def test_answer_grade(spark):
    got = values(spark, [x[:1] for x in GRADES], "a string", r.answer_grade(F.col("a")).alias("x"))
    assert [tuple(x) for (x,) in got] == [x[1:] for x in GRADES]


def test_polarity(spark):
    texts = ["已实现规模化量产", "仍处于中试阶段", "量产线已建成，但客户认证中", "公司经营正常", None]
    assert [x for (x,) in values(spark, [(t,) for t in texts], "t string", r.semantic_polarity(F.col("t")))][:4] == ["positive", "negative", "conflict", "neutral"]


def test_facts(spark):
    rows = [("E1", "600000.SH", "产品已量产并导入客户", "2026-01-05", None), ("E2", " ", "量产", None, 0.5), ("E3", "600001.SH", "订单饱满，排产至年底，但业绩不及预期", None, 0.5), ("E4", "600002.SH", None, None, 0.0), ("E5", "600002.SH", "只有订单", None, 0.0)]
    got = op.structured_facts(spark.createDataFrame(rows, "evidence_id string, subject_id string, text string, observed_at string, confidence double")).orderBy("evidence_id", "dimension").collect()
    assert [(x.evidence_id, x.state_value, x.confidence) for x in got] == [("E1", "customer_introduction", 0.8), ("E1", "mass_production_started", 0.8), ("E3", "earnings_below_expectation", 0.5), ("E3", "order_scheduled", 0.5)]
    assert all(x.fact_id.startswith("SF:") and len(x.fact_id) == 27 for x in got)
    bad = values(spark, [("order", "Strong_Buy"), ("mispriced", "x"), ("order", "scheduled"), (None, None)], "d string, v string", r.forbidden_value(F.col("d"), F.col("v")))
    assert bad == [("buy",), ("mispriced",), (None,), (None,)]


def test_periods_units_and_metrics(spark):
    rows = [("2024年第一季度实现", "公告"), ("预计增长", "2025 年公告"), ("第三季度与半年报", "x"), ("正文", "2023年年度报告"), (None, None)]
    assert values(spark, rows, "t string, s string", r.report_period(F.col("t"), F.col("s"), 2026)["period"]) == [("2024Q1",), ("2025E",), ("2026Q3",), ("2023A",), ("2026A",)]
    units = [("营业收入为3.2亿元", "营业收入"), ("毛利率为20%，约3万元", "毛利率"), ("净利润良好", "净利润"), ("没有", "净利润"), ("净利润" + "好" * 200 + "元", "净利润")]
    assert values(spark, units, "t string, m string", r.unit_near(F.col("t"), F.col("m"))) == [("亿元",), ("万元",), (None,), (None,), (None,)]
    assert values(spark, [("增长20%",), ("增长很多",), ("20",), (None,), ("占比3成",)], "d string", r.metric_is_valid(F.col("d"))) == [(True,), (False,), (False,), (False,), (True,)]


def test_names(spark):
    noise = ["", None, " -- ", "***", "——", "# 概况", "以下实体列表", "RELATES", "贵州茅台", "A1", "_"]
    assert [x for (x,) in values(spark, [(n,) for n in noise], "n string", r.is_noise_name(F.col("n")))] == [True] * 8 + [False, False, True]
    assert values(spark, [("本公司",), ("公司债",), ("该集司",), (None,)], "n string", r.is_generic_name(F.col("n"))) == [(True,), (False,), (True,), (False,)]
    assert values(spark, [("东方证券研究所",), ("中国银河证券",), ("某某咨询",), ("某大学",), (None,)], "n string", r.is_broker(F.col("n"))) == [(True,), (False,), (True,), (False,), (False,)]


def test_lines_and_chapters(spark):
    text = "正文一行\n\n  \nhttp://a.cn/x\n写信给 a@b.com\n| a | b | c |\n" + "—" * 40 + "\n本报告仅供参考，不构成建议\n风险提示与联系方式：请联系我们\n最后一行 | 有一条竖线"
    assert values(spark, [(text,), (None,)], "t string", r.prose_lines(F.col("t"))) == [("正文一行\n最后一行 | 有一条竖线",), ("",)]
    rows = [("董事会决议", "没有", "x", "skip"), ("董事会决议", "本次收购的标的资产", "x", "keep"), ("主营业务", "", "x", "keep"), ("其他", "", "x", "skip"), ("附件", "", "investment", "keep"), (None, None, None, "skip")]
    assert [x for (x,) in values(spark, [x[:3] for x in rows], "h string, b string, k string", r.chapter_action(F.col("h"), F.col("b"), F.col("k")))] == [x[3] for x in rows]


def test_fallback(spark):
    filings = spark.createDataFrame([(1, "announcement", "2024年半年度报告", "甲公司", "归母净利润为3亿元，毛利率20%"), (2, "news", "x", "乙", "净利润")], "doc_id long, source_type string, source_name string, company string, text string")
    entities = spark.createDataFrame([(1, "毛利率", "Metric")], "doc_id long, name string, type string")
    relations = spark.createDataFrame([(1, "甲公司", "净利润", "2024年半年度报告披露2024H1净利润")], "doc_id long, source string, target string, description string")
    got = sorted((x.record, x.target, x.unit) for x in op.fallback_facts(filings, entities, relations, 2026).collect())
    assert got == [("Company", "甲公司", None), ("Metric", "净利润", "亿元"), ("Metric", "归母净利润", "亿元"), ("Relation", "归母净利润", None), ("Relation", "毛利率", None)]
