"""The whole rule tables for titles, answers, chapters, facts and names, over texts that Spark derives from the documents.

The given texts hold no word of the tables, so each document picks words of a table by its lengths and id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import filing_rules as r
from ledgerloom.functions import stages
from ledgerloom.operators import filings as op
from ledgerloom.plans.bindings import ANNOUNCEMENTS, with_
from ledgerloom.sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, f"{with_(ANNOUNCEMENTS)}, {sql}"
        return f

    return add


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


class Picked:
    """A word of a table for each document, as a column and as SQL."""

    def __init__(self, words, body: int, id_: int, title: int):
        self.words, self.k = tuple(words), (body, id_, title)

    @property
    def sql(self) -> str:
        return f"({_list(self.words)})[(length(body) * {self.k[0]} + doc_id * {self.k[1]} + length(title) * {self.k[2]}) % {len(self.words)} + 1]"

    @property
    def column(self) -> Column:
        at = F.length("body") * self.k[0] + F.col("doc_id") * self.k[1] + F.length("title") * self.k[2]
        return F.get(F.array(*[F.lit(w) for w in self.words]), (at % len(self.words)).cast("int"))


def _all(table) -> list[str]:
    return [w for _, words in table for w in words]


def _any(text: str, words) -> str:
    return f"(len(list_filter({_list(words)}, lambda w: contains({text}, w))) > 0)"


def _first_label(text: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{w}') THEN '{label}'" for w, label in pairs) + " END"


def _docs(spark, sf, **columns: Column) -> DataFrame:
    return t.announcements(spark, sf).select("doc_id", *[c.alias(n) for n, c in columns.items()])


# ---- titles ------------------------------------------------------------------------------------------------------
def _titles(name: str, table) -> None:
    a, b = Picked([*_all(table), "普通公告", "通知"], 1, 1, 3), Picked([*_all(table), "", "其他"], 5, 2, 1)

    @query(name, f"""x AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE '关于' || {a.sql} || '的' || CASE WHEN doc_id % 3 = 0 THEN {b.sql} ELSE '说明' END END AS said FROM announcements),
        y AS (SELECT doc_id, said, CASE WHEN said = '' THEN 'unknown' ELSE coalesce({_first_label('said', [(w, k) for k, ws in table for w in ws])}, 'other') END AS doc_type FROM x)
        SELECT doc_id, said, doc_type, CASE WHEN doc_type IN ('unknown', 'other') THEN 'skip' ELSE 'save' END AS action FROM y""")
    def run(spark, sf):
        said = F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.concat(F.lit("关于"), a.column, F.lit("的"), F.when(F.col("doc_id") % 3 == 0, b.column).otherwise("说明")))
        return _docs(spark, sf, said=said).select("doc_id", "said", r.title_class(F.col("said"), table).alias("x")).select("doc_id", "said", "x.*")


_titles("tx1_announcement_titles", r.ANNOUNCEMENT_TITLES)
_titles("tx2_report_titles", r.REPORT_TITLES)


# ---- questions and answers ---------------------------------------------------------------------------------------
_Q1 = Picked([*r.POLITE, *r.HOLDER_COUNTS, "贵公司", "明天天气", ""], 1, 1, 3)
_Q2 = Picked([*r.IRRELEVANT, *r.POLITE, "请告知", "如何看待", "是否有计划", *r.SUBSTANCE[:12]], 3, 1, 7)
_A1 = Picked(["", "None", "无", "公司一切正常没有变化请放心", "截至期末共有12345户", *r.TEMPLATES, "敬请留意后续情况谢谢支持理解", *_all(r.SUBJECTS)[::4], *r.TECH_WORDS[::7]], 1, 3, 1)
_A2 = Picked(["，特此回复。", "，我们会认真考虑您的意见与看法。", "", "，产品与业务", "，以上情况供您参考，祝您生活愉快。"], 7, 1, 1)
_SKIPPED = "'unknown', 'empty_answer', 'short_answer', 'shareholder_no_data', 'template_answer', 'pure_greeting', 'low_value_irrelevant', 'pure_suggestion', 'low_value'"


@query("tx3_answer_verdicts", f"""x AS (SELECT doc_id, {_Q1.sql} || {_Q2.sql} AS q, {_A1.sql} || CASE WHEN {_A1.sql} IN ('', 'None') THEN '' ELSE {_A2.sql} END AS a FROM announcements), c AS (SELECT *, q || ' ' || a AS c FROM x),
    y AS (SELECT *, {_first_label('c', r.subject_words().items())} AS subject, NOT {_any('c', r.SUBSTANCE)} AS thin FROM c),
    z AS (SELECT doc_id, CASE WHEN q = '' THEN 'unknown' WHEN a IN ('', 'None', 'nan') THEN 'empty_answer' WHEN length(a) < 15 THEN 'short_answer' WHEN {_any('q', r.HOLDER_COUNTS)} THEN CASE WHEN regexp_matches(a, '\\d') THEN 'shareholder_count' ELSE 'shareholder_no_data' END
        WHEN {_any('a', r.TEMPLATES)} AND NOT {_any('a', r.KEEPS_TEMPLATE)} THEN 'template_answer' WHEN subject IS NOT NULL THEN subject WHEN thin AND length(q) < 40 AND len(list_filter({_list(r.POLITE)}, lambda w: contains(q, w))) >= 2 THEN 'pure_greeting'
        WHEN thin AND {_any('c', r.IRRELEVANT)} THEN 'low_value_irrelevant' WHEN thin AND contains(q, '建议') THEN 'pure_suggestion' WHEN thin THEN 'low_value' ELSE 'other' END AS doc_type FROM y)
    SELECT doc_id, doc_type, CASE WHEN doc_type IN ({_SKIPPED}) THEN 'skip' ELSE 'save' END AS action FROM z""")
def answer_verdicts(spark, sf):
    a = F.concat(_A1.column, F.when(_A1.column.isin("", "None"), "").otherwise(_A2.column))
    return _docs(spark, sf, q=F.concat(_Q1.column, _Q2.column), a=a).select("doc_id", r.answer_filter(F.col("q"), F.col("a")).alias("x")).select("doc_id", "x.*")


_P, _S = Picked([*r.PREFIXES, "", ""], 1, 1, 1), Picked([*r.SUFFIXES, "", ""], 1, 2, 5)
_CORES = Picked(["公司目前没有相关计划。", "具体情况请以公告为准。", "营收34.12亿元。", "", "无", "增长 12.5 %。", "股东总户数为19849户，", "毛利率：35", "将会及时信披，" + "公司治理规范" * 9, "公司坚持前瞻布局，紧扣政策导向。" * 20, "  "], 3, 1, 1)
_FIGURE = " OR ".join(f"regexp_matches(core, '{p}')" for p in r.FIGURES)


@query("tx4_answer_grades", f"""x AS (SELECT doc_id, {_P.sql} || {_CORES.sql} || {_S.sql} AS a FROM announcements), e AS (SELECT *, list_filter({_list(r.SUFFIXES)}, lambda s: suffix(a, s))[1] AS e FROM x), c AS (SELECT *, substr(a, 1, length(a) - coalesce(length(e), 0)) AS cut FROM e),
    b AS (SELECT *, list_filter({_list(r.PREFIXES)}, lambda s: starts_with(cut, s))[1] AS b FROM c), k AS (SELECT doc_id, a, trim(substr(cut, coalesce(length(b), 0) + 1)) AS core FROM b),
    g AS (SELECT doc_id, CASE WHEN trim(a) = '' OR length(core) < 3 THEN 'empty' WHEN length(a) >= 300 THEN 'complex' WHEN {_any('a', r.DEFERRALS)} AND length(core) < 50 THEN 'defer' WHEN {_FIGURE} THEN 'data' ELSE 'simple' END AS grade FROM k)
    SELECT doc_id, grade, CASE grade WHEN 'complex' THEN 2 WHEN 'simple' THEN 1 WHEN 'data' THEN 1 ELSE 0 END AS tier FROM g""")
def answer_grades(spark, sf):
    return _docs(spark, sf, a=F.concat(_P.column, _CORES.column, _S.column)).select("doc_id", r.answer_grade(F.col("a")).alias("x")).select("doc_id", "x.*")


# ---- polarity and stages -----------------------------------------------------------------------------------------
_M1, _M2 = Picked([*r.POSITIVE_MARKS, *r.NEGATIVE_MARKS, "一般情况"], 1, 1, 1), Picked([*r.NEGATIVE_MARKS, *r.POSITIVE_MARKS, "情况一般", "无"], 3, 1, 2)


@query("tx5_text_polarity", f"""x AS (SELECT doc_id, {_M1.sql} || '，' || {_M2.sql} AS said FROM announcements), y AS (SELECT doc_id, {_any('said', r.POSITIVE_MARKS)} AS p, {_any('said', r.NEGATIVE_MARKS)} AS n FROM x)
    SELECT doc_id, CASE WHEN p AND n THEN 'conflict' WHEN p THEN 'positive' WHEN n THEN 'negative' ELSE 'neutral' END AS polarity FROM y""")
def text_polarity(spark, sf):
    return _docs(spark, sf, said=F.concat(_M1.column, F.lit("，"), _M2.column)).select("doc_id", r.semantic_polarity(F.col("said")).alias("polarity"))


_W = [w for words in stages.STAGE_WORDS.values() for w in words] + ["没有线索"]
_W1, _W2, _W3 = Picked(_W, 1, 1, 1), Picked(_W, 7, 3, 1), Picked(_W, 3, 1, 11)
_HITS = " UNION ALL ".join(f"SELECT doc_id, '{s}' AS stage, {stages.RANK[s]} AS rank, len(list_filter({_list(words)}, lambda w: contains(said, w))) AS n FROM x" for s, words in stages.STAGE_WORDS.items())


@query("tx7_text_stages", f"""x AS (SELECT doc_id, {_W1.sql} || '、' || {_W2.sql} || '、' || {_W3.sql} AS said FROM announcements), h AS ({_HITS})
    SELECT doc_id, CASE WHEN max(n) > 0 THEN arg_max(stage, (n, rank)) END AS stage FROM h GROUP BY doc_id""")
def text_stages(spark, sf):
    said = F.concat(_W1.column, F.lit("、"), _W2.column, F.lit("、"), _W3.column)
    return _docs(spark, sf, said=said).select("doc_id", stages.text_stage(F.col("said")).alias("stage"))


# ---- facts, metrics and names ------------------------------------------------------------------------------------
_F1, _F2 = Picked(["量产", "导入", "进入供应链", "订单", "业绩不及预期", "低于预期", "没有"], 1, 1, 1), Picked(["排产", "量产", "低于预期", "订单排产", "平稳"], 3, 1, 1)
_STATED = " UNION ALL ".join(f"SELECT *, '{d}' AS dimension, '{v}' AS state_value, '{trig}' AS trigger FROM x WHERE {' OR '.join('(' + ' AND '.join(f'''contains(said, '{w}')''' for w in g) + ')' for g in groups)}" for d, v, trig, groups in r.FACTS)


@query("tx14_structured_facts", f"""x AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE 'C' || doc_id || ' ' END AS subject, 'EV:' || doc_id AS evidence_id, {_F1.sql} || '，' || {_F2.sql} AS said, CASE WHEN doc_id % 2 = 0 THEN 0.9::DOUBLE END AS confidence FROM announcements), f AS ({_STATED})
    SELECT 'SF:' || substr(sha256(concat_ws(chr(10), trim(subject), dimension, state_value, '2026-01-05', evidence_id)), 1, 24) AS fact_id, trim(subject) AS subject_id, dimension, state_value, evidence_id, substr(said, 1, 500) AS evidence_text, coalesce(confidence, 0.8) AS confidence, trigger FROM f WHERE trim(subject) <> ''""")
def structured_facts(spark, sf):
    evidence = _docs(
        spark, sf, subject_id=F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.concat(F.lit("C"), "doc_id", F.lit(" "))), evidence_id=F.concat(F.lit("EV:"), "doc_id"),
        text=F.concat(_F1.column, F.lit("，"), _F2.column), observed_at=F.lit("2026-01-05"), confidence=F.when(F.col("doc_id") % 2 == 0, 0.9),
    )
    return op.structured_facts(evidence)


_V = Picked([*r.FORBIDDEN_VALUES, "mass_production_started", "Likely_BUY", "outsell", "order_scheduled"], 1, 1, 1)


@query("tx14_forbidden_values", f"""x AS (SELECT doc_id, {_V.sql} AS v FROM announcements) SELECT doc_id, v AS state_value, list_filter({_list(r.FORBIDDEN_VALUES)}, lambda b: contains(lower(v), b))[1] AS forbidden FROM x""")
def forbidden_values(spark, sf):
    return _docs(spark, sf, state_value=_V.column).select("doc_id", "state_value", r.forbidden_value(F.lit("production"), F.col("state_value")).alias("forbidden"))


_N = Picked([*r.NOISE_NAMES, *[f"以下{m}：" for m in r.NOISE_MARKS], "# 标题", "###标题", "***", "_ _", " ", "公司", "本公司", "该集司", "我司", "贵州茅台", "宁德时代", "A-1", "公司债"], 1, 1, 1)


@query("tx15_entity_names", rf"""x AS (SELECT doc_id, {_N.sql} AS name FROM announcements) SELECT doc_id, name, trim(name) = '' OR trim(name) IN ({_list(r.NOISE_NAMES)[1:-1]}) OR regexp_matches(trim(name), '^[^\p{{L}}\p{{N}}]+$') OR starts_with(trim(name), '#') OR {_any('name', r.NOISE_MARKS)} AS noise, regexp_matches(name, '{r.GENERIC}') AS generic FROM x""")
def entity_names(spark, sf):
    return _docs(spark, sf, name=_N.column).select("doc_id", "name", r.is_noise_name(F.col("name")).alias("noise"), r.is_generic_name(F.col("name")).alias("generic"))


_X1, _X2 = Picked([*r.METRICS, "没有指标"], 1, 1, 1), Picked(["12.5亿元", "3万元", "20%", "5吨", "一百", "7 元", "9GWh"], 3, 1, 1)
_Y = Picked(["2024年第一季度报告", "2023年半年报", "2025年业绩预告", "2022年年度报告", "公司公告", "2021 年三季度"], 1, 2, 1)
_K = Picked(["announcement", "annual_report", "news"], 1, 1, 3)
_PERIOD = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(sample, '{w}')''' for w in words)} THEN '{c}'" for c, _, words in r.PERIODS) + " ELSE 'A' END"
_PERIOD_TYPE = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(sample, '{w}')''' for w in words)} THEN '{k}'" for _, k, words in r.PERIODS) + " ELSE 'actual' END"
_FILED = f"""x AS (SELECT doc_id, {_K.sql} AS source_type, {_Y.sql} AS source_name, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'C' || doc_id % 50 END AS company, {_X1.sql} || '为' || {_X2.sql} || '。' || repeat('其他', doc_id % 120) || '万股' AS said FROM announcements),
    s AS (SELECT *, source_name || chr(10) || substr(said, 1, {r.SAMPLE}) AS sample FROM x), p AS (SELECT *, coalesce(nullif(regexp_extract(sample, '{r.YEAR}', 1), ''), '2026') || {_PERIOD} AS period, {_PERIOD_TYPE} AS period_type FROM s)"""


def _filed(spark, sf) -> DataFrame:
    company = F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat(F.lit("C"), F.col("doc_id") % 50))
    text = F.concat(_X1.column, F.lit("为"), _X2.column, F.lit("。"), F.repeat(F.lit("其他"), (F.col("doc_id") % 120).cast("int")), F.lit("万股"))
    return _docs(spark, sf, source_type=_K.column, source_name=_Y.column, company=company, text=text)


@query("sc8_filing_periods", f"{_FILED} SELECT doc_id, period, period_type FROM p")
def filing_periods(spark, sf):
    return _filed(spark, sf).select("doc_id", r.report_period(F.col("text"), F.col("source_name"), 2026).alias("p")).select("doc_id", "p.*")


_UNIT = f"list_filter({_list(r.UNITS)}, lambda u: contains(substr(said, strpos(said, term), {r.NEAR}), u))[1]"


@query("sc9_metric_units", f"{_FILED}, m AS (SELECT doc_id, said, unnest({_list(r.METRICS)}) AS term FROM p) SELECT doc_id, term, CASE WHEN contains(said, term) THEN {_UNIT} END AS unit FROM m")
def metric_units(spark, sf):
    m = _filed(spark, sf).select("doc_id", "text", F.explode(F.array(*[F.lit(x) for x in r.METRICS])).alias("term"))
    return m.select("doc_id", "term", r.unit_near(F.col("text"), F.col("term")).alias("unit"))


@query("tx16_missing_metrics", f"""{_FILED}, o AS (SELECT * FROM p WHERE source_type IN ({_list(r.OFFICIAL)[1:-1]})), m0 AS (SELECT *, unnest({_list(r.METRICS)}) AS term FROM o), m AS (SELECT *, {_UNIT} AS unit, source_name || '披露' || period || term AS description FROM m0 WHERE contains(said, term))
    SELECT doc_id, 'Company' AS record, NULL::VARCHAR AS source, company AS target, source_name || '公告主体' AS description, NULL::VARCHAR AS unit, NULL::VARCHAR AS period, NULL::VARCHAR AS period_type FROM o WHERE company <> '' AND doc_id % 4 <> 0
    UNION ALL SELECT doc_id, 'Metric', NULL, term, description, unit, period, period_type FROM m WHERE NOT (doc_id % 2 = 0 AND term = '净利润')
    UNION ALL SELECT doc_id, 'Relation', company, term, description, NULL, period, period_type FROM m WHERE company <> '' AND doc_id % 6 <> 0""")
def missing_metrics(spark, sf):
    filed = _filed(spark, sf)
    entities = filed.filter("doc_id % 4 = 0").select("doc_id", F.col("company").alias("name"), F.lit("Company").alias("type"))
    entities = entities.unionByName(filed.filter("doc_id % 2 = 0").select("doc_id", F.lit("净利润").alias("name"), F.lit("Metric").alias("type")))
    known = op.fallback_facts(filed.filter("doc_id % 6 = 0"), entities.limit(0), entities.limit(0).select("doc_id", F.lit("").alias("source"), F.lit("").alias("target"), F.lit("").alias("description")), 2026)
    return op.fallback_facts(filed, entities, known.filter("record = 'Relation'").select("doc_id", "source", "target", "description"), 2026)


@query("sc10_checked_metrics", f"x AS (SELECT doc_id, {_X1.sql} || {Picked(['', '同比', '增速', '12.5', '3 亿元', '20%', '五个百分点', '2024年'], 5, 1, 1).sql} AS d FROM announcements) SELECT doc_id, regexp_matches(d, '{r.METRIC_NUMBER}') AND regexp_matches(d, '{r.METRIC_UNIT}') AS valid FROM x")
def checked_metrics(spark, sf):
    said = F.concat(_X1.column, Picked(["", "同比", "增速", "12.5", "3 亿元", "20%", "五个百分点", "2024年"], 5, 1, 1).column)
    return _docs(spark, sf, d=said).select("doc_id", r.metric_is_valid(F.col("d")).alias("valid"))


_B1, _B2 = Picked([*r.NOT_BROKERS, "东方", "who", "某某"], 1, 1, 1), Picked([*r.BROKERS, "公司", "大学"], 3, 1, 1)


@query("tx20_publishers", f"x AS (SELECT doc_id, {_B1.sql} || {_B2.sql} AS name FROM announcements) SELECT doc_id, name, NOT {_any('lower(name)', r.NOT_BROKERS)} AND {_any('name', r.BROKERS)} AS broker FROM x")
def publishers(spark, sf):
    return _docs(spark, sf, name=F.concat(_B1.column, _B2.column)).select("doc_id", "name", r.is_broker(F.col("name")).alias("broker"))


# ---- lines and chapters ------------------------------------------------------------------------------------------
_NOISE = ["see http://a.b/c", "mail x@y.com", "| 1 | 2 | 3 |", "||||a long line with few bars for its length||||", "——————————————————————————————————————", "本报告版权所有，仅供参考", "  ", "风险提示：不构成建议", "正常的一行"]


@query("dc2_prefiltered_texts", rf"""l0 AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS raw, unnest(range(len(string_split(body, chr(10))))) AS i FROM announcements),
    l AS (SELECT doc_id, i, CASE WHEN i % 2 = 0 THEN raw ELSE ({_list(_NOISE)})[(length(raw) + i) % {len(_NOISE)} + 1] END AS raw FROM l0), s AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS s FROM l),
    b AS (SELECT *, len(regexp_extract_all(s, '\|')) AS bars FROM s), k AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) AS kept FROM b WHERE s <> '' AND NOT regexp_matches(s, '{r.LINKS}') AND NOT regexp_matches(s, '{r.GIBBERISH}') AND NOT regexp_matches(s, '{r.DISCLAIMER}') AND NOT (bars >= 3 AND bars > length(s) * 0.25) GROUP BY doc_id)
    SELECT a.doc_id, md5(coalesce(kept, '')) AS kept_md5 FROM announcements a LEFT JOIN k ON a.doc_id = k.doc_id""")
def prefiltered_texts(spark, sf):
    noise = F.array(*[F.lit(x) for x in _NOISE])
    lines = F.transform(F.split("body", "\n"), lambda line, i: F.when(i % 2 == 0, line).otherwise(F.get(noise, (F.length(line) + i) % len(_NOISE))))
    return _docs(spark, sf, text=F.array_join(lines, "\n")).select("doc_id", F.md5(r.prose_lines(F.col("text"))).alias("kept_md5"))


_H1, _H2 = Picked([*r.SKIPPED_CHAPTERS, *r.KEPT_CHAPTERS, "其他事项", ""], 1, 1, 1), Picked([*r.SUBSTANTIVE.split("|"), *["没有内容"] * 30], 3, 1, 1)
_H3 = Picked([*r.ALWAYS_KEPT, *["contract"] * 7, ""], 1, 5, 1)


@query("dc9_chapter_verdicts", f"""x AS (SELECT doc_id, {_H1.sql} AS h, {_H2.sql} AS b, {_H3.sql} AS kind FROM announcements)
    SELECT doc_id, CASE WHEN kind IN ({_list(r.ALWAYS_KEPT)[1:-1]}) THEN 'keep' WHEN {_any('h', r.SKIPPED_CHAPTERS)} THEN CASE WHEN regexp_matches(b, '{r.SUBSTANTIVE}') THEN 'keep' ELSE 'skip' END WHEN {_any('h', r.KEPT_CHAPTERS)} OR regexp_matches(b, '{r.SUBSTANTIVE}') THEN 'keep' ELSE 'skip' END AS action FROM x""")
def chapter_verdicts(spark, sf):
    return _docs(spark, sf, h=_H1.column, b=_H2.column, k=_H3.column).select("doc_id", r.chapter_action(F.col("h"), F.col("b"), F.col("k")).alias("action"))
