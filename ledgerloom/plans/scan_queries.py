"""Compliance, search queries and dictionary tags over whole tables.

The given texts hold no word of the rule tables, so texts and queries are derived from them: each line picks some words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import query_rules as r
from ledgerloom.operators import text_scans as s
from ledgerloom.plans.bindings import ANNOUNCEMENTS, with_
from ledgerloom.sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _words(pattern: str) -> list[str]:
    return [w.replace("[入入]?", "入").replace("?", "") for w in pattern.split("|")]


def _pick(words, place: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), (place % len(words)).cast("int"))


def _found(source: str, text: str, pattern: str, kind: str) -> str:
    """SQL of the places of a pattern: what lies before each match, added up."""
    return f"""SELECT id, '{kind}' AS kind, (list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0))::BIGINT AS s, ms[i] AS m
        FROM (SELECT id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT id, regexp_extract_all({text}, '{pattern}') AS ms, regexp_split_to_array({text}, '{pattern}') AS ps FROM {source}))"""


# ---- compliance --------------------------------------------------------------------------------------------------
SAID = tuple(dict.fromkeys([w for p, _ in (*r.FORBIDDEN, *r.WARNINGS) for w in _words(p)])) + ("公司经营正常", "营收增长", "产能", "订单")
_SAID = f"""said AS (SELECT doc_id AS id, string_agg(({_list(SAID)})[(length(line) * 5 + i * 3) % {len(SAID)} + 1] || CASE WHEN i % 3 = 0 THEN '' ELSE '，' END || ({_list(SAID)})[(length(line) + i * 11) % {len(SAID)} + 1] || '。', '' ORDER BY i) AS text
    FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS i FROM announcements) GROUP BY doc_id)"""
_HITS = " UNION ALL ".join(_found("said", "text", p, name) for p, name in r.FORBIDDEN)
_WARNED = " UNION ALL ".join(f"SELECT id, {k} AS k, '{name}' AS kind, len(regexp_extract_all(redacted, '{p}')) AS n FROM clean" for k, (p, name) in enumerate(r.WARNINGS))
_ORDER = " ".join(f"WHEN '{name}' THEN {k}" for k, (_, name) in enumerate(r.FORBIDDEN))


@query("tx18_redacted_texts", f"""{with_(ANNOUNCEMENTS, _SAID)}, hits AS ({_HITS}),
    reach AS (SELECT id, s, s + length(m) AS e, max(s + length(m)) OVER (PARTITION BY id ORDER BY s, s + length(m) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hits),
    island AS (SELECT *, count(*) FILTER (before IS NULL OR s > before) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM reach),
    gone AS (SELECT id, min(s) AS s, max(e) AS e FROM island GROUP BY id, k),
    gaps AS (SELECT id, s, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) AS p, max(e) OVER (PARTITION BY id) AS last FROM gone),
    clean AS (SELECT said.id, coalesce(string_agg(substr(text, (p + 1)::INTEGER, (s - p)::INTEGER) || '{r.REDACTED}', '' ORDER BY s), '') || substr(any_value(text), coalesce(max(last), 0)::INTEGER + 1) AS redacted FROM said LEFT JOIN gaps ON said.id = gaps.id GROUP BY said.id),
    v AS (SELECT id, string_agg(kind || ':' || n, ';' ORDER BY k) AS violations FROM (SELECT id, kind, count(*) AS n, CASE kind {_ORDER} END AS k FROM hits GROUP BY id, kind) GROUP BY id),
    w AS (SELECT id, string_agg(kind || ':' || n, ';' ORDER BY k) AS warnings FROM ({_WARNED}) WHERE n > 0 GROUP BY id)
    SELECT clean.id AS doc_id, violations IS NULL AS passed, coalesce(violations, '') AS violations, coalesce(warnings, '') AS warnings, md5(redacted) AS redacted_md5 FROM clean LEFT JOIN v ON clean.id = v.id LEFT JOIN w ON clean.id = w.id""")
def redacted_texts(spark, sf):
    part = lambda line, i: F.concat(_pick(SAID, F.length(line) * 5 + i * 3), F.when(i % 3 == 0, "").otherwise("，"), _pick(SAID, F.length(line) + i * 11), F.lit("。"))
    texts = t.announcements(spark, sf).select("doc_id", F.array_join(F.transform(F.split("body", "\n"), part), "").alias("text"))
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["rule"], F.lit(":"), x["n"].cast("string"))), ";")
    return s.compliance(texts).select("doc_id", "passed", flat("violations").alias("violations"), flat("warnings").alias("warnings"), F.md5("redacted").alias("redacted_md5"))


# ---- search queries ----------------------------------------------------------------------------------------------
NAMES = ("贵州茅台", "五粮液", "300750.SZ", "隆基股份", "中芯国际集成", "宁德时代", "600519.SH", "光伏", "新能源汽车", "某家公司")
LINKS = ("和", "与", "的", " 跟 ", "对", "在", "、", "的供应商和")
ENDS = ("的关系", "的供应商有哪些", "行业现状", "之间的路径", "怎么样", "的产业链传导", "的景气度", "？")
_ASKED = f"asked AS (SELECT doc_id AS id, ({_list(NAMES)})[length(body) % {len(NAMES)} + 1] || ({_list(LINKS)})[length(title) % {len(LINKS)} + 1] || ({_list(NAMES)})[(length(body) // 7) % {len(NAMES)} + 1] || ({_list(ENDS)})[doc_id % {len(ENDS)} + 1] AS q FROM announcements)"


@query("tx19_query_analysis", f"""{with_(ANNOUNCEMENTS, _ASKED)},
    named0 AS (SELECT 0 AS g, * FROM ({_found('asked', 'q', r.CODE, 'code')}) UNION ALL SELECT 1, * FROM ({_found('asked', 'q', r.COMPANY, 'company')}) UNION ALL SELECT 2, * FROM ({_found('asked', 'q', r.INDUSTRY, 'industry')})),
    named AS (SELECT * FROM named0 QUALIFY row_number() OVER (PARTITION BY id, m ORDER BY g, s) = 1),
    c AS (SELECT id, q, length(regexp_split_to_array(q, '{r.CONNECTOR}')[1]) AS cs, length(regexp_extract(q, '{r.CONNECTOR}', 0)) AS cl FROM asked WHERE regexp_matches(q, '{r.CONNECTOR}')),
    sides AS (SELECT id, cs, cs + cl AS ce, regexp_extract(substr(q, 1, cs), '{r.LEFT_NAME}', 0) AS a, regexp_extract(substr(q, cs + cl + 1), '{r.RIGHT_NAME}', 1) AS b, regexp_extract(substr(q, cs + cl + 1), '{r.RIGHT_NAME}', 0) AS whole FROM c),
    pairs AS (SELECT * FROM sides WHERE a <> '' AND length(b) >= 2),
    taken AS (SELECT id, s, s + length(m) AS e FROM named UNION ALL SELECT id, cs - length(a), ce + length(whole) FROM pairs),
    owners AS (SELECT id, s, substr(m, 1, length(m) - 1) AS m FROM ({_found('asked', 'q', r.OWNER, 'owner')})),
    free AS (SELECT * FROM owners o WHERE NOT regexp_matches(m, '[和与跟]') AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.id = o.id AND o.s < t.e AND o.s + length(o.m) > t.s)),
    every AS (SELECT id, g, s, m FROM named UNION ALL SELECT id, 3, cs - length(a), a FROM pairs UNION ALL SELECT id, 4, ce, b FROM pairs UNION ALL SELECT id, 5, s, m FROM free),
    once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY id, m ORDER BY g, s) = 1),
    e AS (SELECT id, string_agg(m, '|' ORDER BY g, s) AS entities, count(*) AS n FROM once GROUP BY id),
    k AS (SELECT asked.id, q, coalesce(entities, '') AS entities, CASE WHEN (regexp_matches(q, '{r.PATH_WORDS}') OR regexp_matches(q, '{r.PAIR}')) AND n >= 2 THEN 'path_finding' WHEN regexp_matches(q, '{r.RELATION_WORDS}') THEN 'entity_relation' WHEN regexp_matches(q, '{r.STATE_WORDS}') THEN 'industry_state' ELSE 'entity_search' END AS query_type FROM asked LEFT JOIN e ON asked.id = e.id)
    SELECT id AS doc_id, entities, query_type, CASE query_type {" ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in r.INTENTS.items())} END AS intent, CASE query_type {" ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in r.INTENTS.items())} END AS strategy FROM k""")
def query_analysis(spark, sf):
    n = F.length("body")
    asked = F.concat(_pick(NAMES, n), _pick(LINKS, F.length("title")), _pick(NAMES, F.floor(n / 7)), _pick(ENDS, F.col("doc_id")))
    out = s.query_analysis(t.announcements(spark, sf).select("doc_id", asked.alias("query")), "doc_id")
    return out.select("doc_id", F.array_join("entities", "|").alias("entities"), "query_type", "intent", "strategy")


# ---- dictionary --------------------------------------------------------------------------------------------------
@query("jn9_dictionary_tags", f"""{with_(ANNOUNCEMENTS)}, names AS (SELECT DISTINCT name FROM (SELECT unnest(string_split(text, ' ')) AS name FROM benchmark) WHERE length(name) >= 5)
    SELECT doc_id, name AS tag FROM announcements JOIN names ON contains(title, name)""")
def dictionary_tags(spark, sf):
    """Every word of the benchmark table of five characters or more that stands in a document's title."""
    names = t.table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("name")).filter(F.length("name") >= 5)
    return s.dictionary_tags(t.announcements(spark, sf), names, "doc_id", "title")
