"""Whole operators beside queries that cut them: stated starting sets against all edges, and whole lists and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import graph as g
from ledgerloom.operators import packages as p
from ledgerloom.operators import rule_signals as op
from ledgerloom.operators.search import resolved
from ledgerloom.plans.bindings import ANNOUNCEMENTS, EDGES, QUESTIONS, STOCKS, with_
from ledgerloom.plans.rule_queries import _PATHS, PAYLOADS, _found, company_paths, payloads
from ledgerloom.sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


# ---- walks from the nodes whose number is divisible by 100, along all edges ---------------------------------------
_HUNDREDS = "regexp_extract(a.src, '[0-9]+$', 0)::BIGINT % 100 = 0"


def _hundreds(edges: DataFrame) -> DataFrame:
    return edges.filter(F.regexp_extract("src", "[0-9]+$", 0).cast("long") % 100 == 0)


@query("kg9_two_hops_hundreds", f"{with_(EDGES)} SELECT a.src, a.dst AS mid, b.dst, round(a.weight + b.weight, 4) AS score FROM edges a JOIN edges b ON a.dst = b.src WHERE {_HUNDREDS}")
def two_hops(spark, sf):
    e = t.edges(spark, sf).select("src", "dst", "weight")
    return g.chains(_hundreds(e), e)


@query("sg5_path_view_hundreds", f"{with_(EDGES)} SELECT a.src || '>' || a.dst || '>' || b.dst AS path, 2 AS hops FROM edges a JOIN edges b ON a.dst = b.src WHERE {_HUNDREDS} UNION ALL SELECT a.src || '>' || a.dst, 1 FROM edges a WHERE {_HUNDREDS}")
def path_view(spark, sf):
    e = t.edges(spark, sf).select("src", "dst", "weight")
    starts = _hundreds(e)
    two = g.chains(starts, e).select(F.concat_ws(">", "src", "mid", "dst").alias("path"), F.lit(2).alias("hops"))
    return two.unionByName(starts.select(F.concat_ws(">", "src", "dst").alias("path"), F.lit(1).alias("hops")))


@query("kg18_resolved_queries", f"""{with_(STOCKS)}, n AS (SELECT count(*) AS n FROM stocks), q AS (SELECT c_custkey AS query_id, CASE c_custkey % 5 WHEN 0 THEN (c_custkey % n)::VARCHAR WHEN 1 THEN 'Supplier#' || lpad((c_custkey % n)::VARCHAR, 9, '0') WHEN 2 THEN lpad((c_custkey % n)::VARCHAR, 4, '0') WHEN 3 THEN '' ELSE 'none ' || c_custkey END AS query FROM customer, n),
    m AS (SELECT query_id, code, 1.0::DOUBLE AS score FROM q JOIN stocks ON code::VARCHAR = query UNION ALL SELECT query_id, code, 0.9 FROM q JOIN stocks ON name = query UNION ALL SELECT query_id, code, 0.7 FROM q JOIN stocks ON contains(name, query) WHERE query <> '')
    SELECT query_id, code AS id, score FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code) = 1""")
def resolved_queries(spark, sf):
    n = t.table(spark, sf, "supplier").count()
    at, k = (F.col("c_custkey") % n).cast("string"), F.col("c_custkey") % 5
    text = F.when(k == 0, at).when(k == 1, F.concat(F.lit("Supplier#"), F.lpad(at, 9, "0"))).when(k == 2, F.lpad(at, 4, "0")).when(k == 3, "").otherwise(F.concat(F.lit("none "), "c_custkey"))
    queries = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), text.alias("query"))
    return resolved(t.stocks(spark, sf).select(F.col("code").alias("id"), "name"), queries)


_VALUE = "CASE WHEN regexp_matches(text, '\\d') THEN regexp_extract(text, '(\\d+\\.?\\d*)\\s*([万亿百]?[万亿百]?)', 1)::DOUBLE * CASE WHEN contains(unit, '万亿') THEN 1e12 WHEN contains(unit, '亿') THEN 1e8 WHEN contains(unit, '万') THEN 1e4 ELSE 1 END END"


@query("kg14_stated_divergence", f"""WITH s AS (SELECT 'C:' || l_suppkey AS entity, 'M:' || l_partkey % 40 AS metric, (['Fact', 'Estimate', 'Claim'])[l_linenumber % 3 + 1] AS stmt_type, l_orderkey * 8 + l_linenumber AS seq,
        (['约', '预计为', '没有数', ''])[l_orderkey % 4 + 1] || CASE WHEN l_orderkey % 4 = 2 THEN '' ELSE l_partkey % 97 || '.5' || (['亿', ' 万', '万亿', '元', '百万'])[l_orderkey % 5 + 1] END AS text FROM lineitem),
    u AS (SELECT *, regexp_extract(text, '(\\d+\\.?\\d*)\\s*([万亿百]?[万亿百]?)', 2) AS unit FROM s), v AS (SELECT *, {_VALUE} AS v FROM u),
    d AS (SELECT entity, metric, count(*) FILTER (stmt_type = 'Fact') AS facts, count(*) FILTER (stmt_type = 'Estimate') AS estimates, count(*) FILTER (stmt_type = 'Claim') AS claims, arg_min(v, (seq, v)) FILTER (stmt_type = 'Fact' AND v IS NOT NULL) AS fact_value, arg_min(v, (seq, v)) FILTER (stmt_type = 'Estimate' AND v IS NOT NULL) AS estimate_value FROM v GROUP BY 1, 2),
    x AS (SELECT *, CASE WHEN fact_value <> 0 THEN (estimate_value - fact_value) / abs(fact_value) * 100 END AS gap FROM d WHERE facts > 0 OR estimates > 0)
    SELECT entity, metric, facts, estimates, claims, fact_value, estimate_value, round(gap, 0) AS gap_pct, CASE WHEN gap > 0 THEN 'bullish' WHEN gap < 0 THEN 'bearish' WHEN gap = 0 THEN 'neutral' END AS direction FROM x""")
def stated_divergence(spark, sf):
    at = lambda words, k: F.get(F.array(*[F.lit(w) for w in words]), (k % len(words)).cast("int"))
    order = F.col("l_orderkey")
    text = F.concat(at(("约", "预计为", "没有数", ""), order), F.when(order % 4 == 2, "").otherwise(F.concat((F.col("l_partkey") % 97).cast("string"), F.lit(".5"), at(("亿", " 万", "万亿", "元", "百万"), order))))
    lines = t.table(spark, sf, "lineitem").select(
        F.concat(F.lit("C:"), "l_suppkey").alias("entity"), F.concat(F.lit("M:"), (F.col("l_partkey") % 40).cast("string")).alias("metric"), at(("Fact", "Estimate", "Claim"), F.col("l_linenumber")).alias("stmt_type"),
        (order * 8 + F.col("l_linenumber")).alias("seq"), text.alias("text"),
    )
    return p.divergence(lines).withColumn("gap_pct", F.round("gap_pct", 0))


@query("wn15_material_packages", f"""{with_(QUESTIONS)}, r AS (SELECT *, conv_id % 7 AS stock, DATE '2026-01-01' + (conv_id % 90)::INTEGER AS day, conv_id * 100 + turn AS seq FROM questions), n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY stock ORDER BY day DESC, seq DESC) <= 50)
    SELECT stock, count(*) AS pairs, min(day) AS first_day, max(day) AS last_day, md5(string_agg(coalesce(question, '') || '|' || substr(coalesce(answer, ''), 1, 300), chr(10) ORDER BY day DESC, seq DESC)) AS material_md5 FROM n GROUP BY stock""")
def material_packages(spark, sf):
    pairs = t.questions(spark, sf).withColumns({"stock": F.col("conv_id") % 7, "day": F.date_add(F.lit("2026-01-01").cast("date"), (F.col("conv_id") % 90).cast("int")), "seq": F.col("conv_id") * 100 + F.col("turn")})
    told = F.array_join(F.transform("material", lambda m: F.concat(m["question"], F.lit("|"), m["answer"])), "\n")
    return p.material_package(pairs, "stock", "day", "seq").select("stock", "pairs", "first_day", "last_day", F.md5(told).alias("material_md5"))


@query("jn8_signal_details", f"""{with_(ANNOUNCEMENTS, PAYLOADS, _found('payloads'), EDGES, _PATHS)},
    x AS (SELECT signal_id, dst AS target, concat_ws(' ', src, CASE WHEN hops = 2 THEN '-[' || rels[1] || ']-> ' || mid END, '-[' || rels[hops] || ']-> ' || dst) AS relation_path, round((confidence * 0.3 + strength / 100 * 0.3 + list_sum(weights) / hops * 0.4 - 0.04 * (hops - 1)) * 1.000000000001, 3) AS c FROM told JOIN best ON subject = src)
    SELECT told.signal_id, kind, count(x.target) AS n, md5(coalesce(string_agg(target || '@' || relation_path, chr(10) ORDER BY c DESC, target, relation_path), '')) AS propagations_md5 FROM told LEFT JOIN x ON told.signal_id = x.signal_id GROUP BY 1, 2""")
def signal_details(spark, sf):
    """All propagations of every signal, along its company's 20 best paths; how many is the paths' own parameter."""
    companies = t.table(spark, sf, "supplier").count()
    signals = op.rule_signals(payloads(spark, sf)).dropDuplicates(["signal_id"])
    signals = signals.select("signal_id", F.concat(F.lit("C:"), F.col("source_id").cast("long") % companies).alias("subject"), "kind", "polarity", "strength", "confidence")
    out = op.path_details(signals, company_paths(spark, sf), lambda c: F.round(c * 1.000000000001, 3))
    told = F.array_join(F.transform("propagations", lambda x: F.concat(x["target"], F.lit("@"), x["relation_path"])), "\n")
    return out.select("signal_id", "kind", F.size("propagations").cast("long").alias("n"), F.md5(told).alias("propagations_md5"))


@query("vc6_vector_work", """WITH n AS (SELECT count(*) + 200 AS n FROM documents), c AS (SELECT doc_id AS id FROM documents UNION SELECT doc_id + 1000000 FROM documents), v AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 <> 0),
    a AS (SELECT id, arg_max(ok, seq) AS last_ok, count(*) FILTER (NOT ok) AS failures FROM (SELECT event_id % (SELECT n FROM n) AS id, event_id AS seq, event_type <> 'error' AND event_type <> 'view' AS ok FROM events) GROUP BY id)
    SELECT c.id, CASE WHEN coalesce(last_ok, true) THEN 'index' WHEN failures >= 3 THEN 'give_up' ELSE 'retry' END AS action, coalesce(failures, 0) AS failures FROM c LEFT JOIN a ON c.id = a.id WHERE c.id NOT IN (SELECT id FROM v)""")
def vector_work(spark, sf):
    docs = t.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    n = docs.count() + 200
    chunks = docs.unionByName(docs.select((F.col("id") + 1_000_000).alias("id")))
    vectors = t.table(spark, sf, "embeddings").filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("id"))
    attempts = t.table(spark, sf, "events").select((F.col("event_id") % n).alias("id"), F.col("event_id").alias("seq"), (~F.col("event_type").isin("error", "view")).alias("ok"))
    return p.vector_work(chunks, vectors, attempts)
