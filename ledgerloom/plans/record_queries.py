"""Queries of responses, checked signals, node merges, ledgers, chains and vector texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import ids
from ledgerloom.operators import graph as g
from ledgerloom.operators import records as op
from ledgerloom.operators.stages import stage_moves
from ledgerloom.plans.bindings import ANNOUNCEMENTS, EDGES, STOCKS, with_
from ledgerloom.plans.rule_queries import company_paths
from ledgerloom.plans.stage_queries import MOVED, notes
from ledgerloom.sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


# ---- raw answers about each document: its title's first words as entities, neighbours as relations, one of them dangling
_ANSWERS = """answers AS (SELECT doc_id, list_filter(string_split(title, ' '), lambda w: w <> '')[1:6] AS words FROM announcements),
    named AS (SELECT doc_id, w AS name, arg_min(CASE WHEN i % 2 = 0 THEN 'Company' ELSE 'Metric' END, i) AS type FROM (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM answers) GROUP BY 1, 2)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.slice(F.filter(F.split("title", " "), lambda w: w != ""), 1, 6)
    rows = t.announcements(spark, sf_dir).select("doc_id", F.explode(F.array(words)).alias("words"))
    entities = F.transform("words", lambda w, i: F.struct(w.alias("name"), F.when(i % 2 == 0, "Company").otherwise("Metric").alias("type")))
    links = F.transform("words", lambda w, i: F.struct(w.alias("entity1"), F.coalesce(F.get("words", i + 1), F.lit("nobody at all")).alias("entity2"), F.lit("d").alias("description"), (i * 0.1 + 0.5).alias("confidence")))
    raw = F.to_json(F.struct(entities.alias("entities"), links.alias("relations")))
    return rows.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), raw, F.lit("\n```\nDone."))).when(F.col("doc_id") % 3 == 1, raw).otherwise(F.concat(F.lit("```\n"), raw, F.lit("\n```"))).alias("raw"))


@query("tx17_response_entities", f"{with_(ANNOUNCEMENTS, _ANSWERS)} SELECT * FROM named")
def response_entities(spark, sf):
    return op.entities_and_relations(answers(spark, sf), "doc_id", "raw")[0]


@query("tx17_response_relations", f"""{with_(ANNOUNCEMENTS, _ANSWERS)} SELECT doc_id, a AS entity1, b AS entity2, round(0.5 + i * 0.1, 6) AS confidence, 'Fact' AS stmt_type FROM (SELECT doc_id, unnest(words) AS a, unnest(list_concat(words[2:], ['nobody at all'])) AS b, unnest(range(len(words))) AS i FROM answers) WHERE b <> 'nobody at all'""")
def response_relations(spark, sf):
    out = op.entities_and_relations(answers(spark, sf), "doc_id", "raw")[1]
    return out.select("doc_id", "entity1", "entity2", F.round("confidence", 6).alias("confidence"), "stmt_type")


# ---- signals that a model might have given, some of them not to be kept
_KINDS = ("mass_production", "capacity", "policy", "capex", "earnings", "order", "risk", "rumour")
_EXCERPTS = ("敬请投资者注意风险提示，", "公司面临诉讼处罚及减值风险", "ok", "订单大幅增长并于明年交付", "不确定性：风险提示")


def _pick(values, index: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[({index}) % {len(values)} + 1]"


MODEL_SIGNALS = f"""model_signals AS (SELECT doc_id, {_pick(_KINDS, "doc_id")} AS kind, {_pick(("positive", "negative", "risk", "neutral", "risk"), "doc_id // 3")} AS polarity, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE substr(title, 1, 10) END AS subject,
    {_pick(("company", "product", "sector", "policy", "person"), "doc_id // 2")} AS subject_type, (doc_id * 7 % 100)::INTEGER AS strength, {_pick(_EXCERPTS, "doc_id // 5")} AS excerpt FROM announcements)"""
_CLEANED = "excerpt"
for _phrase in op.DISCLAIMERS:
    _CLEANED = f"replace({_CLEANED}, '{_phrase}', '')"
_REASON = f"""CASE WHEN kind = 'rumour' THEN 'kind' WHEN polarity = 'neutral' THEN 'polarity' WHEN trim(subject) = '' THEN 'subject' WHEN subject_type = 'person' THEN 'subject_type' WHEN strength < 20 THEN 'strength'
    WHEN kind = 'risk' AND len(regexp_extract_all(regexp_replace({_CLEANED}, '[，。！？、；：\\s]', '', 'g'), '[一-鿿]')) < 6 THEN 'disclaimer' WHEN len(regexp_extract_all(excerpt, '[一-鿿]')) < 4 THEN 'excerpt' END"""


def model_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pick(values, index):
        return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))

    d = F.col("doc_id")
    return t.announcements(spark, sf_dir).select(
        "doc_id", pick(_KINDS, d).alias("kind"), pick(("positive", "negative", "risk", "neutral", "risk"), F.floor(d / 3)).alias("polarity"), F.when(d % 11 == 0, " ").otherwise(F.substring("title", 1, 10)).alias("subject"),
        pick(("company", "product", "sector", "policy", "person"), F.floor(d / 2)).alias("subject_type"), (d * 7 % 100).cast("int").alias("strength"), pick(_EXCERPTS, F.floor(d / 5)).alias("excerpt"),
    )


def _reason():
    return op.reject_reason(*[F.col(c) for c in ("kind", "polarity", "subject", "subject_type", "strength", "excerpt")])


@query("tx13_reject_reasons", f"{with_(ANNOUNCEMENTS, MODEL_SIGNALS)} SELECT doc_id, kind, {_REASON} AS reason FROM model_signals")
def reject_reasons(spark, sf):
    return model_signals(spark, sf).select("doc_id", "kind", _reason().alias("reason"))


@query("sg8_checked_signals", f"""{with_(ANNOUNCEMENTS, MODEL_SIGNALS)} SELECT 'LLM:' || substr(sha256(concat_ws('|', 'EV:' || doc_id, kind, subject, substr(excerpt, 1, 60))), 1, 20) AS signal_id, doc_id, kind, strength, least(100, trunc(strength * 0.7::DOUBLE + 20))::INTEGER AS value FROM model_signals WHERE {_REASON} IS NULL""")
def checked_signals(spark, sf):
    kept = model_signals(spark, sf).filter(_reason().isNull())
    key = ids.digest("LLM:", "|", [F.concat(F.lit("EV:"), F.col("doc_id").cast("string")), F.col("kind"), F.col("subject"), F.substring("excerpt", 1, 60)], 20)
    return kept.select(key.alias("signal_id"), "doc_id", "kind", "strength", F.least(F.lit(100), (F.col("strength") * 0.7 + 20).cast("int")).alias("value"))


@query("kg1_merged_nodes", """WITH o AS (SELECT p_partkey AS id, 'Product' AS type, p_name AS name, 0.8 AS confidence, CASE WHEN p_partkey % 4 > 0 THEN 'first' END AS source_name, CASE WHEN p_partkey % 6 = 0 THEN '2026-01-01' END AS valid_to, p_brand AS brand FROM part WHERE p_partkey % 3 < 2),
    n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'Planet' ELSE 'Product' END AS type, upper(p_name) AS name, (p_partkey % 10) / 10.0 AS confidence, 'second' AS source_name, '2026-06-01' AS valid_to, p_type AS kind, p_size::VARCHAR AS brand FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 10 > 0)
    SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, greatest(coalesce(o.confidence, 0), coalesce(n.confidence, 0))::DOUBLE AS confidence, coalesce(o.source_name, n.source_name) AS source_name, coalesce(o.valid_to, n.valid_to) AS valid_to, coalesce(n.brand, o.brand) AS brand, n.kind AS kind FROM o FULL JOIN n ON o.id = n.id""")
def merged_nodes(spark, sf):
    p, k = t.table(spark, sf, "part"), F.col("p_partkey")
    old = p.filter("p_partkey % 3 < 2").select(k.alias("id"), F.lit("Product").alias("type"), F.col("p_name").alias("name"), F.lit(0.8).alias("confidence"), F.when(k % 4 > 0, "first").alias("source_name"), F.when(k % 6 == 0, "2026-01-01").alias("valid_to"), F.create_map(F.lit("brand"), "p_brand").alias("props"))
    new = p.filter("p_partkey % 2 = 0").select(
        k.alias("id"), F.when(k % 10 == 0, "Planet").otherwise("Product").alias("type"), F.upper("p_name").alias("name"), (k % 10 / 10.0).alias("confidence"), F.lit("second").alias("source_name"), F.lit("2026-06-01").alias("valid_to"),
        F.create_map(F.lit("kind"), "p_type", F.lit("brand"), F.col("p_size").cast("string")).alias("props"),
    )
    out = op.merged_nodes(old, new)
    return out.select("id", "name", "confidence", "source_name", "valid_to", F.try_element_at("props", F.lit("brand")).alias("brand"), F.try_element_at("props", F.lit("kind")).alias("kind"))


@query("kg25_move_ledger", f"""{with_(ANNOUNCEMENTS, MOVED)}, m AS (SELECT *, doc_id % 50 AS company, doc_id // 50 AS day, CASE source_type WHEN 'explicit_pattern' THEN 0.85 WHEN 'adjacent_states' THEN 0.7 WHEN 'current_vs_historical' THEN 0.75 ELSE 0.65 END::DOUBLE AS confidence FROM moves)
    SELECT company, from_stage, to_stage, any_value(direction) AS direction, arg_min(evidence, (day, doc_id, ord)) AS evidence, arg_min(confidence, (day, doc_id, ord)) AS confidence, min(day) AS first_seen, max(day) AS last_seen FROM m GROUP BY 1, 2, 3""")
def move_ledger(spark, sf):
    moves = stage_moves(notes(spark, sf)).withColumn("company", F.col("doc_id") % 50).withColumn("day", F.floor(F.col("doc_id") / 50))
    return op.move_ledger(moves, "company", "day")


@query("kg11_chain_paths", f"""{with_(EDGES).replace('WITH', 'WITH RECURSIVE', 1)}, p AS (SELECT [src, dst] AS nodes, [weight] AS weights, dst AS last, [src || '>' || dst] AS used FROM edges WHERE src IN (SELECT 'C:' || s_suppkey FROM supplier WHERE s_suppkey % 100 = 0)
    UNION ALL SELECT list_append(nodes, dst), list_append(weights, weight), dst, list_append(used, src || '>' || dst) FROM p JOIN edges ON last = src WHERE len(weights) < 5 AND NOT list_contains(used, src || '>' || dst)) SELECT array_to_string(nodes, '>') AS path, len(weights)::INTEGER AS hops, round(list_sum(weights), 6) AS weight FROM p""")
def chain_paths(spark, sf):
    """Chains of up to five edges from the companies whose number is divisible by 100, the stated query set."""
    starts = t.table(spark, sf, "supplier").filter("s_suppkey % 100 = 0").select(F.concat(F.lit("C:"), "s_suppkey").alias("id"))
    out = op.chain_paths(t.edges(spark, sf), starts, 5)
    return out.select(F.array_join("nodes", ">").alias("path"), F.size("weights").alias("hops"), F.round(F.aggregate("weights", F.lit(0.0), lambda s, w: s + w), 6).alias("weight"))


_BEST = """best AS (SELECT src, mid, dst, hops, rels, weights FROM (
        SELECT src, NULL::VARCHAR AS mid, dst, weight AS score, 1 AS hops, [rel] AS rels, [weight] AS weights FROM edges WHERE src LIKE 'C:%'
        UNION ALL SELECT a.src, a.dst, b.dst, round(a.weight + b.weight, 4), 2, [a.rel, b.rel], [a.weight, b.weight] FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src LIKE 'C:%') QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, hops, dst, mid) <= 20)"""


@query("sg5_paths", f"""{with_(EDGES, _BEST)} SELECT src AS subject, array_to_string(list_filter([src, mid, dst], lambda x: x IS NOT NULL), '>') AS nodes, hops::INTEGER AS hops,
    CASE WHEN hops = 1 THEN src || '|' || rels[1] || '|' || dst || '|' || printf('%.4f', weights[1]) ELSE src || '|' || rels[1] || '|' || mid || '|' || printf('%.4f', weights[1]) || ';' || mid || '|' || rels[2] || '|' || dst || '|' || printf('%.4f', weights[2]) END AS edges FROM best""")
def paths(spark, sf):
    view = op.path_view(company_paths(spark, sf))
    shown = F.transform("edges", lambda e: F.concat_ws("|", e["src"], e["rel"], e["tgt"], F.format_string("%.4f", e["weight"])))
    return view.select("subject", F.array_join("nodes", ">").alias("nodes"), "hops", F.array_join(shown, ";").alias("edges"))


@query("kg20_path_edge_scores", f"""{with_(EDGES, _BEST)}, e AS (SELECT src AS f, coalesce(mid, dst) AS t, 2 AS d FROM best UNION ALL SELECT mid, dst, 3 FROM best WHERE hops = 2)
    SELECT least(f, t) AS a, greatest(f, t) AS b, round(sum(0.8 / d) * 1.000000000001, 6) AS score FROM e GROUP BY 1, 2""")
def path_edge_scores(spark, sf):
    out = op.path_edge_scores(company_paths(spark, sf).select(F.lit(0.8).alias("sim"), "nodes"))
    return out.select("a", "b", F.round(F.col("score") * 1.000000000001, 6).alias("score"))


@query("kg8_heaviest_neighbours", f"{with_(EDGES)} SELECT src, dst, rel, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst, rel) AS place FROM edges WHERE weight >= 0.3 AND rel IN ('SUPPLIES', 'USED_BY') QUALIFY place <= 20")
def heaviest_neighbours(spark, sf):
    """Each node's 20 heaviest neighbours; how many is the operator's parameter."""
    return op.neighbours(t.edges(spark, sf), ["SUPPLIES", "USED_BY"], 0.3, 20)


@query("jn13_company_products", """WITH m AS (SELECT DISTINCT l_orderkey AS doc, 'C:' || l_suppkey AS id, 'Company' AS type FROM lineitem UNION SELECT DISTINCT l_orderkey, 'P:' || l_partkey, 'Product' FROM lineitem),
    p AS (SELECT a.id AS src, b.id AS dst, CASE b.type WHEN 'Company' THEN 'peer' ELSE 'product' END AS kind FROM m a JOIN m b ON a.doc = b.doc AND a.type = 'Company' AND (b.type = 'Product' OR a.id < b.id))
    SELECT src, dst, kind, CASE kind WHEN 'peer' THEN 0.6 ELSE 0.7 END::DOUBLE AS weight, count(*) AS docs FROM p GROUP BY 1, 2, 3""")
def company_products(spark, sf):
    # numbers are gathered and counted, and the names that companies are put in order by come last
    lines = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("company"), F.col("l_partkey").alias("product"))
    name = lambda c: F.concat(F.lit("C:"), c)
    out = op.co_occurrences(lines, tasks=t.tasks(lines), order=name)
    return out.select(name(F.col("src")).alias("src"), F.when(F.col("kind") == "peer", name(F.col("dst"))).otherwise(F.concat(F.lit("P:"), "dst")).alias("dst"), "kind", "weight", "docs")


@query("vc1_point_texts", f"""{with_(STOCKS, ANNOUNCEMENTS)} SELECT 'entities' AS collection, code::VARCHAR AS point, name || ' ' || industry AS text FROM stocks
    UNION ALL SELECT 'relations', l_orderkey || ':' || l_linenumber, 'C:' || l_suppkey || ' 与 P:' || l_partkey || '：' || l_returnflag FROM lineitem
    UNION ALL SELECT 'chunks', doc_id::VARCHAR, concat_ws(chr(10), nullif(title, ''), substr(body, 1, 300)) FROM announcements UNION ALL SELECT 'evidence', doc_id::VARCHAR, substr(body, 1, 7000) FROM announcements""")
def point_texts(spark, sf):
    a = t.announcements(spark, sf)
    rows = {
        "entities": t.stocks(spark, sf).select(F.col("code").cast("string").alias("point"), "name", F.col("industry").alias("description")),
        "relations": t.table(spark, sf, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("point"), F.concat(F.lit("C:"), "l_suppkey").alias("src"), F.concat(F.lit("P:"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("description")),
        "chunks": a.select(F.col("doc_id").cast("string").alias("point"), F.col("title").alias("heading"), F.substring("body", 1, 300).alias("content")),
        "evidence": a.select(F.col("doc_id").cast("string").alias("point"), F.col("body").alias("content")),
    }
    out = [df.select(F.lit(name).alias("collection"), "point", op.point_text(name).alias("text")) for name, df in rows.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


_STATEMENTS = """statements AS (SELECT 'C:' || l_suppkey AS src, 'P:' || (l_partkey % 20) AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 'SUPPLIES' ELSE 'USES' END AS rel, 'S' || l_orderkey || '-' || l_linenumber AS source, l_shipdate::DATE AS valid_from,
    (['positive', 'negative', 'conflict', 'neutral', 'neutral'])[l_orderkey % 5 + 1] AS polarity FROM lineitem)"""


@query("kg4_statement_conflicts", f"""WITH {_STATEMENTS}, b AS (SELECT * FROM statements QUALIFY row_number() OVER (PARTITION BY src, dst, rel ORDER BY valid_from DESC, source DESC) <= 20),
    x AS (SELECT a.src, a.dst, a.rel, a.source, a.valid_from, b.source AS other_source, b.valid_from AS f, CASE WHEN (a.polarity = 'positive' AND b.polarity = 'negative') OR (a.polarity = 'negative' AND b.polarity = 'positive') THEN 'polarity_conflict' WHEN (a.polarity = 'conflict' OR b.polarity = 'conflict') AND a.source <> b.source THEN 'mixed_content_conflict' END AS kind
        FROM statements a JOIN b USING (src, dst, rel) WHERE a.polarity <> 'neutral' AND b.polarity <> 'neutral' AND NOT (a.valid_from = b.valid_from AND a.source = b.source))
    SELECT src, dst, rel, source, valid_from, other_source, kind FROM x WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY src, dst, rel, source, valid_from ORDER BY f DESC, other_source DESC) = 1""")
def statement_conflicts(spark, sf):
    """Contradictions against each pair's 20 newest statements; how many is the operator's parameter."""
    k = F.col("l_orderkey") % 5
    s = t.table(spark, sf, "lineitem").select(
        F.concat(F.lit("C:"), "l_suppkey").alias("src"), F.concat(F.lit("P:"), F.col("l_partkey") % 20).alias("dst"), F.when(F.col("l_linenumber") % 2 == 0, "SUPPLIES").otherwise("USES").alias("rel"), F.concat(F.lit("S"), "l_orderkey", F.lit("-"), "l_linenumber").alias("source"),
        F.to_date("l_shipdate").alias("valid_from"), F.when(k == 0, "positive").when(k == 1, "negative").when(k == 2, "conflict").otherwise("neutral").alias("polarity"),
    )
    return op.statement_conflicts(s)


@query("kg7_applied_merges", f"""{with_(EDGES)}, e AS (SELECT CASE WHEN src LIKE 'C:%' AND substr(src, 3)::BIGINT % 2 = 1 THEN 'CO:' || substr(src, 3) ELSE src END AS src, dst, rel, weight, ['t' || (n % 3)] AS texts, stmt_type, valid_from FROM edges),
    m AS (SELECT 'CO:' || s_suppkey AS id, CASE WHEN s_suppkey % 6 = 1 THEN 'C:' || (s_suppkey + 1) ELSE 'CO:' || s_suppkey END AS kept FROM supplier WHERE s_suppkey % 6 IN (1, 3) UNION ALL SELECT 'CO:' || (s_suppkey + 2), 'CO:' || least(s_suppkey::VARCHAR, (s_suppkey + 2)::VARCHAR) FROM supplier WHERE s_suppkey % 6 = 3
        UNION ALL SELECT 'CO:' || s_suppkey, 'CO:' || least(s_suppkey::VARCHAR, (s_suppkey + 2)::VARCHAR) FROM supplier WHERE s_suppkey % 6 = 3),
    k AS (SELECT id, min(kept) AS kept FROM m GROUP BY id), x AS (SELECT coalesce(a.kept, src) AS src, coalesce(b.kept, dst) AS dst, rel, weight, texts, stmt_type, valid_from FROM e LEFT JOIN k a ON src = a.id LEFT JOIN k b ON dst = b.id)
    SELECT src, dst, rel, max(weight) AS weight, list_sort(list_distinct(flatten(list(texts)))) AS texts, arg_max(stmt_type, CASE stmt_type WHEN 'Fact' THEN 3 WHEN 'Claim' THEN 2 ELSE 1 END) AS stmt_type, min(valid_from) AS valid_from FROM x WHERE src <> dst GROUP BY 1, 2, 3""")
def applied_merges(spark, sf):
    e = t.edges(spark, sf)
    odd = F.col("src").startswith("C:") & (F.substring("src", 3, 20).try_cast("long") % 2 == 1)
    e = e.select(F.when(odd, F.concat(F.lit("CO:"), F.substring("src", 3, 20))).otherwise(F.col("src")).alias("src"), "dst", "rel", "weight", F.array(F.concat(F.lit("t"), F.col("n") % 3)).alias("texts"), "stmt_type", "valid_from")
    k = F.col("s_suppkey")
    merge = F.when(k % 6 == 1, F.concat(F.lit("C:"), k + 1)).when(k % 6 == 3, F.concat(F.lit("CO:"), k + 2))
    pairs = t.table(spark, sf, "supplier").select(F.concat(F.lit("CO:"), "s_suppkey").alias("a"), merge.alias("b")).filter("b is not null")
    return op.applied_merges(e, pairs, "C:", g.RANKS)


@query("kg17_product_profiles", f"""{with_(EDGES)}, n AS (SELECT product, id, max(weight) AS weight FROM (SELECT dst AS product, src AS id, weight FROM edges WHERE dst LIKE 'P:%' UNION ALL SELECT src, dst, weight FROM edges WHERE src LIKE 'P:%') GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY product, id LIKE 'C:%' ORDER BY weight DESC, id) AS place FROM n)
    SELECT product, coalesce(list(id ORDER BY place) FILTER (id LIKE 'C:%' AND place <= 30), []) AS companies, coalesce(list(id ORDER BY place) FILTER (id NOT LIKE 'C:%' AND place <= 20), []) AS related FROM r GROUP BY product""")
def product_profiles(spark, sf):
    return op.product_profiles(t.edges(spark, sf))
