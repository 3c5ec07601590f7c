"""Registered queries over extraction results, profiles, packages and searches, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import ids, rules
from ledgerloom.operators import documents as d
from ledgerloom.operators import extraction as x
from ledgerloom.operators import graph as g
from ledgerloom.operators import market as m
from ledgerloom.operators import upsert as u
from ledgerloom.operators.folds import lag_in_blocks
from ledgerloom.plans.bindings import ANNOUNCEMENTS, BARS, EDGES, HEAT, MEMBERS, QUESTIONS, RUNS, STOCKS, steady, with_
from ledgerloom.sources import tables as t

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


STAGES = {"research": ["the", "of"], "trial": ["tion", "ing"], "mass": ["er", "and"]}
HITS = lambda col, kws: " + ".join(f"contains({col}, '{k}')::INTEGER" for k in kws)


def _stage_sql(col: str) -> str:
    n = [f"({HITS(col, v)})" for v in STAGES.values()]
    names = list(STAGES)
    return f"CASE WHEN greatest({', '.join(n)}) = 0 THEN NULL " + " ".join(f"WHEN {n[i]} = greatest({', '.join(n)}) THEN '{names[i]}'" for i in reversed(range(len(n)))) + " END"


_MENTIONS = "mentions AS (SELECT p_type AS name, CASE p_size % 3 WHEN 0 THEN 'Company' WHEN 1 THEN 'Product' ELSE 'Metric' END AS type, p_brand AS source FROM part)"


@query("ag8_entity_merge", f"""WITH {_MENTIONS}, c AS (SELECT name, type, count(*) AS c, CASE type WHEN 'Company' THEN 0 WHEN 'Product' THEN 1 ELSE 2 END AS o FROM mentions GROUP BY 1, 2)
    SELECT name, arg_max(type, c * 10 + o) AS type, sum(c)::BIGINT AS mentions, (SELECT count(DISTINCT source) FROM mentions m WHERE m.name = c.name)::INTEGER AS sources FROM c GROUP BY name""")
def entity_merge(spark, sf):
    k = F.col("p_size") % 3
    return x.merge_entities(t.table(spark, sf, "part").select(F.col("p_type").alias("name"), F.when(k == 0, "Company").when(k == 1, "Product").otherwise("Metric").alias("type"), F.col("p_brand").alias("source")))


@query("ag9_relation_merge", f"""SELECT l_suppkey AS src, l_partkey % 50 AS dst, count(DISTINCT l_returnflag || l_linenumber) AS texts,
    CASE WHEN count(*) FILTER (l_tax > 0.06) > 0 AND count(*) FILTER (l_tax < 0.01) > 0 THEN 'conflict' WHEN count(*) FILTER (l_tax > 0.06) > 0 THEN 'positive' WHEN count(*) FILTER (l_tax < 0.01) > 0 THEN 'negative' ELSE 'neutral' END AS direction,
    {steady('sum(greatest(0.0, l_discount - 0.02))', 4)} AS weight FROM lineitem GROUP BY 1, 2""")
def relation_merge(spark, sf):
    lines = t.table(spark, sf, "lineitem")
    sign = F.when(F.col("l_tax") > 0.06, 1).when(F.col("l_tax") < 0.01, -1).otherwise(0)
    return x.merge_relations(lines.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"), F.concat("l_returnflag", "l_linenumber").alias("text"), sign.alias("direction"), (F.col("l_discount") - 0.02).alias("weight")))


@query("tx7_life_cycle_stage", f"{with_(ANNOUNCEMENTS)} SELECT doc_id, {_stage_sql('title')} AS stage FROM announcements")
def life_cycle(spark, sf):
    return t.announcements(spark, sf).select("doc_id", x.stage(F.col("title"), STAGES).alias("stage"))


@query("tx10_stage_change", f"""{with_(ANNOUNCEMENTS)}, h AS (SELECT doc_id, substr(title, 1, floor(length(title) * 2 / 3)::INTEGER) AS a, substr(title, floor(length(title) * 2 / 3)::INTEGER + 1) AS b FROM announcements)
    SELECT doc_id, {_stage_sql('a')} AS previous, {_stage_sql('b')} AS current FROM h""")
def stage_change(spark, sf):
    before, now = x.transitions(F.col("title"), STAGES)
    return t.announcements(spark, sf).select("doc_id", before.alias("previous"), now.alias("current"))


@query("tx8_transition_matrix", f"""{with_(ANNOUNCEMENTS)}, h AS (SELECT doc_id, {_stage_sql('title')} AS stage, source FROM announcements), p AS (SELECT source, doc_id, stage, lag(stage) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM h WHERE stage IS NOT NULL),
    ok AS (SELECT * FROM (VALUES ('research', 'trial', 'forward'), ('trial', 'mass', 'forward'), ('mass', 'trial', 'back')) v(before, stage, direction)) SELECT doc_id, p.before, p.stage, direction FROM p JOIN ok USING (before, stage)""")
def transition_matrix(spark, sf):
    staged = t.announcements(spark, sf).select("doc_id", "source", x.stage(F.col("title"), STAGES).alias("stage")).filter("stage is not null")
    moves = lag_in_blocks(staged, "source", "doc_id", "stage", "before")
    allowed = spark.createDataFrame([("research", "trial", "forward"), ("trial", "mass", "forward"), ("mass", "trial", "back")], "before string, stage string, direction string")
    return moves.join(F.broadcast(allowed), ["before", "stage"]).select("doc_id", "before", "stage", "direction")


@query("tx13_signal_validation", """SELECT event_id, event_type AS kind, CASE WHEN event_type NOT IN ('purchase', 'click', 'view') THEN 'kind' WHEN value IS NULL OR value < 20 THEN 'strength' WHEN length(trim(CASE WHEN user_id % 9 = 0 THEN ' ' ELSE user_id::VARCHAR END)) = 0 THEN 'subject' END AS reject_reason FROM events""")
def validation(spark, sf):
    s = t.table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), F.col("value").alias("strength"), F.when(F.col("user_id") % 9 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("subject"))
    return s.select("event_id", "kind", x.reject_reason(s, ["purchase", "click", "view"], 20).alias("reject_reason"))


@query("tx17_parsed_responses", """SELECT event_id, (props->>'k')::BIGINT AS k, props->>'missing' AS missing FROM events""")
def parsed(spark, sf):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    bare = F.regexp_replace(F.regexp_replace(fenced, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return t.table(spark, sf, "events").select("event_id", F.from_json(bare, "k long, missing string").alias("j")).select("event_id", "j.k", "j.missing")


@query("kg5_resolved_names", f"""{with_(STOCKS)}, a AS (SELECT lower(name) AS alias, code AS id, 1 AS p FROM stocks UNION ALL SELECT lower(industry), code, 2 FROM stocks UNION ALL SELECT code::VARCHAR, code, 3 FROM stocks), k AS (SELECT alias, arg_min(id, p * 100000000::BIGINT + id) AS id FROM a WHERE alias <> '' GROUP BY alias),
    q AS (SELECT n_name AS name FROM nation UNION ALL SELECT upper(s_name) FROM supplier UNION ALL SELECT 'nobody ' || r_regionkey FROM region) SELECT q.name, coalesce(k.id::VARCHAR, 'CO:' || substr(md5(q.name), 1, 12)) AS entity FROM q LEFT JOIN k ON lower(q.name) = k.alias""")
def resolved(spark, sf):
    s = t.stocks(spark, sf)
    table = x.alias_table([(1, s.select(F.col("name").alias("alias"), F.col("code").alias("id"))), (2, s.select(F.col("industry").alias("alias"), F.col("code").alias("id"))), (3, s.select(F.col("code").cast("string").alias("alias"), F.col("code").alias("id")))])
    q = t.table(spark, sf, "nation").select(F.col("n_name").alias("name")).union(t.table(spark, sf, "supplier").select(F.upper("s_name"))).union(t.table(spark, sf, "region").select(F.concat(F.lit("nobody "), "r_regionkey")))
    joined = q.join(table, F.lower("name") == F.col("alias"), "left")
    return joined.select("name", F.coalesce(F.col("id").cast("string"), ids.entity_id("Company", F.col("name"))).alias("entity"))


@query("kg27_alias_merge", """WITH e AS (SELECT c_name AS alias, c_custkey AS id, c_custkey % 4 = 0 AS manual FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT c_name AS alias, c_custkey + 1 AS id, false AS manual FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT * FROM e WHERE manual) SELECT * FROM b UNION ALL SELECT * FROM n WHERE alias NOT IN (SELECT alias FROM b)""")
def alias_merge(spark, sf):
    c = t.table(spark, sf, "customer")
    old = c.filter("c_custkey % 3 = 0").select(F.col("c_name").alias("alias"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4 == 0).alias("manual"))
    new = c.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("alias"), (F.col("c_custkey") + 1).alias("id"), F.lit(False).alias("manual"))
    return x.merge_aliases(old, new, full=True)


@query("kg15_neighbour_metrics", f"{with_(EDGES)} SELECT src, count(*) FILTER (stmt_type = 'Fact') AS facts, count(*) FILTER (stmt_type = 'Estimate') AS estimates, max(weight) AS best FROM edges GROUP BY 1")
def neighbour_metrics(spark, sf):
    return t.edges(spark, sf).groupBy("src").agg(F.count_if(F.col("stmt_type") == "Fact").alias("facts"), F.count_if(F.col("stmt_type") == "Estimate").alias("estimates"), F.max("weight").alias("best"))


@query("kg17_profiles", f"""{with_(EDGES)}, k AS (SELECT src, dst, weight FROM edges WHERE rel = 'SUPPLIES' QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 5) SELECT src, list(dst ORDER BY weight DESC, dst) AS products, count(*) AS n FROM k GROUP BY 1""")
def profiles(spark, sf):
    top = g.heaviest(t.edges(spark, sf).filter("rel = 'SUPPLIES'").select("src", "dst", "weight"), 5)
    return top.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "dst"))), lambda v: v["dst"]).alias("products"), F.count(F.lit(1)).alias("n"))


@query("kg23_clean_edges", f"""{with_(EDGES)} SELECT src, dst, 'RELATES' AS rel, CASE rel WHEN 'SUPPLIES' THEN 'upstream' ELSE 'downstream' END AS subtype FROM edges WHERE src IN (SELECT 'C:' || s_suppkey FROM supplier WHERE s_acctbal > 0) OR src LIKE 'P:%'""")
def clean_edges(spark, sf):
    kept = t.table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("C:"), "s_suppkey").alias("src"))
    e = t.edges(spark, sf).select("src", "dst", F.lit("RELATES").alias("to"), F.when(F.col("rel") == "SUPPLIES", "upstream").otherwise("downstream").alias("subtype"))
    return e.filter(F.col("src").startswith("P:")).unionByName(e.filter(~F.col("src").startswith("P:")).join(kept, "src", "left_semi")).withColumnRenamed("to", "rel")


@query("kg24_back_filled_validity", f"{with_(EDGES)} SELECT src, dst, valid_from, CASE WHEN n % 3 = 0 THEN NULL ELSE valid_from + n::INTEGER END::DATE AS was, coalesce(CASE WHEN n % 3 = 0 THEN NULL ELSE valid_from + n::INTEGER END, valid_from)::DATE AS valid_to FROM edges")
def back_filled(spark, sf):
    was = F.when(F.col("n") % 3 != 0, F.date_add("valid_from", F.col("n").cast("int")))
    return t.edges(spark, sf).select("src", "dst", "valid_from", was.alias("was"), F.coalesce(was, "valid_from").alias("valid_to"))


@query("jn14_user_hits", f"""WITH s AS (SELECT event_id AS signal_id, unnest(['Supplier#' || lpad((user_id % 40)::VARCHAR, 9, '0'), event_type]) AS n FROM events WHERE event_type = 'error'),
    h AS (SELECT c_custkey % 7 AS usr, CASE WHEN c_custkey % 2 = 0 THEN 'Supplier#' || lpad((c_custkey % 40)::VARCHAR, 9, '0') ELSE '#' || lpad((c_custkey % 40)::VARCHAR, 9, '0') END AS name FROM customer WHERE c_custkey < 60)
    SELECT signal_id, usr AS "user", list_sort(list(DISTINCT name)) AS names FROM s JOIN h ON n = name OR (length(n) >= 2 AND length(name) >= 2 AND (contains(n, name) OR contains(name, n))) GROUP BY 1, 2""")
def user_hits(spark, sf):
    s = t.table(spark, sf, "events").filter("event_type = 'error'").select(F.col("event_id").alias("signal_id"), F.array(F.concat(F.lit("Supplier#"), F.lpad((F.col("user_id") % 40).cast("string"), 9, "0")), "event_type").alias("names"))
    number = F.lpad((F.col("c_custkey") % 40).cast("string"), 9, "0")
    h = t.table(spark, sf, "customer").filter("c_custkey < 60").select((F.col("c_custkey") % 7).alias("user"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "Supplier#").otherwise("#"), number).alias("name"))
    return x.user_hits(s, h)


@query("jn14_user_hits_whole", f"""WITH s AS (SELECT event_id AS signal_id, unnest(['Supplier#' || lpad((user_id % 40)::VARCHAR, 9, '0'), event_type]) AS n FROM events WHERE event_type = 'error'),
    h AS (SELECT DISTINCT c_custkey % 7 AS usr, CASE WHEN c_custkey % 2 = 0 THEN 'Supplier#' || lpad((c_custkey % 40)::VARCHAR, 9, '0') ELSE '#' || lpad((c_custkey % 40)::VARCHAR, 9, '0') END AS name FROM customer)
    SELECT signal_id, usr AS "user", list_sort(list(DISTINCT name)) AS names FROM s JOIN h ON n = name OR (length(n) >= 2 AND length(name) >= 2 AND (contains(n, name) OR contains(name, n))) GROUP BY 1, 2""")
def user_hits_whole(spark, sf):
    s = t.table(spark, sf, "events").filter("event_type = 'error'").select(F.col("event_id").alias("signal_id"), F.array(F.concat(F.lit("Supplier#"), F.lpad((F.col("user_id") % 40).cast("string"), 9, "0")), "event_type").alias("names"))
    number = F.lpad((F.col("c_custkey") % 40).cast("string"), 9, "0")
    h = t.table(spark, sf, "customer").select((F.col("c_custkey") % 7).alias("user"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "Supplier#").otherwise("#"), number).alias("name"))
    return x.user_hits(s, h)


@query("src6_membership_load", """WITH raw AS (SELECT p_brand AS concept, CASE WHEN p_partkey % 7 = 0 THEN 'bad' ELSE lpad((600000 + p_partkey % 300)::VARCHAR, 6, '0') END AS code FROM part)
    SELECT DISTINCT concept, code || '.SH' AS code FROM raw WHERE code <> 'bad' AND (code::VARCHAR) IN (SELECT (600000 + s_suppkey)::VARCHAR FROM supplier)""")
def membership(spark, sf):
    raw = t.table(spark, sf, "part").select(F.col("p_brand").alias("concept"), rules.normalised_code(F.when(F.col("p_partkey") % 7 == 0, "bad").otherwise((600000 + F.col("p_partkey") % 300).cast("string"))).alias("code"))
    listed = t.table(spark, sf, "supplier").select(F.concat((F.col("s_suppkey") + 600000).cast("string"), F.lit(".SH")).alias("code"))
    return raw.filter("code is not null").dropDuplicates().join(listed, "code", "left_semi").select("concept", "code")


@query("src12_file_names", r"""SELECT page_id, regexp_extract('ann_' || page_id || '_' || url, '^ann_(\d+)_', 1) AS id, regexp_extract(url, '(\d{3})', 1) AS number FROM pages""")
def file_names(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", F.regexp_extract(F.concat(F.lit("ann_"), "page_id", F.lit("_"), "url"), r"^ann_(\d+)_", 1).alias("id"), F.regexp_extract("url", r"(\d{3})", 1).alias("number"))


@query("src14_intake_actions", f"""{with_(ANNOUNCEMENTS)} SELECT doc_id, CASE WHEN source = 'src0' THEN 'out_of_scope' WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'repair' WHEN doc_id % 3 = 0 THEN 'known' WHEN contains(title, 'tion') THEN 'fetch' ELSE 'index' END AS action FROM announcements""")
def intake(spark, sf):
    docs = t.announcements(spark, sf)
    known = docs.filter("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") % 2 == 0).alias("no_file"))
    action = F.when(F.col("source") == "src0", "out_of_scope").when(F.col("no_file"), "repair").when(F.col("no_file").isNotNull(), "known").when(F.contains(F.col("title"), F.lit("tion")), "fetch").otherwise("index")
    return docs.join(known, "doc_id", "left").select("doc_id", action.alias("action"))


@query("flt2_kinds", f"{with_(RUNS)} SELECT run_id, task FROM runs WHERE kind IS NULL OR kind NOT LIKE 'v%'")
def kinds(spark, sf):
    return t.runs(spark, sf).filter(F.col("kind").isNull() | ~F.col("kind").startswith("v")).select("run_id", "task")


@query("flt8_scope", f"{with_(BARS, STOCKS)} SELECT code, count(*) AS bars FROM bars WHERE code IN (SELECT code FROM stocks WHERE industry LIKE 'NATION_1%') GROUP BY 1")
def scope(spark, sf):
    return t.bars(spark, sf).join(F.broadcast(t.stocks(spark, sf).filter(F.col("industry").like("NATION_1%")).select("code")), "code", "left_semi").groupBy("code").agg(F.count(F.lit(1)).alias("bars"))


@query("wn13_anomaly_labels", f"""{with_(BARS)}, l AS (SELECT code, trade_date, pct_chg, volume / nullif(lag(volume) OVER (PARTITION BY code ORDER BY trade_date), 0) AS ratio FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1)
    SELECT code, trade_date, list_filter([CASE WHEN pct_chg >= 9.9 THEN 'limit_up' END, CASE WHEN pct_chg <= -9.9 THEN 'limit_down' END, CASE WHEN ratio >= 2 THEN 'volume_surge' END, CASE WHEN ratio <= 0.5 THEN 'volume_dry' END], lambda v: v IS NOT NULL) AS labels FROM l""")
def anomalies(spark, sf):
    bars = m.with_pre_close(t.bars(spark, sf)).withColumn("ratio", F.col("volume") / F.nullif(F.lag("volume").over(m.by_date()), F.lit(0)))
    last = m.latest(bars.select("code", "trade_date", "pct_chg", "ratio"), "code", "trade_date")
    labels = F.array_compact(F.array(F.when(F.col("pct_chg") >= 9.9, "limit_up"), F.when(F.col("pct_chg") <= -9.9, "limit_down"), F.when(F.col("ratio") >= 2, "volume_surge"), F.when(F.col("ratio") <= 0.5, "volume_dry")))
    return last.select("code", "trade_date", labels.alias("labels"))


@query("wn14_stock_package", f"""{with_(BARS, STOCKS, MEMBERS)}, r AS (SELECT code, trade_date, close FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) <= 20), c AS (SELECT code, list(close ORDER BY trade_date) AS candles, max(trade_date) AS trade_date FROM r GROUP BY 1), k AS (SELECT code, list_sort(list(concept)) AS concepts FROM members GROUP BY 1)
    SELECT s.code, name, industry, trade_date, candles, concepts FROM stocks s LEFT JOIN c ON s.code = c.code LEFT JOIN k ON s.code = k.code""")
def package(spark, sf):
    recent = x.newest_k(t.bars(spark, sf).select("code", "trade_date", "close"), "code", [F.desc("trade_date")], 20)
    candles = recent.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("trade_date", "close"))), lambda v: v["close"]).alias("candles"), F.max("trade_date").alias("trade_date"))
    concepts = t.members(spark, sf).groupBy("code").agg(F.array_sort(F.collect_list("concept")).alias("concepts"))
    return t.stocks(spark, sf).join(candles, "code", "left").join(concepts, "code", "left").select("code", "name", "industry", "trade_date", "candles", "concepts")


@query("wn15_material_package", f"""{with_(QUESTIONS)}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM questions QUALIFY rn <= 3) SELECT conv_id, count(*) AS pairs, list(substr(coalesce(answer, ''), 1, 30) ORDER BY rn) AS answers FROM r GROUP BY 1""")
def material(spark, sf):
    recent = x.newest_k(t.questions(spark, sf), "conv_id", [F.desc("turn")], 3)
    return recent.groupBy("conv_id").agg(F.count(F.lit(1)).alias("pairs"), F.transform(F.array_sort(F.collect_list(F.struct("rn", F.substring(F.coalesce("answer", F.lit("")), 1, 30).alias("a")))), lambda v: v["a"]).alias("answers"))


@query("tk4_nulls_last", f"{with_(BARS)} SELECT code, trade_date, pct_chg IS NULL AS first_bar, row_number() OVER (PARTITION BY code ORDER BY pct_chg DESC NULLS LAST, trade_date) AS rn FROM bars QUALIFY rn <= 3")
def nulls_last(spark, sf):
    rn = F.row_number().over(Window.partitionBy("code").orderBy(F.desc_nulls_last("pct_chg"), "trade_date"))
    return m.with_pre_close(t.bars(spark, sf)).select("code", "trade_date", F.col("pct_chg").isNull().alias("first_bar"), rn.alias("rn")).filter("rn <= 3")


@query("ag11_knowledge_packages", f"""{with_(EDGES, RUNS)}, e AS (SELECT src, count(*) AS edges, count(*) FILTER (stmt_type = 'Fact') AS facts, round(avg(weight) * 1.000000000001, 4) AS mean_weight FROM edges WHERE rel = 'SUPPLIES' GROUP BY 1), s AS (SELECT 'C:' || (task % 10) AS src, count(*) AS signals, max(started_at) AS newest FROM runs GROUP BY 1)
    SELECT e.src, edges, facts, mean_weight, coalesce(signals, 0) AS signals, newest FROM e LEFT JOIN s ON e.src = s.src""")
def packages(spark, sf):
    e = t.edges(spark, sf).filter("rel = 'SUPPLIES'").groupBy("src").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("stmt_type") == "Fact").alias("facts"), F.round(F.avg("weight") * 1.000000000001, 4).alias("mean_weight"))
    s = t.runs(spark, sf).groupBy(F.concat(F.lit("C:"), F.col("task") % 10).alias("src")).agg(F.count(F.lit(1)).alias("signals"), F.max("started_at").alias("newest"))
    return e.join(s, "src", "left").select("src", "edges", "facts", "mean_weight", F.coalesce("signals", F.lit(0)).alias("signals"), "newest")


@query("ag13_whitelist", f"""{with_(MEMBERS)}, a AS (SELECT code FROM members WHERE concept IN ('Brand#1', 'Brand#2') UNION SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 1), b AS (SELECT * FROM a EXCEPT SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 0) SELECT code FROM b""")
def tech_whitelist(spark, sf):
    by_concept = t.members(spark, sf).filter(F.col("concept").isin("Brand#1", "Brand#2")).select("code")
    s = t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"))
    return by_concept.union(s.filter("code % 10 = 1")).distinct().subtract(s.filter("code % 4 = 0"))


@query("ag14_consistency", """WITH r AS (SELECT page_id AS id FROM pages), f AS (SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0) SELECT (SELECT count(*) FROM r) AS records, (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM r WHERE id NOT IN (SELECT id FROM f)) AS without_file, (SELECT count(*) FROM f WHERE id NOT IN (SELECT id FROM r)) AS without_record""")
def consistency(spark, sf):
    r = t.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit(1).alias("r"))
    f = t.table(spark, sf, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.lit(1).alias("f"))
    return r.join(f, "id", "full").agg(F.count("r").alias("records"), F.count("f").alias("files"), F.count_if(F.col("f").isNull()).alias("without_file"), F.count_if(F.col("r").isNull()).alias("without_record"))


@query("sg2_signal_rows", f"""{with_(ANNOUNCEMENTS)} SELECT 'SIG:' || substr(sha256(concat_ws('|', 'evidence', doc_id::VARCHAR, lower(regexp_replace(source, '\\s+', '', 'g')), lang, lower(regexp_replace(substr(title, 1, 120), '\\s+', '', 'g')))), 1, 20) AS signal_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN 100 ELSE 50 END AS freshness FROM announcements""")
def signal_rows(spark, sf):
    return t.announcements(spark, sf).select(ids.signal_id(F.lit("evidence"), F.col("doc_id"), F.col("source"), F.col("lang"), F.col("title")).alias("signal_id"), "doc_id", F.when(F.col("doc_id") % 2 == 0, 100).otherwise(50).alias("freshness"))


@query("sg9_status_changes", """WITH s AS (SELECT event_id AS id, 'new' AS status FROM events), c AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'archived' WHEN 2 THEN 'bogus' ELSE 'new' END AS status FROM events WHERE event_type = 'click') SELECT s.id, coalesce(c.status, s.status) AS status FROM s LEFT JOIN c ON s.id = c.id AND c.status IN ('new', 'read', 'archived')""")
def status_changes(spark, sf):
    e = t.table(spark, sf, "events")
    k = F.col("event_id") % 4
    change = e.filter("event_type = 'click'").select(F.col("event_id").alias("id"), F.when(k == 0, "read").when(k == 1, "archived").when(k == 2, "bogus").otherwise("new").alias("status"))
    return u.upsert(e.select(F.col("event_id").alias("id"), F.lit("new").alias("status")), change.filter(F.col("status").isin("new", "read", "archived")), ["id"])


@query("dc1_page_lines", r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
    SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (trim(s) <> '' AND NOT regexp_matches(lower(s), '^\s*(-?\s*\d+\s*-?|page \d+( of \d+)?|第\s*\d+\s*页)\s*$')), '') AS text FROM l GROUP BY 1""")
def page_lines(spark, sf):
    return t.announcements(spark, sf).select("doc_id", d.drop_page_lines(F.col("body")).alias("text"))


@query("dc12_evidence_trace", f"""{with_(EDGES)} SELECT l_orderkey AS evidence, count(DISTINCT l_suppkey) AS subjects, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 3""")
def trace(spark, sf):
    lines = t.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("evidence")).agg(F.countDistinct("l_suppkey").alias("subjects"))
    return lines.join(t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("evidence"), "o_totalprice"), "evidence")


@query("rd2_failure_first", f"{with_(RUNS)} SELECT task, run_id, status, started_at FROM runs QUALIFY row_number() OVER (PARTITION BY task ORDER BY (status = 'failed') DESC, started_at DESC, run_id DESC) = 1")
def failure_first(spark, sf):
    return t.runs(spark, sf).groupBy("task").agg(F.max(F.struct((F.col("status") == "failed").alias("f"), "started_at", "run_id", "status")).alias("v")).select("task", "v.run_id", "v.status", "v.started_at")


@query("rd3_merged_snapshots", f"""{with_(RUNS)}, s AS (SELECT task % 10 AS source, task, run_id % 4 AS snapshot, status = 'failed' AND run_id % 2 = 0 AS unresolved, started_at, status, CASE WHEN status = 'success' THEN started_at END AS ok, run_id FROM runs)
    SELECT source, status, started_at, max(ok) OVER (PARTITION BY source) AS last_success FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY unresolved DESC, started_at DESC, run_id DESC) = 1""")
def snapshots(spark, sf):
    runs = t.runs(spark, sf).withColumn("source", F.col("task") % 10)
    unresolved = (F.col("status") == "failed") & (F.col("run_id") % 2 == 0)
    out = runs.groupBy("source").agg(F.max(F.struct(unresolved.alias("u"), "started_at", "run_id", "status")).alias("v"), F.max(F.when(F.col("status") == "success", F.col("started_at"))).alias("last_success"))
    return out.select("source", "v.status", "v.started_at", "last_success")


@query("rd6_recent_failures", f"{with_(RUNS)} SELECT run_id, task, started_at FROM runs WHERE status = 'failed' AND started_at > (SELECT max(started_at) FROM runs) - INTERVAL 3 DAY")
def recent_failures(spark, sf):
    runs = t.runs(spark, sf)
    end = F.broadcast(runs.agg(F.max("started_at").alias("z")))
    return runs.filter("status = 'failed'").join(end).filter(F.col("started_at") > F.col("z") - F.expr("INTERVAL 3 DAYS")).select("run_id", "task", "started_at")


@query("jn6_concept_scores", f"""{with_(BARS, MEMBERS, HEAT)}, d AS (SELECT max(trade_date) AS day FROM bars), b AS (SELECT bars.* FROM bars JOIN d ON trade_date >= day - 30 WHERE pct_chg IS NOT NULL), k AS (SELECT avg(pct_chg) AS mean FROM b)
    SELECT concept, round(avg(pct_chg) * 1.000000000001, 4) AS momentum, round(count(*) FILTER (pct_chg > 0)::DOUBLE / count(*), 4) AS breadth, round((avg(pct_chg) - any_value(mean)) * 1.000000000001, 4) AS relative FROM b JOIN members USING (code), k GROUP BY concept""")
def concept_scores(spark, sf):
    bars = m.with_pre_close(t.bars(spark, sf)).filter("pct_chg is not null")
    day = F.broadcast(t.bars(spark, sf).agg(F.max("trade_date").alias("day")))
    recent = bars.join(day).filter(F.col("trade_date") >= F.date_sub("day", 30)).select("code", "pct_chg")
    mean = F.broadcast(recent.agg(F.avg("pct_chg").alias("mean")))
    out = recent.join(t.members(spark, sf), "code").join(mean).groupBy("concept").agg(F.avg("pct_chg").alias("a"), (F.count_if(F.col("pct_chg") > 0) / F.count(F.lit(1))).alias("b"), F.first("mean").alias("mean"))
    return out.select("concept", F.round(F.col("a") * 1.000000000001, 4).alias("momentum"), F.round("b", 4).alias("breadth"), F.round((F.col("a") - F.col("mean")) * 1.000000000001, 4).alias("relative"))


