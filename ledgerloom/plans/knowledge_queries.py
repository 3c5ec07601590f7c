"""Registered queries over identifiers, loads and merges, text rules, and documents, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.functions import ids, rules
from ledgerloom.functions.rules import Rule
from ledgerloom.operators import documents as d
from ledgerloom.operators import upsert as u
from ledgerloom.plans.bindings import ANNOUNCEMENTS, BARS, HEAT, QUESTIONS, RUNS, STOCKS, with_
from ledgerloom.sources import tables as t

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


AS_OF = dt.date(2000, 6, 30)
STRIP = r"regexp_replace(coalesce({}, ''), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"
WORDS = r"len(regexp_extract_all({}, '[^ \t\n\x0B\f\r]+'))"


# ---- identifiers ---------------------------------------------------------------------------------------------
@query("id_content_keys", f"""{with_(ANNOUNCEMENTS)}, c AS (SELECT doc_id, title, body, source, lang, sha256({STRIP.format('body')}) AS checksum FROM announcements)
    SELECT doc_id, checksum, 'EV:' || sha256(concat_ws(chr(10), 'announcement', doc_id::VARCHAR, '0', checksum)) AS evidence_id,
           'SF:' || substr(sha256(concat_ws('|', source, lang, title)), 1, 24) AS fact_id,
           'SIG:' || substr(sha256(concat_ws('|', 'doc', doc_id::VARCHAR, lower(regexp_replace(source, '\\s+', '', 'g')), lang, lower(regexp_replace(substr(title, 1, 120), '\\s+', '', 'g')))), 1, 20) AS signal_id,
           'EV:' || substr(sha256({STRIP.format('title')}), 1, 16) AS news_id, 'CO:' || substr(md5({STRIP.format('source')}), 1, 12) AS company_id, 'summary:L2:' || source AS summary_key FROM c""")
def content_keys(spark, sf):
    docs = t.announcements(spark, sf)
    checksum = ids.text_checksum(F.col("body"))
    return docs.select(
        "doc_id", checksum.alias("checksum"), ids.evidence_id(F.lit("announcement"), F.col("doc_id"), F.lit(0), checksum).alias("evidence_id"),
        ids.fact_id(F.col("source"), F.col("lang"), F.col("title")).alias("fact_id"), ids.signal_id(F.lit("doc"), F.col("doc_id"), F.col("source"), F.col("lang"), F.col("title")).alias("signal_id"),
        ids.news_id(F.col("title")).alias("news_id"), ids.entity_id("Company", F.col("source")).alias("company_id"), ids.summary_key(2, F.col("source")).alias("summary_key"),
    )


@query("id_uuid5", """WITH h AS (SELECT s_suppkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(s_name)) AS h FROM supplier)
    SELECT s_suppkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(printf('%x', ((('0x' || substr(h, 17, 1))::INTEGER & 3) | 8))) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def uuid5(spark, sf):
    return t.table(spark, sf, "supplier").select("s_suppkey", ids.uuid5(F.col("s_name")).alias("uuid"))


# ---- loads and merges ----------------------------------------------------------------------------------------
@query("src1_normalised_trades", """SELECT l_orderkey, l_linenumber, try_cast(CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE l_quantity::VARCHAR END AS DOUBLE) AS volume,
    try_cast(CASE WHEN l_linenumber = 4 THEN '' ELSE l_extendedprice::VARCHAR END AS DOUBLE) AS amount FROM lineitem""")
def normalised(spark, sf):
    raw = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("v"), F.when(F.col("l_linenumber") == 4, "").otherwise(F.col("l_extendedprice").cast("string")).alias("a"))
    return raw.select("l_orderkey", "l_linenumber", F.col("v").try_cast("double").alias("volume"), F.col("a").try_cast("double").alias("amount"))


@query("src2_provider_fallback", """WITH s AS (SELECT l_suppkey AS code, l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN 2 WHEN l_suppkey % 3 = 1 THEN 1 ELSE 1 + l_linenumber % 2 END AS priority FROM lineitem)
    SELECT code, l_orderkey, l_linenumber, priority, priority > 1 AS fallback_used FROM s QUALIFY priority = min(priority) OVER (PARTITION BY code)""")
def fallback(spark, sf):
    k = F.col("l_suppkey") % 3
    lines = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("code"), "l_orderkey", "l_linenumber", F.when(k == 0, 2).when(k == 1, 1).otherwise(1 + F.col("l_linenumber") % 2).alias("priority"))
    return u.first_non_empty_source(lines, "code", "priority")


@query("src3_missing_dates", f"""{with_(STOCKS)}, n AS (SELECT l_suppkey AS code, max(l_shipdate::DATE) AS newest FROM lineitem WHERE l_suppkey % 4 <> 0 AND l_shipdate < DATE '2000-07-01' + (l_suppkey % 3)::INTEGER * 400 GROUP BY 1)
    SELECT code, start, DATE '2000-06-30' AS stop FROM (SELECT s.code, coalesce(newest + 1, DATE '2000-06-30' - 365)::DATE AS start FROM stocks s LEFT JOIN n ON s.code = n.code) WHERE start <= DATE '2000-06-30'""")
def missing(spark, sf):
    have = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("trade_date"))
    have = have.filter((F.col("code") % 4 != 0) & (F.col("trade_date") < F.date_add(F.lit("2000-07-01").cast("date"), (F.col("code") % 3 * 400).cast("int"))))
    return u.missing_from(t.stocks(spark, sf), have, "code", "trade_date", F.lit(AS_OF), 365)


@query("src5_concept_roll_up", """WITH x AS (SELECT p_partkey, trim(unnest(string_split(p_brand || '|' || p_type || '| ' || p_brand, '|'))) AS concept, p_retailprice AS pct FROM part)
    SELECT concept, count(DISTINCT p_partkey) AS stocks, max(pct) AS max_pct FROM x WHERE concept <> '' GROUP BY concept""")
def roll_up(spark, sf):
    raw = t.table(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.lit("|"), "p_type", F.lit("| "), "p_brand").alias("concepts"), F.col("p_retailprice").alias("pct"))
    each = raw.select("p_partkey", "pct", F.explode(F.array_distinct(F.transform(F.split("concepts", r"\|"), lambda x: F.trim(x)))).alias("concept")).filter("concept <> ''")
    return each.groupBy("concept").agg(F.count(F.lit(1)).alias("stocks"), F.max("pct").alias("max_pct"))


@query("src7_question_drops", f"""{with_(QUESTIONS)} SELECT CASE WHEN question IS NULL OR trim(question) = '' THEN 'no_question' WHEN answer IS NULL OR trim(answer) = '' THEN 'no_answer'
    WHEN length(question) < 15 THEN 'short' WHEN contains(answer, 'the') THEN 'kept' ELSE 'no_substance' END AS drop_reason, count(*) AS n FROM questions GROUP BY 1""")
def question_drops(spark, sf):
    q, a = F.col("question"), F.col("answer")
    reason = F.when(q.isNull() | (F.trim(q) == ""), "no_question").when(a.isNull() | (F.trim(a) == ""), "no_answer").when(F.length(q) < 15, "short").when(F.contains(a, F.lit("the")), "kept").otherwise("no_substance")
    return t.questions(spark, sf).groupBy(reason.alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


@query("src9_page_titles", r"""SELECT page_id, lpad((page_id % 1000000)::VARCHAR, 6, '0') AS code, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '<[^>]*>', '', 'g') AS title,
    CASE WHEN (page_id % 10) >= 6 THEN 'SH' WHEN (page_id % 10) >= 4 THEN 'BJ' ELSE 'SZ' END AS exchange, 'https://files' || coalesce(regexp_extract(url, '://[^/]*(/[^?#]*)', 1), '') AS file_url FROM pages""")
def page_titles(spark, sf):
    last = F.col("page_id") % 10
    return t.table(spark, sf, "pages").select(
        "page_id", F.lpad((F.col("page_id") % 1000000).cast("string"), 6, "0").alias("code"), F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "<[^>]*>", "").alias("title"),
        F.when(last >= 6, "SH").when(last >= 4, "BJ").otherwise("SZ").alias("exchange"), F.concat(F.lit("https://files"), F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1)).alias("file_url"),
    )


@query("src10_news_once", f"""WITH e AS (SELECT event_id, event_type || ':' || (user_id % 50) AS title, ts, props FROM events)
    SELECT 'EV:' || substr(sha256(title), 1, 16) AS news_id, title, event_id, ts FROM e QUALIFY row_number() OVER (PARTITION BY title ORDER BY ts, event_id) = 1""")
def news_once(spark, sf):
    e = t.table(spark, sf, "events").select("event_id", F.concat("event_type", F.lit(":"), F.col("user_id") % 50).alias("title"), "ts")
    return u.keep_first(e.withColumn("news_id", ids.news_id(F.col("title"))), ["news_id"], ["ts", "event_id"]).select("news_id", "title", "event_id", "ts")


@query("src11_file_inventory", """WITH now AS (SELECT doc_id AS file, md5(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 10 <> 1),
    was AS (SELECT doc_id AS file, CASE WHEN doc_id % 10 = 2 THEN 'x' ELSE md5(coalesce(text, '')) END AS hash FROM documents WHERE doc_id % 10 <> 0)
    SELECT coalesce(now.file, was.file) AS file, CASE WHEN was.file IS NULL THEN 'new' WHEN now.file IS NULL THEN 'vanished' WHEN now.hash <> was.hash THEN 'changed' ELSE 'same' END AS state FROM now FULL JOIN was ON now.file = was.file""")
def inventory(spark, sf):
    docs = t.table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    now = docs.filter("file % 10 <> 1").withColumnRenamed("hash", "now")
    was = docs.filter("file % 10 <> 0").select("file", F.when(F.col("file") % 10 == 2, "x").otherwise(F.col("hash")).alias("was"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "vanished").when(F.col("now") != F.col("was"), "changed").otherwise("same")
    return now.join(was, "file", "full").select("file", state.alias("state"))


_OLD = "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, 1 AS version FROM customer WHERE c_custkey % 3 <> 0"
_NEW = "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal + 1 END AS balance, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE lower(c_mktsegment) END AS segment, 2 AS version FROM customer WHERE c_custkey % 2 = 0"


def _sides(spark, sf):
    c = t.table(spark, sf, "customer")
    key = F.col("c_custkey")
    old = c.filter(key % 3 != 0).select(key.alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.lit(1).alias("version"))
    new = c.filter(key % 2 == 0).select(key.alias("id"), F.when(key % 5 != 0, F.col("c_acctbal") + 1).alias("balance"), F.when(key % 7 != 0, F.lower("c_mktsegment")).alias("segment"), F.lit(2).alias("version"))
    return old, new


def _merged(balance: str, segment: str, version: str) -> str:
    def pick(expr: str, c: str) -> str:
        return f"CASE WHEN o.id IS NULL THEN n.{c} WHEN n.id IS NULL THEN o.{c} ELSE {expr} END AS {c}"

    return f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.id, n.id) AS id, {pick(balance, 'balance')}, {pick(segment, 'segment')}, {pick(version, 'version')} FROM o FULL JOIN n ON o.id = n.id"


@query("snk1_upsert_all", _merged("n.balance", "n.segment", "n.version"))
def upsert_all(spark, sf):
    return u.upsert(*_sides(spark, sf), ["id"])


@query("snk2_upsert_non_null", _merged("coalesce(n.balance, o.balance)", "coalesce(n.segment, o.segment)", "n.version"))
def upsert_non_null(spark, sf):
    return u.upsert(*_sides(spark, sf), ["id"], default="coalesce_new")


@query("snk3_insert_absent", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)")
def insert_absent(spark, sf):
    return u.insert_absent(*_sides(spark, sf), ["id"])


@query("snk4_upsert_by_policy", _merged("greatest(o.balance, n.balance)", "coalesce(o.segment, n.segment)", "o.version"))
def upsert_policies(spark, sf):
    return u.upsert(*_sides(spark, sf), ["id"], {"balance": "greatest", "segment": "coalesce_old", "version": "keep_old"})


@query("snk7_whitelist", """SELECT p_brand AS concept, list_sort(list(DISTINCT l_suppkey)) AS codes FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 9 <> 0 GROUP BY 1""")
def whitelist(spark, sf):
    return t.members(spark, sf).filter("code % 9 <> 0").groupBy("concept").agg(F.array_sort(F.collect_set("code")).alias("codes"))


@query("st1_keep_first", "SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def keep_first(spark, sf):
    return u.keep_first(t.table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])


_CHUNKS = "SELECT doc_id AS doc, unnest(range(len(s))) AS idx, md5(trim(unnest(s))) AS hash FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)"


@query("st2_chunk_diff", f"""WITH n AS ({_CHUNKS}), o AS (SELECT doc, idx, CASE WHEN (doc + idx) % 7 = 0 THEN 'x' ELSE hash END AS hash FROM n WHERE NOT (doc % 5 = 0 AND idx > 2))
    SELECT coalesce(n.doc, o.doc) AS doc, coalesce(n.idx, o.idx)::INTEGER AS idx, CASE WHEN o.doc IS NULL THEN 'added' ELSE 'changed' END AS change FROM n FULL JOIN o ON n.doc = o.doc AND n.idx = o.idx WHERE o.doc IS NULL OR n.hash <> o.hash""")
def chunk_diff(spark, sf):
    lines = t.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "line"))
    new = lines.select("doc", "idx", F.md5(F.trim("line")).alias("hash"))
    old = new.filter("not (doc % 5 = 0 and idx > 2)").withColumn("hash", F.when((F.col("doc") + F.col("idx")) % 7 == 0, "x").otherwise(F.col("hash")))
    return u.chunk_diff(old, new)


@query("st3_extract_again", """WITH d AS (SELECT doc_id AS doc, md5(coalesce(text, '')) AS hash FROM documents), l AS (SELECT doc, CASE doc % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'done' END AS status, CASE WHEN doc % 8 = 2 THEN 'x' ELSE hash END AS hash FROM d WHERE doc % 3 <> 0)
    SELECT d.doc, CASE WHEN l.status IS NULL THEN 'new' WHEN l.status = 'running' THEN 'skip' WHEN l.status = 'failed' THEN 'retry' WHEN l.hash = d.hash THEN 'skip' ELSE 'changed' END AS action FROM d LEFT JOIN l ON d.doc = l.doc""")
def extract_again(spark, sf):
    docs = t.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    k = F.col("doc") % 4
    ledger = docs.filter("doc % 3 <> 0").select("doc", F.when(k == 0, "running").when(k == 1, "failed").otherwise("done").alias("status"), F.when(F.col("doc") % 8 == 2, "x").otherwise(F.col("hash")).alias("hash"))
    return u.extract_again(docs, ledger)


@query("st4_recent_successes", f"""{with_(RUNS)}, z AS (SELECT max(started_at) AS z FROM runs) SELECT DISTINCT task FROM runs WHERE task NOT IN (SELECT task FROM runs, z WHERE status = 'success' AND started_at > z - INTERVAL 12 HOUR)""")
def pending(spark, sf):
    runs = t.runs(spark, sf)
    end = F.broadcast(runs.agg(F.max("started_at").alias("z")))
    recent = runs.filter("status = 'success'").join(end).filter(F.col("started_at") > F.col("z") - F.expr("INTERVAL 12 HOURS")).select("task")
    return runs.select("task").distinct().join(recent, "task", "left_anti")


@query("st5_counts", """SELECT 'nation' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def counts(spark, sf):
    parts = [t.table(spark, sf, k).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k in ("nation", "supplier", "part", "lineitem")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("st7_retention", """SELECT event_id, event_type, ts FROM events WHERE CASE event_type WHEN 'view' THEN date_diff('day', ts::DATE, (SELECT max(ts)::DATE FROM events)) <= 5 WHEN 'error' THEN date_diff('day', ts::DATE, (SELECT max(ts)::DATE FROM events)) <= 20 ELSE true END""")
def retention(spark, sf):
    events = t.table(spark, sf, "events").select("event_id", "event_type", "ts")
    dated = events.join(F.broadcast(events.agg(F.to_date(F.max("ts")).alias("as_of"))))
    return u.retention(dated, "ts", F.col("as_of"), {"view": 5, "error": 20}, "event_type").drop("as_of")


@query("st9_paths", """SELECT p.page_id, CASE WHEN d.doc_id IS NULL THEN NULL ELSE url END AS path, d.doc_id IS NULL AS cleared FROM pages p LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) d ON p.page_id = d.doc_id""")
def paths(spark, sf):
    files = t.table(spark, sf, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("page_id"), F.lit(True).alias("there"))
    return t.table(spark, sf, "pages").select("page_id", "url").join(files, "page_id", "left").select("page_id", F.when(F.col("there"), F.col("url")).alias("path"), F.col("there").isNull().alias("cleared"))


@query("st10_pool_rebuild", f"""{with_(STOCKS)}, p AS (SELECT code, 1 AS priority, 'watchlist' AS source FROM stocks WHERE balance > 5000 UNION ALL SELECT code, 2, 'score' FROM stocks WHERE code % 2 = 0)
    SELECT code, source FROM p QUALIFY row_number() OVER (PARTITION BY code ORDER BY priority) = 1""")
def pool_rebuild(spark, sf):
    s = t.stocks(spark, sf)
    both = s.filter("balance > 5000").select("code", F.lit(1).alias("priority"), F.lit("watchlist").alias("source")).unionByName(s.filter("code % 2 = 0").select("code", F.lit(2).alias("priority"), F.lit("score").alias("source")))
    return both.groupBy("code").agg(F.min_by("source", "priority").alias("source"))


# ---- text rules ----------------------------------------------------------------------------------------------
TITLE_RULES = [Rule("lich", "annual", "save"), Rule("tion", "notice", "save"), Rule("ment", "report", "skip"), Rule("er", "other", "skip")]
TOPICS = {"supply": ["the", "and", "in"], "demand": ["der", "die", "und"], "policy": ["le", "la", "des"], "market": ["el", "los", "que"]}
UP, DOWN = ["ing", "ly"], ["idiot", "scum", "trash", "ed"]


def _hits(col: str, kws: list[str]) -> str:
    return " + ".join(f"contains({col}, '{k}')::INTEGER" for k in kws)


@query("tx1_title_class", f"""{with_(ANNOUNCEMENTS)} SELECT doc_id, CASE {' '.join(f"WHEN contains(title, '{r.keyword}') THEN '{r.label}'" for r in TITLE_RULES)} ELSE 'unknown' END AS doc_type,
    CASE {' '.join(f"WHEN contains(title, '{r.keyword}') THEN '{r.action}'" for r in TITLE_RULES)} ELSE 'skip' END AS action FROM announcements""")
def title_class(spark, sf):
    hit = rules.first_match(F.col("title"), TITLE_RULES, Rule("", "unknown", "skip"))
    return t.announcements(spark, sf).select("doc_id", hit["label"].alias("doc_type"), hit["action"].alias("action"))


@query("tx4_answer_grade", f"""{with_(QUESTIONS)}, g AS (SELECT conv_id, turn, regexp_replace(regexp_replace(trim(coalesce(answer, '')), '^The ', ''), '\\.$', '') AS a FROM questions),
    h AS (SELECT conv_id, turn, CASE WHEN a = '' THEN 'empty' WHEN length(a) >= 300 THEN 'complex' WHEN contains(a, 'tion') AND length(a) < 60 THEN 'defer' WHEN regexp_matches(a, '[0-9]') THEN 'data' ELSE 'simple' END AS grade FROM g)
    SELECT *, CASE grade WHEN 'complex' THEN 2 WHEN 'data' THEN 1 WHEN 'simple' THEN 1 ELSE 0 END AS tier FROM h""")
def answer_grade(spark, sf):
    a = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("answer", F.lit(""))), "^The ", ""), r"\.$", "")
    grade = F.when(a == "", "empty").when(F.length(a) >= 300, "complex").when(F.contains(a, F.lit("tion")) & (F.length(a) < 60), "defer").when(a.rlike("[0-9]"), "data").otherwise("simple")
    return t.questions(spark, sf).select("conv_id", "turn", grade.alias("grade")).withColumn("tier", F.when(F.col("grade") == "complex", 2).when(F.col("grade").isin("data", "simple"), 1).otherwise(0))


@query("tx5_polarity", f"""{with_(ANNOUNCEMENTS)} SELECT doc_id, CASE WHEN {_hits('title', UP)} > 0 AND {_hits('title', DOWN)} > 0 THEN 'conflict' WHEN {_hits('title', UP)} > 0 THEN 'positive' WHEN {_hits('title', DOWN)} > 0 THEN 'negative' ELSE 'neutral' END AS polarity FROM announcements""")
def polarity(spark, sf):
    return t.announcements(spark, sf).select("doc_id", rules.polarity(F.col("title"), UP, DOWN).alias("polarity"))


@query("tx6_best_topic", f"""{with_(ANNOUNCEMENTS)}, s AS (SELECT doc_id, {', '.join(f'({_hits("lower(title)", v)}) AS {k}' for k, v in TOPICS.items())} FROM announcements),
    g AS (SELECT *, greatest({', '.join(TOPICS)}) AS top FROM s) SELECT doc_id, CASE WHEN top = 0 THEN 'none' {' '.join(f"WHEN {k} = top THEN '{k}'" for k in TOPICS)} END AS topic FROM g""")
def best_topic(spark, sf):
    return t.announcements(spark, sf).select("doc_id", rules.best_label(F.lower("title"), TOPICS, "none").alias("topic"))


@query("tx11_rule_signals", f"""{with_(ANNOUNCEMENTS)}, r AS (SELECT * FROM (VALUES ('risk', 'idiot', 60), ('risk', 'scum', 60), ('growth', 'tion', 50), ('order', 'ing', 55)) v(kind, keyword, base)),
    s AS (SELECT doc_id, trim(unnest(regexp_split_to_array(body, '[.!?。！？；\n]+'))) AS sentence, unnest(range(len(regexp_split_to_array(body, '[.!?。！？；\n]+')))) AS pos FROM announcements),
    h AS (SELECT s.doc_id, r.kind, r.keyword, r.base, s.sentence, s.pos FROM s JOIN r ON contains(s.sentence, r.keyword) WHERE length(s.sentence) > 0)
    SELECT doc_id, kind, keyword, pos::INTEGER AS pos, base + 4 * ({_hits('sentence', UP)}) AS strength, least(100, ((base + 4 * ({_hits('sentence', UP)})) * 0.65 + 0.7 * 25)::DOUBLE) AS raw_value
    FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos, keyword) = 1""")
def rule_signals(spark, sf):
    table = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(w).alias("keyword"), F.lit(b).alias("base")) for k, w, b in (("risk", "idiot", 60), ("risk", "scum", 60), ("growth", "tion", 50), ("order", "ing", 55))])
    parts = t.announcements(spark, sf).select("doc_id", F.posexplode(F.transform(F.split("body", r"[.!?。！？；\n]+"), lambda x: F.trim(x))).alias("pos", "sentence")).filter("sentence <> ''")
    hit = parts.select("doc_id", "pos", "sentence", F.explode(F.filter(table, lambda r: F.contains(F.col("sentence"), r["keyword"]))).alias("r"))
    first = hit.groupBy("doc_id", F.col("r.kind").alias("kind")).agg(F.min(F.struct("pos", F.col("r.keyword").alias("keyword"), F.col("r.base").alias("base"), "sentence")).alias("x"))
    strength = F.col("x.base") + 4 * rules.hits(F.col("x.sentence"), UP)
    return first.select("doc_id", "kind", "x.keyword", "x.pos", strength.alias("strength"), F.least(F.lit(100.0), strength * 0.65 + 0.7 * 25).alias("raw_value"))


@query("tx12_sentiment", f"""{with_(ANNOUNCEMENTS)}, c AS (SELECT doc_id, {_hits('title', UP)} AS p, {_hits('title', DOWN)} AS n FROM announcements) SELECT doc_id, CASE WHEN p + n = 0 THEN 0.0 ELSE round((p - n)::DOUBLE / (p + n), 3) END AS sentiment FROM c""")
def sentiment(spark, sf):
    p, n = rules.hits(F.col("title"), UP), rules.hits(F.col("title"), DOWN)
    return t.announcements(spark, sf).select("doc_id", F.when(p + n == 0, 0.0).otherwise(F.round((p - n) / (p + n), 3)).alias("sentiment"))


@query("tx18_compliance", r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) AS emails, len(regexp_extract_all(coalesce(text, ''), '\b(?:idiot|scum|trash)\b')) AS warnings,
    sha256(regexp_replace(coalesce(text, ''), '[A-Za-z0-9._]+@[A-Za-z0-9.]+', '[redacted]', 'g')) AS redacted_sha256, NOT regexp_matches(coalesce(text, ''), '[A-Za-z0-9._]+@[A-Za-z0-9.]+') AS passed FROM documents""")
def compliance(spark, sf):
    text, mail = F.coalesce("text", F.lit("")), r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"
    return t.table(spark, sf, "documents").select("doc_id", F.regexp_count(text, F.lit(mail)).cast("long").alias("emails"), F.regexp_count(text, F.lit(r"\b(?:idiot|scum|trash)\b")).cast("long").alias("warnings"), F.sha2(F.regexp_replace(text, mail, "[redacted]"), 256).alias("redacted_sha256"), (~text.rlike(mail)).alias("passed"))


@query("sc1_codes", """WITH c AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'sh.' || lpad((600000 + s_suppkey)::VARCHAR, 6, '0') WHEN 1 THEN lpad((s_suppkey + 300000)::VARCHAR, 6, '0') WHEN 2 THEN (600000 + s_suppkey) || '.SH' WHEN 3 THEN 'X' || s_suppkey ELSE (830000 + s_suppkey)::VARCHAR END AS raw FROM supplier)
    SELECT s_suppkey, raw, CASE s_suppkey % 5 WHEN 0 THEN (600000 + s_suppkey) || '.SH' WHEN 1 THEN (300000 + s_suppkey) || '.SZ' WHEN 2 THEN (600000 + s_suppkey) || '.SH' WHEN 4 THEN (830000 + s_suppkey) || '.BJ' END AS code FROM c""")
def codes(spark, sf):
    k = F.col("s_suppkey")
    raw = F.when(k % 5 == 0, F.concat(F.lit("sh."), F.lpad((k + 600000).cast("string"), 6, "0"))).when(k % 5 == 1, F.lpad((k + 300000).cast("string"), 6, "0")).when(k % 5 == 2, F.concat((k + 600000).cast("string"), F.lit(".SH"))).when(k % 5 == 3, F.concat(F.lit("X"), k)).otherwise((k + 830000).cast("string"))
    return t.table(spark, sf, "supplier").select("s_suppkey", raw.alias("raw"), rules.normalised_code(raw).alias("code"))


@query("sc5_weights", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity % 11 = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, CASE WHEN l_quantity / 10 > 1 THEN l_quantity / 10 / 10 ELSE l_quantity / 10 END)) END AS weight FROM lineitem")
def weights(spark, sf):
    raw = F.when(F.col("l_quantity") % 11 == 0, float("nan")).otherwise(F.col("l_quantity") / 10)
    return t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rules.unit_weight(raw).alias("weight"))


@query("sc6_unit_numbers", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_custkey * 10000.0 WHEN 1 THEN o_custkey * 100000000.0 ELSE o_custkey * 1.0 END::DOUBLE AS amount FROM orders")
def unit_numbers(spark, sf):
    k = F.col("o_orderkey") % 3
    text = F.concat(F.lit("about "), F.col("o_custkey"), F.when(k == 0, " 万").when(k == 1, "亿").otherwise(""))
    return t.table(spark, sf, "orders").select("o_orderkey", rules.unit_number(text).alias("amount"))


@query("sc7_token_estimate", f"""{with_(ANNOUNCEMENTS)} SELECT doc_id, floor(length(body) * 0.25)::INTEGER AS tokens FROM announcements""")
def token_estimate(spark, sf):
    return t.announcements(spark, sf).select("doc_id", rules.estimated_tokens(F.col("body")).alias("tokens"))


# ---- documents -----------------------------------------------------------------------------------------------
@query("dc2_prose_lines", r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
    b AS (SELECT *, len(regexp_extract_all(s, '\|')) AS bars FROM l)
    SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (trim(s) <> '' AND NOT (bars >= 3 AND bars > len(string_split(s, ' ')) * 0.25) AND NOT regexp_matches(s, '^\s*(https?://|www\.)\S+\s*$') AND NOT regexp_matches(s, '^\s*\S+@\S+\.\S+\s*$')), '') AS prose FROM b GROUP BY doc_id""")
def prose_lines(spark, sf):
    return t.announcements(spark, sf).select("doc_id", d.keep_prose(F.col("body")).alias("prose"))


_PACKED = rf"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
    w AS (SELECT doc_id, s, {WORDS.format('s')} AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE {WORDS.format('s')} > 0),
    p AS (SELECT doc_id, k, n, n AS total, 0 AS idx, s FROM w WHERE k = 1 UNION ALL
          SELECT w.doc_id, w.k, w.n, CASE WHEN p.total + w.n <= 120 THEN p.total + w.n ELSE w.n END, CASE WHEN p.total + w.n <= 120 THEN p.idx ELSE p.idx + 1 END, w.s FROM p JOIN w ON p.doc_id = w.doc_id AND w.k = p.k + 1),
    c AS (SELECT doc_id, idx, string_agg(s, chr(10) ORDER BY k) AS chunk, sum(n)::INTEGER AS words FROM p GROUP BY doc_id, idx)"""


@query("dc6_chunks", f"{_PACKED} SELECT doc_id, idx, chunk, words FROM c")
def packed_chunks(spark, sf):
    return d.chunks(t.announcements(spark, sf), 120)


@query("dc9_chapter_action", f"""{_PACKED}, h AS (SELECT doc_id, idx, words, string_split(chunk, chr(10))[1] AS heading FROM c)
    SELECT doc_id, idx AS chapter, CASE WHEN contains(heading, 'tion') THEN 'notice' WHEN contains(heading, 'lich') THEN 'annex' ELSE 'other' END AS kind,
           CASE WHEN contains(heading, 'tion') THEN 'keep' WHEN contains(heading, 'lich') THEN CASE WHEN words >= 60 THEN 'rescued' ELSE 'skip' END ELSE 'keep' END AS action, words FROM h""")
def chapter_action(spark, sf):
    parts = d.chunks(t.announcements(spark, sf), 120).select("doc_id", F.col("idx").alias("chapter"), F.element_at(F.split("chunk", "\n"), 1).alias("heading"), F.col("chunk").alias("body"))
    return d.classify_chapters(parts, [Rule("tion", "notice", "keep"), Rule("lich", "annex", "skip")], 60)


@query("dc10_evidence", f"""{_PACKED}, k AS (SELECT doc_id, idx, chunk, sha256({STRIP.format('chunk')}) AS checksum FROM c)
    SELECT 'EV:' || sha256(concat_ws(chr(10), 'announcement', doc_id::VARCHAR, idx::VARCHAR, checksum)) AS evidence_id, 'announcement' AS source_type, doc_id, idx, checksum, substr(chunk, 1, 200) AS excerpt, 0.85::DOUBLE AS confidence FROM k""")
def evidence(spark, sf):
    return d.evidence(d.chunks(t.announcements(spark, sf), 120), "announcement", 0.85)


@query("dc11_jobs", f"""{_PACKED}, e AS (SELECT 'EV:' || sha256(concat_ws(chr(10), 'announcement', doc_id::VARCHAR, idx::VARCHAR, sha256({STRIP.format('chunk')}))) AS evidence_id FROM c)
    SELECT 'JOB:' || sha256(concat_ws(chr(10), evidence_id, job_type, 'v1')) AS job_id, evidence_id, job_type, 'pending' AS status FROM e, (VALUES ('combined'), ('vector'), ('signal')) v(job_type)""")
def jobs(spark, sf):
    return d.jobs(evidence(spark, sf), ["combined", "vector", "signal"])


@query("ag7_questions_by_day", f"""{with_(QUESTIONS)} SELECT conv_id, 0 AS day, string_agg('Q: ' || coalesce(question, '') || chr(10) || 'A: ' || coalesce(answer, ''), chr(10) || chr(10) ORDER BY turn) AS merged, count(*) AS pairs FROM questions GROUP BY conv_id""")
def by_day(spark, sf):
    return d.merge_by_day(t.questions(spark, sf).withColumn("day", F.lit(0)), "conv_id", "day")


@query("flt1_range_scan", f"""{with_(ANNOUNCEMENTS)} SELECT doc_id, title, source FROM announcements WHERE source = 'src3' AND doc_id >= 10 AND contains(title, 'e') ORDER BY doc_id DESC LIMIT 25""")
def range_scan(spark, sf):
    return t.announcements(spark, sf).filter((F.col("source") == "src3") & (F.col("doc_id") >= 10) & F.contains(F.col("title"), F.lit("e"))).orderBy(F.desc("doc_id")).limit(25).select("doc_id", "title", "source")


@query("flt3_name_search", f"{with_(STOCKS)} SELECT code, name, industry FROM stocks WHERE name ILIKE '%0007%' OR code::VARCHAR ILIKE '%7%' OR industry ILIKE 'nation_1%'")
def name_search(spark, sf):
    return t.stocks(spark, sf).filter(F.col("name").ilike("%0007%") | F.col("code").cast("string").ilike("%7%") | F.col("industry").ilike("nation\\_1%")).select("code", "name", "industry")


@query("flt4_news_search", """SELECT doc_id, lang FROM documents WHERE len(list_filter(string_split('the and', ' '), lambda k: NOT contains(lower(coalesce(text, '')), k))) = 0 AND list_has_any([lang, source], ['en', 'src4'])""")
def news_search(spark, sf):
    words = F.split(F.lit("the and"), " ")
    return t.table(spark, sf, "documents").filter(F.forall(words, lambda k: F.contains(F.lower(F.coalesce("text", F.lit(""))), k)) & F.arrays_overlap(F.array("lang", "source"), F.array(F.lit("en"), F.lit("src4")))).select("doc_id", "lang")


@query("jn9_concept_tags", f"""{with_(ANNOUNCEMENTS)} SELECT doc_id, list_filter(['the', 'tion', 'lich', 'ment', 'que'], lambda k: contains(title, k)) AS tags FROM announcements""")
def concept_tags(spark, sf):
    return t.announcements(spark, sf).select("doc_id", rules.matches(F.col("title"), ["the", "tion", "lich", "ment", "que"]).alias("tags"))


@query("jn10_event_window", f"""{with_(HEAT)} SELECT concept, trade_date, ups, date_diff('day', DATE '2000-06-30', trade_date) AS lead_days FROM heat WHERE trade_date BETWEEN DATE '2000-06-30' AND DATE '2000-06-30' + 5""")
def event_window(spark, sf):
    lead = F.datediff("trade_date", F.lit(AS_OF))
    return t.concept_heat(spark, sf).filter(lead.between(0, 5)).select("concept", "trade_date", "ups", lead.alias("lead_days"))


@query("jn11_record_match", f"""{with_(BARS)}, a AS (SELECT code, strftime(trade_date, '%Y-%m') AS month, max(trade_date) AS file_date FROM bars WHERE code % 2 = 0 GROUP BY 1, 2), b AS (SELECT code, strftime(trade_date, '%Y-%m') AS month, min(trade_date) AS record_date FROM bars WHERE volume > 30 GROUP BY 1, 2)
    SELECT a.code, a.month, file_date, record_date FROM a JOIN b ON a.code = b.code AND a.month = b.month""")
def record_match(spark, sf):
    bars = t.bars(spark, sf).select("code", "trade_date", "volume", F.date_format("trade_date", "yyyy-MM").alias("month"))
    files = bars.filter("code % 2 = 0").groupBy("code", "month").agg(F.max("trade_date").alias("file_date"))
    records = bars.filter("volume > 30").groupBy("code", "month").agg(F.min("trade_date").alias("record_date"))
    return files.join(records, ["code", "month"])
