"""Stage moves over notes: each line of a document stands for a sentence with two stage words around a turn of phrase."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import stages as st
from ledgerloom.operators import stages as op
from ledgerloom.plans.bindings import ANNOUNCEMENTS, with_
from ledgerloom.sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


WORDS = tuple(dict.fromkeys(w for words in st.STAGE_WORDS.values() for w in words))
TURNS = ("，", "已进入成长期，", "从", "升级到", "目前处于", "，此前", "向", "迈进", "，去年")


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


NOTES = f"""notes AS (
    SELECT doc_id, i, ([{_quoted(WORDS)}])[(length(line) * 7 + i * 3) % {len(WORDS)} + 1] || ([{_quoted(TURNS)}])[(length(line) + i) % {len(TURNS)} + 1] || ([{_quoted(WORDS)}])[(length(line) * 5 + i) % {len(WORDS)} + 1] AS sentence
    FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS i FROM announcements)
), words AS (SELECT * FROM (VALUES {", ".join(f"('{w}', '{s}', {st.LEVEL[s]})" for w, s in st.word_stages().items())}) v(w, stage, level)
), places AS (SELECT doc_id, i, sentence, unnest(range(1, length(sentence) + 1)) AS p FROM notes
), hits AS (SELECT doc_id, i, sentence, p, arg_max(stage, level) AS stage, max(level) AS level FROM places JOIN words ON substr(sentence, p, length(w)) = w GROUP BY ALL
), shown AS (SELECT doc_id, i, sentence, list(stage ORDER BY p) AS shown, arg_max(stage, level) AS highest, regexp_matches(sentence, '{st.PAST}') AS past FROM hits GROUP BY ALL)"""

_RULES = f"""allowed AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, to in st.MOVES.items() for b in (a, *to))}) v(a, b)
), levels AS (SELECT * FROM (VALUES {", ".join(f"('{s}', {n})" for s, n in st.LEVEL.items())}) v(stage, level)
), ways AS (SELECT x.stage AS a, y.stage AS b, CASE WHEN x.stage = y.stage THEN 'neutral' WHEN x.stage = 'DECLINE' THEN CASE WHEN y.level > 0 THEN 'positive' ELSE 'neutral' END WHEN y.level > x.level THEN 'positive' ELSE 'negative' END AS direction FROM levels x, levels y)"""

MOVED = f"""{NOTES}, {_RULES},
    told AS (
        SELECT doc_id, coalesce(list_filter(shown, lambda s: s <> shown[1])[1], 'RND') AS a, shown[1] AS b, 'explicit_pattern' AS source_type, 2 * i AS ord, sentence AS evidence FROM shown WHERE regexp_matches(sentence, '{st.STATED}')
        UNION ALL SELECT doc_id, shown[1], shown[-1], 'adjacent_states', 2 * i + 1, sentence FROM shown WHERE len(shown) >= 2 AND regexp_matches(sentence, '{st.VERBS}') AND NOT regexp_matches(sentence, '{st.PRESENT}')
    ), ends AS (SELECT doc_id, arg_max(highest, i) FILTER (past) AS a, arg_max(highest, i) FILTER (NOT past) AS b FROM shown GROUP BY doc_id
    ), numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM shown
    ), steps AS (SELECT *, lag(highest) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM numbered WHERE NOT past OR n = 1
    ), every AS (
        SELECT * FROM told WHERE a <> b
        UNION ALL SELECT doc_id, a, b, 'current_vs_historical', 1::BIGINT << 40, 'now ' || b || ', before ' || a FROM ends WHERE a IS NOT NULL AND b IS NOT NULL
        UNION ALL SELECT doc_id, before, highest, 'cross_sentence_progression', (1::BIGINT << 41) + i, sentence FROM steps JOIN ways ON a = before AND b = highest WHERE n > 1 AND before <> highest AND direction <> 'negative'
    ), moves AS (
        SELECT e.doc_id, e.a AS from_stage, e.b AS to_stage, any_value(w.direction) AS direction, arg_min(source_type, ord) AS source_type, arg_min(evidence, ord) AS evidence, min(ord) AS ord
        FROM every e JOIN allowed USING (a, b) JOIN ways w USING (a, b) GROUP BY e.doc_id, e.a, e.b
    )"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, turns = F.array(*[F.lit(w) for w in WORDS]), F.array(*[F.lit(x) for x in TURNS])

    def note(line, i):
        n = F.length(line)
        return F.concat(F.get(words, (n * 7 + i * 3) % len(WORDS)), F.get(turns, (n + i) % len(TURNS)), F.get(words, (n * 5 + i) % len(WORDS)))

    return t.announcements(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split("body", "\n"), note), "。").alias("text"))


@query("tx9_stage_moves", f"{with_(ANNOUNCEMENTS, MOVED)} SELECT doc_id, from_stage, to_stage, direction, source_type, CASE source_type {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in op.CONFIDENCE.items())} END::DOUBLE AS confidence, evidence FROM moves")
def stage_moves(spark, sf):
    return op.stage_moves(notes(spark, sf)).drop("at")


@query("tx8_stage_directions", f"{with_(ANNOUNCEMENTS, MOVED)} SELECT w.a AS from_stage, w.b AS to_stage, w.direction, w.a = w.b OR EXISTS (SELECT 1 FROM allowed l WHERE l.a = w.a AND l.b = w.b) AS possible, count(m.doc_id) AS documents FROM ways w LEFT JOIN moves m ON m.from_stage = w.a AND m.to_stage = w.b GROUP BY ALL")
def stage_directions(spark, sf):
    names = spark.createDataFrame([(a, b) for a in st.LEVEL for b in st.LEVEL], "from_stage string, to_stage string")
    told = op.stage_moves(notes(spark, sf)).groupBy("from_stage", "to_stage").agg(F.count(F.lit(1)).alias("documents"))
    a, b = F.col("from_stage"), F.col("to_stage")
    every = names.select("from_stage", "to_stage", st.direction(a, b).alias("direction"), st.possible(a, b).alias("possible"))
    return every.join(told, ["from_stage", "to_stage"], "left").select("from_stage", "to_stage", "direction", "possible", F.coalesce("documents", F.lit(0)).alias("documents"))


@query("tx10_move_signal", f"""{with_(ANNOUNCEMENTS, MOVED)}, kinds AS (SELECT *, CASE WHEN direction = 'positive' AND from_stage IN ('PILOT', 'EARLY_ADOPTION') AND to_stage = 'GROWTH' THEN 0 WHEN direction = 'positive' THEN 1 WHEN direction = 'negative' THEN 2 END AS kind FROM moves),
    best AS (SELECT * FROM kinds WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kind, ord) = 1)
    SELECT doc_id, (['PRODUCTION_INFLECTION', 'STATE_ADVANCE', 'STATE_DECLINE'])[kind + 1] AS signal, ([5, 3, 4])[kind + 1]::INTEGER AS urgency, (['A+', 'B', 'B+'])[kind + 1] AS level, from_stage, to_stage FROM best""")
def move_signal(spark, sf):
    return op.move_signal(op.stage_moves(notes(spark, sf)))


_TEXTS = f"texts AS (SELECT doc_id, string_agg(sentence, '。' ORDER BY i) AS text FROM notes GROUP BY doc_id)"


def _stage_sql(text: str) -> str:
    rows = ", ".join(f"{{n: {' + '.join(f'contains({text}, {chr(39)}{w}{chr(39)})::INTEGER' for w in words)}, rank: {st.RANK[s]}, stage: '{s}'}}" for s, words in st.STAGE_WORDS.items())
    return f"(list_sort([{rows}], 'DESC')[1])"


@query("tx10_current_previous", f"""{with_(ANNOUNCEMENTS, NOTES, _TEXTS)}, cut AS (SELECT doc_id, substr(text, floor(length(text) * 2 / 3)::INTEGER + 1) AS b, substr(text, 1, floor(length(text) * 2 / 3)::INTEGER) AS a FROM texts),
    s AS (SELECT doc_id, {_stage_sql('b')} AS now, {_stage_sql('a')} AS before FROM cut), k AS (SELECT doc_id, CASE WHEN now.n > 0 THEN now.stage END AS current, CASE WHEN before.n > 0 THEN before.stage END AS previous FROM s)
    SELECT doc_id, current, CASE WHEN previous IS DISTINCT FROM current THEN previous END AS previous FROM k""")
def current_previous(spark, sf):
    now, before = op.current_and_previous(F.col("text"))
    return notes(spark, sf).select("doc_id", now.alias("current"), before.alias("previous"))
