"""Stage moves told by texts: sentence by sentence, and over a text's sentences in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import stages as st

#: Confidence of each way to see a move, in the order in which they count.
CONFIDENCE = {"explicit_pattern": 0.85, "adjacent_states": 0.70, "current_vs_historical": 0.75, "cross_sentence_progression": 0.65}


def staged_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, i, sentence, shown, leading, past) for sentences that show a stage: its stages in order, and its highest."""
    cut = F.filter(F.transform(F.split(F.coalesce(text_col, F.lit("")), "[。！？\n]"), F.trim), lambda s: s != "")
    rows = docs.select(id_col, F.posexplode(cut).alias("i", "sentence")).withColumn("shown", st.shown_stages(F.col("sentence"))).filter(F.size("shown") > 0)
    leading = F.array_max(F.transform("shown", lambda s: F.struct(st.lookup(st.LEVEL)[s].alias("level"), s.alias("stage"))))["stage"]
    return rows.select("*", leading.alias("leading"), F.col("sentence").rlike(st.PAST).alias("past"))


def _move(before: Column, after: Column, kind: str, order: Column, evidence: Column) -> Column:
    return F.struct(before.alias("from_stage"), after.alias("to_stage"), F.lit(kind).alias("source_type"), order.cast("long").alias("at"), evidence.alias("evidence"))


def stage_moves(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, from_stage, to_stage, direction, source_type, confidence, evidence): the possible moves that a text tells, once each.

    A sentence tells one if it states a move (from the other stage that it shows, else RND), or shows two stages around
    a verb of change and doesn't speak of the present; a text does by its last past and its last present stage, and by
    present stages that follow each other upwards.  The way that counts first names the move.
    """
    rows = staged_sentences(docs, id_col, text_col)
    first, last = F.col("shown")[0], F.element_at("shown", -1)
    other = F.coalesce(F.get(F.filter("shown", lambda s: s != F.col("shown")[0]), F.lit(0)), F.lit("RND"))
    said, turned = F.col("sentence").rlike(st.STATED), (F.size("shown") >= 2) & F.col("sentence").rlike(st.VERBS) & ~F.col("sentence").rlike(st.PRESENT)
    excerpt = F.substring("sentence", 1, 200)
    told = F.array_compact(F.array(F.when(said, _move(other, first, "explicit_pattern", 2 * F.col("i"), excerpt)), F.when(turned, _move(first, last, "adjacent_states", 2 * F.col("i") + 1, excerpt))))
    moves = rows.select(id_col, F.explode(told).alias("m")).filter("m.from_stage <> m.to_stage")

    ends = rows.groupBy(id_col).agg(F.max_by("leading", F.when(F.col("past"), F.col("i"))).alias("before"), F.max_by("leading", F.when(~F.col("past"), F.col("i"))).alias("now"))
    note = F.concat(F.lit("now "), "now", F.lit(", before "), "before")
    moves = moves.unionByName(ends.filter("before is not null and now is not null").select(id_col, _move(F.col("before"), F.col("now"), "current_vs_historical", F.lit(1 << 40), note).alias("m")))

    in_order = Window.partitionBy(id_col).orderBy("i")
    steps = rows.withColumn("n", F.row_number().over(in_order)).filter("not past or n = 1").withColumn("before", F.lag("leading").over(in_order)).filter("n > 1 and before <> leading")
    steps = steps.filter(st.direction(F.col("before"), F.col("leading")) != "negative")
    moves = moves.unionByName(steps.select(id_col, _move(F.col("before"), F.col("leading"), "cross_sentence_progression", (1 << 41) + F.col("i"), excerpt).alias("m")))

    moves = moves.filter(st.possible(F.col("m.from_stage"), F.col("m.to_stage")))
    best = moves.groupBy(id_col, F.col("m.from_stage").alias("from_stage"), F.col("m.to_stage").alias("to_stage")).agg(F.min_by("m", "m.at").alias("m"))
    return best.select(id_col, "from_stage", "to_stage", st.direction(F.col("from_stage"), F.col("to_stage")).alias("direction"), "m.source_type", st.lookup(CONFIDENCE)[F.col("m.source_type")].alias("confidence"), "m.evidence", F.col("m.at").alias("at"))


def move_signal(moves: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, signal, urgency, level, from_stage, to_stage): what a text's moves amount to, by its first of the weightiest kind.

    A move from PILOT or EARLY_ADOPTION to GROWTH is a production inflection, then come other moves forward, then back.
    """
    inflection = (F.col("direction") == "positive") & F.col("from_stage").isin("PILOT", "EARLY_ADOPTION") & (F.col("to_stage") == "GROWTH")
    kind = F.when(inflection, 0).when(F.col("direction") == "positive", 1).when(F.col("direction") == "negative", 2)
    best = moves.withColumn("kind", kind).filter("kind is not null").groupBy(id_col).agg(F.min_by(F.struct("kind", "from_stage", "to_stage"), F.struct("kind", "at")).alias("m"))
    pick = {0: ("PRODUCTION_INFLECTION", 5, "A+"), 1: ("STATE_ADVANCE", 3, "B"), 2: ("STATE_DECLINE", 4, "B+")}
    choose = [F.element_at(F.array(*[F.lit(pick[k][j]) for k in pick]), F.col("m.kind") + 1) for j in range(3)]
    return best.select(id_col, choose[0].alias("signal"), choose[1].alias("urgency"), choose[2].alias("level"), "m.from_stage", "m.to_stage")


def current_and_previous(text: Column) -> tuple[Column, Column]:
    """(current, previous): the stages of the last third of a text and of what comes before; equal ones are no change."""
    cut = F.floor(F.length(text) * 2 / 3).cast("int")
    now, before = st.text_stage(F.substring(text, cut + 1, F.length(text))), st.text_stage(F.substring(text, F.lit(1), cut))
    return now, F.when(now.eqNullSafe(before), F.lit(None)).otherwise(before)
