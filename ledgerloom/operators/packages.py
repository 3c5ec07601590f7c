"""Material of a key, statements that diverge, nested detail of signals, and work lists of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The first number of a statement with what scales it.
NUMBER, SCALES = r"(\d+\.?\d*)\s*([万亿百]?[万亿百]?)", (("万亿", 1e12), ("亿", 1e8), ("万", 1e4))
#: Pairs and characters of an answer in a package.
MOST_PAIRS, ANSWER_CHARS = 50, 300


def stated_value(text: Column) -> Column:
    """The first number of a text with its 万, 亿 or 万亿; null without any."""
    number, unit = F.regexp_extract(text, NUMBER, 1), F.regexp_extract(text, NUMBER, 2)
    scale = F.coalesce(*[F.when(F.contains(unit, F.lit(u)), s) for u, s in SCALES], F.lit(1.0))
    return F.when(number != "", number.cast("double") * scale)


def divergence(statements: DataFrame) -> DataFrame:
    """(entity, metric, facts, estimates, claims, fact_value, estimate_value, gap_pct, direction) of (entity, metric, stmt_type, text, seq).

    Facts and estimates speak by the first of them, in ``seq`` order, that holds a number; of several with one ``seq`` by
    the smallest number.  A metric without facts and
    estimates isn't here; the gap is null where one value is missing or the fact is 0.
    """
    value = stated_value(F.coalesce("text", F.lit("")))
    first = lambda kind: F.min(F.when((F.col("stmt_type") == kind) & value.isNotNull(), F.struct("seq", value.alias("v"))))["v"]
    count = lambda kind: F.count_if(F.col("stmt_type") == kind)
    out = statements.groupBy("entity", "metric").agg(count("Fact").alias("facts"), count("Estimate").alias("estimates"), count("Claim").alias("claims"), first("Fact").alias("fact_value"), first("Estimate").alias("estimate_value"))
    gap = F.when(F.col("fact_value") != 0, (F.col("estimate_value") - F.col("fact_value")) / F.abs("fact_value") * 100)
    out = out.filter("facts > 0 or estimates > 0").withColumn("gap_pct", gap)
    return out.withColumn("direction", F.when(F.col("gap_pct") > 0, "bullish").when(F.col("gap_pct") < 0, "bearish").when(F.col("gap_pct") == 0, "neutral"))


def material_package(pairs: DataFrame, key: str, day: str, seq: str, most: int = MOST_PAIRS, chars: int = ANSWER_CHARS) -> DataFrame:
    """(key, pairs, first_day, last_day, material): the newest ``most`` questions and answers of a key, answers cut at ``chars``."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(day), F.desc(seq)))
    newest = pairs.withColumn("rn", rn).filter(F.col("rn") <= most)
    one = F.struct("rn", F.coalesce("question", F.lit("")).alias("question"), F.substring(F.coalesce("answer", F.lit("")), 1, chars).alias("answer"), F.col(day).alias("day"))
    packed = newest.groupBy(key).agg(F.count(F.lit(1)).alias("pairs"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.array_sort(F.collect_list(one)).alias("material"))
    return packed.select(key, "pairs", "first_day", "last_day", F.transform("material", lambda m: m.dropFields("rn")).alias("material"))


def signal_details(signals: DataFrame, propagations: DataFrame) -> DataFrame:
    """Each signal with all its propagations (target, relation_path, direction, confidence), the most confident first; an empty list without any."""
    one = F.struct((-F.col("confidence")).alias("order"), "target", "relation_path", "direction", "confidence")
    nested = propagations.groupBy("signal_id").agg(F.array_sort(F.collect_list(one)).alias("p"))
    nested = nested.select("signal_id", F.transform("p", lambda x: x.dropFields("order")).alias("propagations"))
    empty = F.array().cast(nested.schema["propagations"].dataType)
    return signals.join(nested, "signal_id", "left").withColumn("propagations", F.coalesce("propagations", empty))


def vector_work(chunks: DataFrame, vectors: DataFrame, attempts: DataFrame, most: int = 3) -> DataFrame:
    """(id, action, failures) of chunks (id) without a vector: index (never tried), retry (the last try failed) or give_up (``most`` failures in all).

    A chunk whose last try succeeded, and which lacks its vector all the same, is indexed again.  ``attempts``: id, seq, ok.
    """
    tried = attempts.groupBy("id").agg(F.max_by("ok", "seq").alias("last_ok"), F.count_if(~F.col("ok")).alias("failures"))
    missing = chunks.select("id").distinct().join(vectors.select("id"), "id", "left_anti").join(tried, "id", "left")
    failures = F.coalesce("failures", F.lit(0)).cast("long")
    action = F.when(F.coalesce("last_ok", F.lit(True)), "index").when(failures >= most, "give_up").otherwise("retry")
    return missing.select("id", action.alias("action"), failures.alias("failures"))
