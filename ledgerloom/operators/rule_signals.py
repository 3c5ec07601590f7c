"""Signals by rule from texts of any source, and how they travel along the graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import signal_rules as r
from ledgerloom.functions.ids import signal_id

# Relations that make a path one of supply, of demand or of competition, and what else is an industry's.
UPSTREAM = ("UPSTREAM", "SUPPLIES", "SUPPLIES_TO", "COMPONENT_OF", "MATERIAL_FOR")
DOWNSTREAM = ("DOWNSTREAM", "CUSTOMER", "USED_BY", "APPLICATION", "APPLIES_TO")
COMPETITIVE = ("COMPETES_WITH", "PEER", "SAME_INDUSTRY", "SIMILAR_TO")
INDUSTRY_KINDS, SHORT_KINDS = ("policy", "capacity", "capex"), ("mass_production", "order", "earnings")
# Shares of source, strength and edges in a path's confidence, and what a second edge takes off.
SOURCE, STRENGTH, EDGES, SECOND = 0.3, 0.3, 0.4, 0.04


def rule_signals(payloads: DataFrame) -> DataFrame:
    """One row for each payload (source_type, source_id, title, summary, content, published_at) and kind that it shows.

    The first keyword, by preference, decides; the first sentence that holds it is the evidence.  Null and empty parts
    of a payload count as absent; a payload without text gives no rows.
    """
    text = F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in ("title", "summary", "content")])
    rules = F.transform(r.rule_table(), lambda x: x.withField("keywords", F.filter(x["keywords"], lambda w: r.holds(F.col("_text"), w))))
    hit = payloads.withColumn("_text", text).select("*", F.explode(F.filter(rules, lambda x: F.size(x["keywords"]) > 0)).alias("_rule"))
    hit = hit.withColumn("_word", F.col("_rule.keywords")[0])
    parts = r.sentences(F.col("_text"))
    sentence = F.coalesce(F.get(F.filter(parts, lambda s: r.holds(s, F.col("_word"))), F.lit(0)), F.get(parts, F.lit(0)))
    hit = hit.withColumn("_sentence", sentence)
    confidence = F.when(F.col("source_type").isin(*r.TRUSTED), r.CONFIDENCE[0]).otherwise(r.CONFIDENCE[1])
    subject = r.subject_name(F.col("_rule.kind"), F.col("title"), F.col("_sentence"))
    out = hit.select(
        "source_type", "source_id", "published_at", subject.alias("subject_name"), F.col("_rule.subject_type").alias("subject_type"), F.col("_rule.kind").alias("kind"), F.col("_rule.polarity").alias("polarity"), F.col("_word").alias("keyword"),
        r.strength(F.col("_sentence"), F.col("_rule.base")).alias("strength"), confidence.alias("confidence"), F.substring("_sentence", 1, 160).alias("summary"), F.substring("_sentence", 1, 240).alias("excerpt"),
    )
    value = F.least(F.lit(100), (F.col("strength") * 0.65 + F.col("confidence") * 25).cast("int"))
    key = signal_id(F.col("source_type"), F.col("source_id"), F.col("subject_name"), F.col("kind"), F.col("excerpt"))
    fresh = F.when(F.col("published_at").isNull(), 50).otherwise(100)
    return out.select(key.alias("signal_id"), "*", value.alias("value"), fresh.alias("freshness"))


def _any(rels: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(rels, F.array(*[F.lit(n) for n in names]))


def _read(paths: DataFrame) -> DataFrame:
    """What every signal of a subject has in common on its paths of one or two edges; paths that read alike once."""
    kept = paths.filter(F.size("rels").between(1, 2) & (F.size("nodes") == F.size("rels") + 1))
    clipped = F.transform("weights", lambda w: F.greatest(F.lit(0.0), F.least(w, F.lit(1.0))))
    edge = F.aggregate(clipped, F.lit(0.0), lambda s, w: s + w) / F.size("weights")
    steps = F.zip_with("rels", F.slice("nodes", 2, F.size("nodes")), lambda rel, node: F.concat(F.lit("-["), rel, F.lit("]-> "), node))
    by_rel = F.when(_any(F.col("rels"), UPSTREAM), "supply_chain_validation").when(_any(F.col("rels"), DOWNSTREAM), "customer_demand_validation").when(_any(F.col("rels"), COMPETITIVE), "competitive_readthrough")
    out = kept.select("subject", F.element_at("nodes", -1).alias("target"), F.concat_ws(" ", F.col("nodes")[0], steps).alias("relation_path"), by_rel.alias("by_rel"), F.size("rels").alias("hops"), edge.alias("edge"))
    return out.dropDuplicates(["subject", "target", "relation_path"])


def _propagated(path: Callable[[str], Column]) -> list[Column]:
    """The columns of a propagation: a signal's own (kind, polarity, strength, confidence) with ``path``'s of ``_read``."""
    second = F.when(F.col("kind") == "risk", "risk_contagion").when(path("by_rel").isNotNull(), path("by_rel")).when(F.col("kind").isin(*INDUSTRY_KINDS), "industry_readthrough").otherwise("expectation_gap_candidate_unverified")
    direction = F.when((F.col("polarity") == "risk") | (second == "risk_contagion"), "risk").when(second == "competitive_readthrough", "uncertain").otherwise("beneficiary")
    horizon = F.when(F.col("kind") == "risk", "immediate").when(F.col("kind").isin(*SHORT_KINDS), "short").when(second == "industry_readthrough", "medium").otherwise("short")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(c, F.lit(1.0)))
    score = unit(F.col("confidence")) * SOURCE + unit(F.col("strength") / 100) * STRENGTH + path("edge") * EDGES - SECOND * (path("hops") - 1)
    return [path("target").alias("target"), path("relation_path").alias("relation_path"), second.alias("secondary_type"), direction.alias("direction"), horizon.alias("horizon"), path("hops").alias("hops"), unit(score).alias("confidence")]


def path_propagation(signals: DataFrame, paths: DataFrame, also: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """A row for each signal (signal_id, subject, kind, polarity, strength, confidence) and path of its subject.

    ``paths``: subject, nodes, rels, weights (one or two edges).  Each path is scored by itself; paths that read alike
    count once, and so do signals: what is exchanged is signals and paths, and no propagation.  A signal without any path isn't
    here: see ``without_path``.  ``also``: columns of the signals to keep.  ``tasks``: rows come dealt by subject over so many.
    """
    once, read = signals.dropDuplicates(["signal_id", "subject"]), _read(paths)
    if tasks:
        once, read = signals.repartition(tasks, "subject").dropDuplicates(["signal_id", "subject"]), read.repartition(tasks, "subject")
    return once.join(read, "subject").select("signal_id", *also, *_propagated(F.col))


def path_details(signals: DataFrame, paths: DataFrame, stated: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(signal_id, kind, propagations): each signal of ``path_propagation`` with all of its propagations (target, relation_path,
    direction, confidence as ``stated``), the most confident first; an empty list without any.

    A subject's paths are listed once, and every signal's propagations are made from that list, so none is exchanged.
    """
    parts = ("target", "relation_path", "by_rel", "hops", "edge")
    lists = _read(paths).groupBy("subject").agg(F.collect_list(F.struct(*parts)).alias("paths"))

    def one(path: Column) -> Column:
        by = {c: path[c] for c in parts}
        target, relation_path, _, direction, _, _, confidence = _propagated(by.__getitem__)
        return F.struct((-stated(confidence)).alias("order"), target, relation_path, direction, stated(confidence).alias("confidence"))

    every = F.transform(F.array_sort(F.transform("paths", one)), lambda x: x.dropFields("order"))
    joined = signals.dropDuplicates(["signal_id", "subject"]).join(lists, "subject", "left").select("signal_id", "kind", every.alias("propagations"))
    return joined.withColumn("propagations", F.coalesce("propagations", F.array().cast(joined.schema["propagations"].dataType)))


def without_path(signals: DataFrame, paths: DataFrame) -> DataFrame:
    """Signals of subjects that no path leaves; templates speak for them."""
    return signals.join(paths.select("subject").distinct(), "subject", "left_anti")


def older_signals(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, content, gap, strength): for each keyword of the older kinds the first sentence that holds it, once a kind.

    Sentences end at 。；！？，, and line feeds and have six characters or more; contents that begin alike are one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.filter(F.transform(F.split(text, "[。；！？\n,，]"), F.trim), lambda s: F.length(s) >= r.SHORTEST_SENTENCE)
    rows = texts.select(id_col, F.explode(F.array(parts)).alias("parts"))
    words = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k"), F.lit(w).alias("word")) for kind, ws in r.OLDER_SIGNALS.items() for k, w in enumerate(ws)])
    hit = rows.select(id_col, F.explode(F.filter(F.transform(words, lambda x: F.struct(x["kind"].alias("kind"), x["k"].alias("k"), F.get(F.filter("parts", lambda s: F.contains(s, x["word"])), F.lit(0)).alias("sentence"))), lambda x: x["sentence"].isNotNull())).alias("x"))
    hit = hit.select(id_col, "x.kind", "x.k", F.substring("x.sentence", 1, r.CONTENT).alias("content"), r.gap(F.col("x.sentence")).alias("gap"), r.strength_label(F.col("x.sentence")).alias("strength"))
    first = hit.groupBy(id_col, "kind", F.substring("content", 1, r.SAME).alias("_same")).agg(F.min_by(F.struct("content", "gap", "strength"), "k").alias("x"))
    return first.select(id_col, "kind", "x.content", "x.gap", "x.strength")
