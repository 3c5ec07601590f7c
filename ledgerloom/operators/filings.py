"""Facts that filings state by rule: structured facts of evidence, and metrics that an extraction missed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import filing_rules as r


def structured_facts(evidence: DataFrame) -> DataFrame:
    """(fact_id, subject_id, dimension, state_value, evidence_id, evidence_text, confidence, trigger) of (evidence_id, subject_id, text, observed_at, confidence).

    Evidence without a subject states nothing; a fact whose dimension or value is forbidden is left out.
    """
    rows = evidence.filter(F.trim(F.coalesce("subject_id", F.lit(""))) != "").select("*", F.explode(r.stated_facts(F.coalesce("text", F.lit("")))).alias("f"))
    rows = rows.filter(r.forbidden_value(F.col("f.dimension"), F.col("f.state_value")).isNull()).withColumn("subject_id", F.trim("subject_id"))
    key = F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("subject_id", "f.dimension", "f.state_value", "observed_at", "evidence_id")])
    confidence = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, r.FACT_CONFIDENCE).otherwise(F.col("confidence"))
    return rows.select(F.concat(F.lit("SF:"), F.substring(F.sha2(key, 256), 1, 24)).alias("fact_id"), "subject_id", "f.dimension", "f.state_value", "evidence_id", F.substring("text", 1, r.EXCERPT).alias("evidence_text"), confidence.alias("confidence"), "f.trigger")


def fallback_facts(filings: DataFrame, entities: DataFrame, relations: DataFrame, year_else: int) -> DataFrame:
    """What official filings disclose and an extraction lacks: (doc_id, record, source, target, description, unit, period, period_type).

    ``filings``: doc_id, source_type, source_name, company, text.  A missing company and missing metrics come as entities, a missing
    disclosure of a metric by the company as a relation.  ``entities`` (doc_id, name, type) and ``relations`` (doc_id, source,
    target, description) are what was extracted.
    """
    official = filings.filter(F.col("source_type").isin(*r.OFFICIAL)).withColumn("p", r.report_period(F.col("text"), F.col("source_name"), year_else))
    terms = F.filter(F.array(*[F.lit(m) for m in r.METRICS]), lambda m: F.contains(F.col("text"), m))
    said = official.select("doc_id", "source_name", "company", "p.*", F.explode(F.transform(terms, lambda m: F.struct(m.alias("term"), r.unit_near(F.col("text"), m).alias("unit")))).alias("m"))
    said = said.select("*", "m.*", F.concat("source_name", F.lit("披露"), "period", "m.term").alias("description"))
    none = F.lit(None).cast("string")
    companies = official.filter("company <> ''").select("doc_id", F.lit("Company").alias("record"), none.alias("source"), F.col("company").alias("target"), F.concat("source_name", F.lit("公告主体")).alias("description"), none.alias("unit"), none.alias("period"), none.alias("period_type"))
    metrics = said.select("doc_id", F.lit("Metric").alias("record"), none.alias("source"), F.col("term").alias("target"), "description", "unit", "period", "period_type")
    linked = said.filter("company <> ''").select("doc_id", F.lit("Relation").alias("record"), F.col("company").alias("source"), F.col("term").alias("target"), "description", none.alias("unit"), "period", "period_type")
    have = entities.select("doc_id", F.col("type").alias("record"), F.col("name").alias("target")).distinct()
    known = relations.select("doc_id", "source", "target", "description").distinct()
    return companies.unionByName(metrics).join(have, ["doc_id", "record", "target"], "left_anti").unionByName(linked.join(known, ["doc_id", "source", "target", "description"], "left_anti"))
