"""A corpus pipeline: toxicity, quality, line dedup, near dedup and packing, each stage over all that is left.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, bitmaps, in_bitmaps
from ledgerloom.llm.line_dedup import line_run_dedup
from ledgerloom.llm.ngram_join import ngram_jaccard_join
from ledgerloom.llm.packing import best_fit_packing
from ledgerloom.llm.quality import quality_scores
from ledgerloom.llm.queries import tokenizer_file
from ledgerloom.llm.toxicity import toxicity_scores

#: What a stage hands on: the columns of documents; others are not read.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go; it learns from the labelled rows of the whole corpus."""
    return toxicity_scores(docs, _read(spark, sf_dir, "labels"), train_docs=_read(spark, sf_dir, "documents"), keep=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote rejects go."""
    return quality_scores(docs, _read(spark, sf_dir, "labels"), train_docs=_read(spark, sf_dir, "documents"), keep=COLUMNS).filter("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of later copies of repeated runs go; a document of which no line is left goes with them."""
    out = line_run_dedup(docs.select(*COLUMNS)).filter("n_deleted < n_lines")
    return out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: the one with the smallest id.

    Rows without an id stay.  Rows that repeat an id stay or go together: they stay if one of them is its group's.
    """
    scratch = Scratch(spark, "near-dedup")
    gone = ngram_jaccard_join(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"))
    gone = scratch.cut(gone.filter("not kept").select("doc_id"), "gone")
    # a bitmap of the ids that go lets nearly all other texts stay where they are
    bits = scratch.cut(bitmaps(gone, F.xxhash64("doc_id")), "bits")
    marked = in_bitmaps(docs.select(*COLUMNS), F.xxhash64("doc_id"), bits, "_may_go")
    rest = marked.filter("_may_go").join(gone, "doc_id", "left_anti")
    return marked.filter("not _may_go").unionByName(rest).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 2048 tokens."""
    return best_fit_packing(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Learned scores and connected components have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = _read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs
