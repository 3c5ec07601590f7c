"""Documents into evidence: line cleaning, chapters, token-bounded chunks, and evidence rows with stable ids.

Everything is an expression within one row, so a pass over the documents needs no shuffle; folds that depend on order
(packing lines into chunks) run over a row's own array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import ids
from ledgerloom.functions.rules import Rule, first_match

PAGE_LINE = r"^\s*(?:-?\s*\d+\s*-?|page \d+(?: of \d+)?|第\s*\d+\s*页)\s*$"
CHAPTER = r"^(?:#{1,4} |第[一二三四五六七八九十]+[章节]|[一二三四五六七八九十]+、|\d+(?:\.\d+)+ )"


def drop_page_lines(text: Column) -> Column:
    """Text without blank lines and lines that only number a page."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda s: (F.trim(s) != "") & ~F.lower(s).rlike(PAGE_LINE)), "\n")


def keep_prose(text: Column) -> Column:
    """Lines that are prose: no blank lines, bare links or addresses, and no table lines (3 bars or more, and over a quarter of the words)."""

    def prose(s: Column) -> Column:
        bars = F.regexp_count(s, F.lit(r"\|"))
        table = (bars >= 3) & (bars > F.size(F.split(s, " ")) * 0.25)
        return (F.trim(s) != "") & ~table & ~s.rlike(r"^\s*(?:https?://|www\.)\S+\s*$") & ~s.rlike(r"^\s*\S+@\S+\.\S+\s*$")

    return F.array_join(F.filter(F.split(text, "\n"), prose), "\n")


def chapters(docs: DataFrame, heading: str = CHAPTER) -> DataFrame:
    """(doc_id, chapter, heading, body): a text before the first heading is chapter 0."""
    marked = F.regexp_replace(F.col("body"), f"(?m){heading}", "\u0001$0")
    parts = docs.select("doc_id", F.posexplode(F.split(marked, "\u0001")).alias("chapter", "part")).filter(F.trim("part") != "")
    head = F.element_at(F.split("part", "\n"), 1)
    return parts.select("doc_id", "chapter", F.when(F.col("chapter") > 0, head).otherwise("").alias("heading"), F.col("part").alias("body"))


def chunks(docs: DataFrame, most_words: int) -> DataFrame:
    """(doc_id, idx, chunk, words): lines packed greedily into chunks of at most ``most_words`` words; a longer line is one chunk."""
    lines = F.transform(F.split("body", "\n"), lambda s: F.struct(s.alias("line"), F.regexp_count(s, F.lit(r"[^ \t\n\x0B\f\r]+")).alias("n")))
    lines = F.filter(lines, lambda x: x["n"] > 0)
    start = F.struct(F.array().cast("array<struct<text:string,n:int>>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["n"] == 0) | (acc["n"] + x["n"] <= most_words)
        flushed = F.concat(acc["done"], F.array(F.struct(acc["text"].alias("text"), acc["n"].alias("n"))))
        return F.struct(
            F.when(fits, acc["done"]).otherwise(flushed).alias("done"),
            F.when(fits & (acc["n"] > 0), F.concat(acc["text"], F.lit("\n"), x["line"])).otherwise(x["line"]).alias("text"),
            F.when(fits, acc["n"] + x["n"]).otherwise(x["n"]).alias("n"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["n"] > 0, F.concat(acc["done"], F.array(F.struct(acc["text"].alias("text"), acc["n"].alias("n"))))).otherwise(acc["done"])

    packed = docs.select("doc_id", F.posexplode(F.aggregate(lines, start, step, finish)).alias("idx", "c"))
    return packed.select("doc_id", "idx", F.col("c.text").alias("chunk"), F.col("c.n").alias("words"))


def classify_chapters(parts: DataFrame, rules: list[Rule], rescue_words: int) -> DataFrame:
    """keep or skip by heading rules; a skipped chapter with a substantive body (``rescue_words`` or more) is kept."""
    hit = first_match(F.col("heading"), rules, Rule("", "other", "keep"))
    words = F.regexp_count("body", F.lit(r"[^ \t\n\x0B\f\r]+"))
    action = F.when((hit["action"] == "skip") & (words >= rescue_words), "rescued").otherwise(hit["action"])
    return parts.select("doc_id", "chapter", hit["label"].alias("kind"), action.alias("action"), words.alias("words"))


def evidence(pieces: DataFrame, source_type: str, confidence: float) -> DataFrame:
    """Evidence rows of chunks (doc_id, idx, chunk): id, reference and default confidence."""
    checksum = ids.text_checksum(F.col("chunk"))
    eid = ids.evidence_id(F.lit(source_type), F.col("doc_id"), F.col("idx"), checksum)
    return pieces.select(eid.alias("evidence_id"), F.lit(source_type).alias("source_type"), "doc_id", "idx", checksum.alias("checksum"), F.substring("chunk", 1, 200).alias("excerpt"), F.lit(confidence).alias("confidence"))


def jobs(rows: DataFrame, types: list[str], version: str = "v1") -> DataFrame:
    """One pending job for each evidence row and job type."""
    each = rows.select("evidence_id", F.explode(F.array(*[F.lit(x) for x in types])).alias("job_type"))
    return each.select(ids.job_id(F.col("evidence_id"), F.col("job_type"), F.lit(version)).alias("job_id"), "evidence_id", "job_type", F.lit("pending").alias("status"))


def merge_by_day(questions: DataFrame, key: str, day: str) -> DataFrame:
    """All questions and answers of a key and day as one text, with their number."""
    pair = F.concat(F.lit("Q: "), F.coalesce("question", F.lit("")), F.lit("\nA: "), F.coalesce("answer", F.lit("")))
    return questions.groupBy(key, day).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", pair.alias("t")))), lambda x: x["t"]), "\n\n").alias("merged"), F.count(F.lit(1)).alias("pairs"))
