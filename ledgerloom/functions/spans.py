"""Where patterns match in a text, and what becomes of matches that overlap: folds over a row's own intervals.

A span is struct<start, end, text, kind>, from 0, end excluded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string,kind:string>"


def spans(text: Column, pattern: str, kind: str) -> Column:
    """array<span>: every match of a pattern, in order, none overlapping another (the pattern must not match nothing).

    A match begins after all the pieces between matches and all matches before it.
    """
    start = F.struct(F.array().cast(f"array<{SPAN}>").alias("done"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["between"])
        end = begin + F.length(x["found"])
        one = F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("text"), F.lit(kind).alias("kind"))
        return F.struct(F.concat(a["done"], F.array(one)).alias("done"), end.alias("at"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern), F.lit(1), F.size(found))
    pairs = F.zip_with(between, found, lambda b, f: F.struct(b.alias("between"), f.alias("found")))
    return F.aggregate(pairs, start, step, lambda a: a["done"])


def merged(found: Column) -> Column:
    """array<struct<start, end>>: spans that overlap or touch as one, in order."""
    plain = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    start = F.array().cast("array<struct<start:int,end:int>>")

    def step(a: Column, x: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joined = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(wider))
        return F.when((F.size(a) > 0) & (x["start"] <= last["end"]), joined).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(plain, start, step)


def replaced(text: Column, intervals: Column, by: str) -> Column:
    """The text with each of the disjoint, sorted intervals replaced by ``by``."""
    starts = F.concat(F.array(F.lit(0)), F.transform(intervals, lambda x: x["end"]))
    ends = F.concat(F.transform(intervals, lambda x: x["start"]), F.array(F.length(text)))
    return F.array_join(F.zip_with(starts, ends, lambda s, e: F.substring(text, s + 1, e - s)), by)


def leftmost_longest(found: Column) -> Column:
    """array<span>: of spans that overlap, the one that begins first, then the longest, then by kind; in order."""
    order = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("far"), x["kind"].alias("kind"), x["text"].alias("text"))))
    start = F.struct(F.array().cast(f"array<{SPAN}>").alias("done"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        one = F.struct(x["start"].alias("start"), (-x["far"]).alias("end"), x["text"].alias("text"), x["kind"].alias("kind"))
        return F.when(x["start"] < a["at"], a).otherwise(F.struct(F.concat(a["done"], F.array(one)).alias("done"), (-x["far"]).alias("at")))

    return F.aggregate(order, start, step, lambda a: a["done"])
