"""Rule tables as column expressions: first match, hit counts and dictionary search in one pass over a text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A keyword, the label it gives, and what to do; the order of a list of rules is their priority."""

    keyword: str
    label: str
    action: str = "keep"


def rule_array(rules: list[Rule]) -> Column:
    return F.array(*[F.struct(F.lit(r.keyword).alias("keyword"), F.lit(r.label).alias("label"), F.lit(r.action).alias("action")) for r in rules])


def first_match(text: Column, rules: list[Rule], default: Rule) -> Column:
    """The first rule, in priority order, whose keyword the text holds."""
    hits = F.filter(rule_array(rules), lambda r: F.contains(text, r["keyword"]))
    other = F.struct(F.lit(default.keyword).alias("keyword"), F.lit(default.label).alias("label"), F.lit(default.action).alias("action"))
    return F.coalesce(F.get(hits, F.lit(0)), other)


def hits(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords the text holds."""
    return F.size(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(text, k)))


def matches(text: Column, keywords: list[str]) -> Column:
    """The keywords that the text holds, in the list's order."""
    return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(text, k))


def best_label(text: Column, groups: dict[str, list[str]], default: str) -> Column:
    """The label with most keyword hits; the earlier one on a tie; ``default`` without any."""
    scored = F.array(*[F.struct(hits(text, kws).alias("n"), F.lit(-i).alias("order"), F.lit(label).alias("label")) for i, (label, kws) in enumerate(groups.items())])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["label"]).otherwise(default)


def sentences(text: Column) -> Column:
    """Non-empty sentences, ended by . ! ? 。！？； or a line feed."""
    return F.filter(F.transform(F.split(text, r"[.!?。！？；\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def polarity(text: Column, positive: list[str], negative: list[str]) -> Column:
    """positive, negative, conflict (both) or neutral."""
    p, n = hits(text, positive), hits(text, negative)
    return F.when((p > 0) & (n > 0), "conflict").when(p > 0, "positive").when(n > 0, "negative").otherwise("neutral")


def estimated_tokens(text: Column) -> Column:
    """1.5 for each CJK character and 0.25 for any other, truncated."""
    cjk = F.regexp_count(text, F.lit("[一-鿿]"))
    return (cjk * 1.5 + (F.length(text) - cjk) * 0.25).cast("int")


def unit_number(text: Column) -> Column:
    """The first number of a text, with 万, 亿 or 万亿 (or k, m, bn) applied."""
    number = F.regexp_extract(text, r"(-?[0-9]+(?:\.[0-9]+)?)\s*(万亿|亿|万|bn|k|m)?", 1)
    unit = F.regexp_extract(text, r"(-?[0-9]+(?:\.[0-9]+)?)\s*(万亿|亿|万|bn|k|m)?", 2)
    scale = F.when(unit == "万亿", 1e12).when(unit == "亿", 1e8).when(unit == "万", 1e4).when(unit == "bn", 1e9).when(unit == "m", 1e6).when(unit == "k", 1e3).otherwise(1.0)
    return F.when(number != "", number.cast("double") * scale)


def normalised_code(code: Column) -> Column:
    """Instrument code as digits.EXCHANGE from bare digits, prefix and suffix forms; null where it is none of them."""
    c = F.upper(F.trim(code))
    digits = F.regexp_extract(c, r"(\d{6})", 1)
    given = F.coalesce(F.nullif(F.regexp_extract(c, r"^(SH|SZ|BJ)\.?\d{6}$", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"^\d{6}\.(SH|SZ|BJ)$", 1), F.lit("")))
    head = F.substring(digits, 1, 1)
    inferred = F.when(head.isin("6", "9"), "SH").when(head.isin("0", "2", "3"), "SZ").when(head.isin("4", "8"), "BJ")
    exchange = F.coalesce(given, F.when(c.rlike(r"^\d{6}$"), inferred))
    return F.when(exchange.isNotNull(), F.concat(digits, F.lit("."), exchange))


def unit_weight(weight: Column, default: float = 0.5) -> Column:
    """A weight in 0..1: values over 1 are on a scale of 10; not a number gives the default."""
    bad = weight.isNull() | F.isnan(weight) | (F.abs(weight) == float("inf"))
    return F.when(bad, default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(weight > 1, weight / 10).otherwise(weight))))


def normalised_name(name: Column) -> Column:
    """NFKC form without characters that don't print, runs of white space as one space, ends stripped.

    Compatibility forms have no built-in, so this is an Arrow-batched function; plain ASCII skips it.
    """
    def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for names in batches:
            yield names.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKC", s) if c.isprintable() or c.isspace()))

    wide = F.when(~name.rlike(r"^[ -~]*$"), name)
    formed = F.coalesce(F.pandas_udf(nfkc, "string")(wide), name)
    return F.trim(F.regexp_replace(formed, r"\s+", " "))


def is_supported(code: Column) -> Column:
    """Codes of exchanges that the bars cover: not those that end in .BJ or .NQ, in any case."""
    return ~F.upper(code).rlike(r"\.(BJ|NQ)$")
