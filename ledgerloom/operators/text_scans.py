"""Texts read for spans: compliance with redaction, entities and intents of queries, and names of a dictionary table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import query_rules as r
from ledgerloom.functions.spans import leftmost_longest, merged, replaced, spans
from ledgerloom.sources.folders import ship_package


def compliance(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, passed, violations, warnings, redacted): hits by rule as (rule, n), and the text with every hit redacted.

    Hits of different rules that overlap or touch are redacted once, and count for each of their rules.  Warnings are
    looked for in what is left.  A null text counts as empty.
    """

    def by_rule(found: Column, rules) -> Column:
        kinds = F.transform(found, lambda x: x["kind"])
        counts = F.array(*[F.struct(F.lit(name).alias("rule"), (F.size(kinds) - F.size(F.array_remove(kinds, name))).alias("n")) for _, name in rules])
        return F.filter(counts, lambda c: c["n"] > 0)

    def all_of(text: Column, rules) -> Column:
        return F.concat(*[spans(text, pattern, name) for pattern, name in rules])

    # each step is a column of its own, so that no fold is worked out twice
    rows = texts.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).select(id_col, "_text", F.explode(F.array(all_of(F.col("_text"), r.FORBIDDEN))).alias("_found"))
    rows = rows.select(id_col, "_found", F.explode(F.array(replaced(F.col("_text"), merged(F.col("_found")), r.REDACTED))).alias("redacted"))
    warned = all_of(F.col("redacted"), r.WARNINGS)
    return rows.select(id_col, (F.size("_found") == 0).alias("passed"), by_rule(F.col("_found"), r.FORBIDDEN).alias("violations"), by_rule(warned, r.WARNINGS).alias("warnings"), "redacted")


def query_analysis(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(id, entities, spans, query_type, intent, strategy) of search queries.

    ``entities``: codes, company names, industries, the two sides of a connector and names before a possessive that lie
    in none of these, each once, in that order.  ``spans``: where they stand; of those that overlap, the one that begins first
    and is longest.  Intent: a path needs two entities; then relation, state, or just the entity.
    """
    q = F.coalesce(F.col(text_col), F.lit(""))
    first = F.get(spans(q, r.CONNECTOR, "connector"), F.lit(0))
    left, right = F.substring(q, F.lit(1), F.col("_c.start")), F.substring(q, F.col("_c.end") + 1, F.length(q))
    left_name, right_name = F.regexp_extract(left, r.LEFT_NAME, 0), F.regexp_extract(right, r.RIGHT_NAME, 1)
    right_all = F.regexp_extract(right, r.RIGHT_NAME, 0)
    joined = F.col("_c").isNotNull() & (left_name != "") & (F.length(right_name) >= 2)

    def span(start: Column, text: Column, kind: str) -> Column:
        return F.struct(start.cast("int").alias("start"), (start + F.length(text)).cast("int").alias("end"), text.alias("text"), F.lit(kind).alias("kind"))

    named = F.concat(spans(q, r.CODE, "code"), spans(q, r.COMPANY, "company"), spans(q, r.INDUSTRY, "industry"))
    # a name that stands there again says nothing new, and its place isn't taken
    once = F.filter("_named", lambda x, i: F.array_position(F.transform("_named", lambda y: y["text"]), x["text"]) == i + 1)
    left_at = F.col("_c.start") - F.length(left_name)
    pair = F.when(joined, F.array(span(left_at, left_name, "left"), span(F.col("_c.end"), right_name, "right")))
    taken = F.concat(F.transform("_once", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), F.coalesce(F.when(joined, F.array(F.struct(left_at.cast("int").alias("start"), (F.col("_c.end") + F.length(right_all)).cast("int").alias("end")))), F.array().cast("array<struct<start:int,end:int>>")))
    owners = F.transform(spans(q, r.OWNER, "owner"), lambda x: x.withField("end", x["end"] - 1).withField("text", F.substring(x["text"], F.lit(1), F.length(x["text"]) - 1)))
    free = F.filter(owners, lambda x: ~x["text"].rlike("[和与跟]") & ~F.exists("_taken", lambda s: (x["start"] < s["end"]) & (x["end"] > s["start"])))

    rows = queries.select(id_col, text_col, F.explode(F.array(named)).alias("_named"), first.alias("_c"))
    rows = rows.select(id_col, text_col, "_c", F.explode(F.array(once)).alias("_once"))
    rows = rows.select(id_col, text_col, "_once", F.explode(F.array(F.coalesce(pair, F.array().cast("array<struct<start:int,end:int,text:string,kind:string>>")))).alias("_pair"), taken.alias("_taken"))
    rows = rows.select(id_col, text_col, F.explode(F.array(F.concat("_once", "_pair", free))).alias("_all"))
    entities = F.array_distinct(F.transform("_all", lambda x: x["text"]))
    two = F.size(entities) >= 2
    kind = F.when(q.rlike(r.PATH_WORDS) & two, "path_finding").when(q.rlike(r.PAIR) & two, "path_finding").when(q.rlike(r.RELATION_WORDS), "entity_relation").when(q.rlike(r.STATE_WORDS), "industry_state").otherwise("entity_search")
    told = rows.select(id_col, entities.alias("entities"), leftmost_longest(F.col("_all")).alias("spans"), kind.alias("query_type"))
    of = lambda k: F.coalesce(*[F.when(F.col("query_type") == name, pair[k]) for name, pair in r.INTENTS.items()])
    return told.select("*", of(0).alias("intent"), of(1).alias("strategy"))


#: Characters of names in one automaton: some tens of MB in a worker, whatever the dictionary.
SHARD_CHARS = 2_000_000


def _finder(names):
    """Matches of one shard's names, by an automaton that a worker builds once for a task."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        words = ahocorasick.Automaton()
        for name in names.value:
            words.add_word(name, name)
        words.make_automaton()
        for frame in frames:
            ids, tags = [], []
            for i, text in zip(frame.iloc[:, 0], frame.iloc[:, 1]):
                found = sorted({name for _, name in words.iter(text)}) if text else []
                ids += [i] * len(found)
                tags += found
            yield pd.DataFrame({frame.columns[0]: ids, "tag": tags}).astype({frame.columns[0]: frame.dtypes.iloc[0]})

    return find


def dictionary_tags(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(id, tag): every name of the dictionary that stands anywhere in a text, once for each row of ``texts``.

    Texts are read once for each shard of the dictionary and never shuffled.  A shard's names are broadcast: shards are cut
    by hash so that they hold about ``shard_chars`` characters.  Empty and null names match nothing; ids must not be null.
    """
    spark = texts.sparkSession
    ship_package(spark)
    words = names.select(F.col(names.columns[0]).cast("string").alias("name")).filter("name <> ''").distinct()
    total = words.agg(F.sum(F.length("name"))).first()[0] or 0
    shards = max(1, -(-total // shard_chars))
    kind = texts.schema[id_col].dataType.simpleString()
    found = []
    for k in range(shards):
        some = [r.name for r in words.filter(F.pmod(F.xxhash64("name"), F.lit(shards)) == k).collect()] if total else []
        if some:
            found.append(texts.select(id_col, text_col).mapInPandas(_finder(spark.sparkContext.broadcast(some)), f"{id_col} {kind}, tag string"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"{id_col} {kind}, tag string")
