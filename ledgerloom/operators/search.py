"""Name search over a table of entities: by id, else by what a name or alias holds, then ranked by likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grams(text: Column, length: int) -> Column:
    """The distinct character n-grams of a text of at least that length."""
    n = F.length(text)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n - (length - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(length)))
    return F.when(n >= length, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def token_likeness(a: Column, b: Column) -> Column:
    """0 to 1: edit distance of the lower-case tokens in order, over the longer one's length."""

    def key(text: Column) -> Column:
        return F.array_join(F.array_sort(F.split(F.lower(F.trim(text)), " +")), " ")

    return F.coalesce(1 - F.levenshtein(key(a), key(b)) / F.greatest(F.length(key(a)), F.length(key(b)), F.lit(1)), F.lit(0.0))


def holding(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``asked`` (..., low) joined with those of ``texts`` (..., text) that hold ``low``.

    What holds a query holds each of its n-grams (n = 3, or its length if shorter), so both meet at the one that fewest
    texts have: no pair is lost, and a beginning that all names share brings nothing together.
    """
    grammed = texts.select("*", F.explode(F.concat(*[grams(F.col("text"), n) for n in (1, 2, 3)])).alias("gram"))
    counts = grammed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    of = F.when(F.length("low") >= 3, grams(F.col("low"), 3)).otherwise(F.array("low"))
    wanted = asked.select("low").distinct().select("low", F.explode(of).alias("gram")).join(counts, "gram", "left")
    rarest = wanted.groupBy("low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).filter("g.n > 0").select("low", "g.gram")
    return asked.join(rarest, "low").join(grammed, "gram").filter(F.contains("text", F.col("low"))).drop("gram")


def resolved(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score) of queries (query_id, query) that an entity (id, name) answers: its id 1.0, its name 0.9, a name that
    holds the query 0.7; the best one, the smallest id on a tie.  Blank and null queries find nothing."""
    asked = queries.filter(F.trim(F.coalesce("query", F.lit(""))) != "").select("query_id", F.col("query").alias("low"))
    by_id = asked.join(entities.select("id", F.col("id").cast("string").alias("low")), "low").select("query_id", "id", F.lit(1.0).alias("score"))
    by_name = asked.join(entities.select("id", F.col("name").alias("low")), "low").select("query_id", "id", F.lit(0.9).alias("score"))
    within = holding(entities.select("id", F.col("name").alias("text")), asked).select("query_id", "id", F.lit(0.7).alias("score"))
    found = by_id.unionByName(by_name).unionByName(within)
    best = found.groupBy("query_id").agg(F.max("score").alias("score"))
    return found.join(best, ["query_id", "score"]).groupBy("query_id", "score").agg(F.min("id").alias("id")).select("query_id", "id", "score")


def entity_search(entities: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(query_id, id, score, place): the ``top`` entities (id, code, name, aliases, rank) for each query (query_id, query).

    A query that is an id or a code finds only that.  Others find the entities of which the name or an alias holds them
    (in any case); likeness of the name times the rank orders these, ids on a tie.  Blank queries find nothing.
    """
    asked = queries.filter(F.trim(F.coalesce("query", F.lit(""))) != "").select("query_id", F.trim("query").alias("query"))
    texts = asked.select("query").distinct()  # a text that many ask is looked up once
    names = entities.select("id", F.explode(F.array_distinct(F.concat(F.array("id"), F.array("code")))).alias("query"))
    direct = texts.join(names, "query").select("query", "id", F.lit(1.0).alias("likeness"))
    rest = texts.join(direct.select("query").distinct(), "query", "left_anti").withColumn("low", F.lower("query"))
    said = entities.select("id", "name", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower))).alias("text"))
    held = holding(said, rest).select("query", "id", token_likeness(F.col("query"), F.col("name")).alias("likeness")).distinct()
    scored = direct.unionByName(held).join(entities.select("id", "rank"), "id").withColumn("score", F.round(F.col("likeness") * F.col("rank"), 6))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    best = scored.withColumn("place", place).filter(F.col("place") <= top)
    return asked.join(best, "query").select("query_id", "id", "score", "place")
