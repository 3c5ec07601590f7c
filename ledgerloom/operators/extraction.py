"""Extraction results into graph rows: merges of entity and relation mentions, life-cycle stages, validation, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.rules import hits

#: Order of types on a tie of mentions: the later one wins.
TYPE_ORDER = ("Company", "Product", "Metric")


def merge_entities(mentions: DataFrame) -> DataFrame:
    """(name, type, mentions, sources): each name's most frequent type, the later of TYPE_ORDER on a tie."""
    order = F.coalesce(*[F.when(F.col("type") == t, i) for i, t in enumerate(TYPE_ORDER)], F.lit(-1))
    by_type = mentions.groupBy("name", "type").agg(F.count(F.lit(1)).alias("c"), F.collect_set("source").alias("s"))
    out = by_type.groupBy("name").agg(F.max_by("type", F.struct("c", order.alias("o"))).alias("type"), F.sum("c").alias("mentions"), F.array_distinct(F.flatten(F.collect_list("s"))).alias("sources"))
    return out.select("name", "type", "mentions", F.size("sources").alias("sources"))


def merge_relations(mentions: DataFrame) -> DataFrame:
    """(src, dst, texts, direction, weight): distinct texts, the dominant direction or conflict if both signs occur, and
    the sum of positive weights."""
    out = mentions.groupBy("src", "dst").agg(
        F.countDistinct("text").alias("texts"), F.count_if(F.col("direction") > 0).alias("up"), F.count_if(F.col("direction") < 0).alias("down"), F.round(F.sum(F.greatest(F.lit(0.0), "weight")) * 1.000000000001, 4).alias("weight")
    )
    direction = F.when((F.col("up") > 0) & (F.col("down") > 0), "conflict").when(F.col("up") > 0, "positive").when(F.col("down") > 0, "negative").otherwise("neutral")
    return out.select("src", "dst", "texts", direction.alias("direction"), "weight")


def stage(text: Column, stages: dict[str, list[str]]) -> Column:
    """The life-cycle stage with most keyword hits; on a tie the later stage, then the one with the longer keyword."""
    scored = F.array(
        *[
            F.struct(hits(text, kws).alias("n"), F.lit(i).alias("rank"), F.array_max(F.transform(F.filter(F.array(*[F.lit(k) for k in kws]), lambda k: F.contains(text, k)), F.length)).alias("long"), F.lit(name).alias("stage"))
            for i, (name, kws) in enumerate(stages.items())
        ]
    )
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["stage"])


def transitions(text: Column, stages: dict[str, list[str]]) -> tuple[Column, Column]:
    """(previous, current) stage: of the first two thirds of a text and of its last third."""
    cut = F.floor(F.length(text) * 2 / 3).cast("int")
    return stage(F.substring(text, F.lit(1), cut), stages), stage(F.substring(text, cut + 1, F.length(text)), stages)


def reject_reason(signal: DataFrame, kinds: list[str], least_strength: int) -> Column:
    """Why a signal isn't taken, or null."""
    return (
        F.when(~F.col("kind").isin(kinds), "kind").when(F.col("strength").isNull() | (F.col("strength") < least_strength), "strength").when(F.length(F.trim(F.coalesce("subject", F.lit("")))) == 0, "subject")
    )


def alias_table(sources: list[tuple[int, DataFrame]]) -> DataFrame:
    """(alias, id): lower-case aliases of several sources (alias, id), the first source winning, then the smaller id."""
    every = None
    for priority, df in sources:
        one = df.select(F.lower(F.trim("alias")).alias("alias"), "id", F.lit(priority).alias("priority"))
        every = one if every is None else every.unionByName(one)
    return every.filter("alias <> ''").groupBy("alias").agg(F.min(F.struct("priority", "id")).alias("x")).select("alias", "x.id")


def merge_aliases(existing: DataFrame, new: DataFrame, full: bool) -> DataFrame:
    """Alias rows (alias, id, manual) after a load: an increment never overwrites; a full rebuild keeps manual rows only."""
    base = existing.filter("manual") if full else existing
    return base.unionByName(new.join(base.select("alias"), "alias", "left_anti"))


def _grams(name: str, size: int) -> Column:
    """The distinct character n-grams of a column of at least ``size`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - size + 1), lambda i: F.substring(F.col(name), i, F.lit(size))))


def containments(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(outer, inner): names of ``inner``, from two characters on, that lie in a name of ``outer``.

    A name that lies in another has all its n-grams there, so each inner name meets the outer ones that hold its rarest
    3-gram (of two characters: the name itself), and containment is tested there.
    """
    pairs = None
    for size, these in ((2, F.length("inner") == 2), (3, F.length("inner") >= 3)):
        held = outer.filter(F.length("outer") >= size).select("outer", F.explode(_grams("outer", size)).alias("gram"))
        own = inner.filter(these).select("inner", F.explode(_grams("inner", size)).alias("gram"))
        counted = own.join(held.groupBy("gram").agg(F.count(F.lit(1)).alias("c")), "gram", "left")
        rarest = counted.groupBy("inner").agg(F.min(F.struct(F.coalesce("c", F.lit(0)), "gram")).alias("x")).select("inner", "x.gram")
        met = held.join(rarest, "gram").filter(F.contains("outer", "inner")).select("outer", "inner")
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs


def user_hits(signals: DataFrame, holdings: DataFrame) -> DataFrame:
    """(signal_id, user, names): users whose names a signal's names equal or, from two characters on, hold or lie in."""
    each = signals.select("signal_id", F.explode("names").alias("n")).filter("n is not null").distinct()
    held = holdings.select("user", "name").filter("name is not null").distinct()
    a, b = each.select("n").distinct(), held.select("name").distinct()
    same = a.join(b, F.col("n") == F.col("name"))
    holds = containments(a.withColumnRenamed("n", "outer"), b.withColumnRenamed("name", "inner")).select(F.col("outer").alias("n"), F.col("inner").alias("name"))
    lies = containments(b.withColumnRenamed("name", "outer"), a.withColumnRenamed("n", "inner")).select(F.col("inner").alias("n"), F.col("outer").alias("name"))
    met = same.unionByName(holds).unionByName(lies).distinct()
    return each.join(met, "n").join(held, "name").groupBy("signal_id", "user").agg(F.array_sort(F.collect_set("name")).alias("names"))


def newest_k(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("rn", rn).filter(F.col("rn") <= k)
