"""Records of extraction and of the graph: parsed responses, checked signals, node merges, ledgers, chains and vector texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import signal_rules as r
from ledgerloom.operators.graph import connected, cut

# What a checked signal may have, and the phrases of a disclaimer.
POLARITIES, SUBJECT_TYPES, LEAST_STRENGTH = ("positive", "negative", "risk"), ("company", "product", "sector", "policy"), 20
DISCLAIMERS = ("不确定性", "敬请投资者注意", "风险提示", "注意风险", "谨慎决策", "敬请投资者")
LEAST_SAID, LEAST_EXCERPT = 6, 4
NODE_TYPES = ("Company", "Product", "Concept", "Industry", "Metric", "Technology", "Application", "Person", "Event")
RESPONSE = "entities array<struct<name:string,type:string>>, relations array<struct<entity1:string,entity2:string,description:string,confidence:double,stmt_type:string>>"


def chinese(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[一-鿿]"))


def said_beside_disclaimers(text: Column) -> Column:
    for phrase in DISCLAIMERS:
        text = F.replace(text, F.lit(phrase), F.lit(""))
    return chinese(F.regexp_replace(text, "[，。！？、；：\"“”'（）\\s]", ""))


def reject_reason(kind: Column, polarity: Column, subject: Column, subject_type: Column, strength: Column, excerpt: Column) -> Column:
    """Why a signal is refused, the first reason of: kind, polarity, subject, subject_type, strength, disclaimer, excerpt; null if it isn't."""
    excerpt = F.trim(F.coalesce(excerpt, F.lit("")))
    known = lambda c, names: F.coalesce(c, F.lit("")).isin(*names)
    out = F.when(~known(kind, tuple(r.SIGNALS)), "kind").when(~known(polarity, POLARITIES), "polarity").when(F.trim(F.coalesce(subject, F.lit(""))) == "", "subject").when(~known(F.trim(subject_type), SUBJECT_TYPES), "subject_type")
    out = out.when(F.coalesce(strength.cast("int"), F.lit(0)) < LEAST_STRENGTH, "strength")
    return out.when((kind == "risk") & (said_beside_disclaimers(excerpt) < LEAST_SAID), "disclaimer").when(chinese(excerpt) < LEAST_EXCERPT, "excerpt")


def parsed_response(raw: Column) -> Column:
    """struct<entities, relations> of a language model's raw answer: its fenced or bare JSON, of equal names the first
    entity, and relations between these only; null where there is no such JSON."""
    fenced = F.when(F.contains(raw, F.lit("```")), F.regexp_extract(raw, r"(?s)```(?:json)?(.*?)(?:```|$)", 1)).otherwise(raw)
    return F.from_json(F.trim(fenced), RESPONSE)


def entities_and_relations(responses: DataFrame, id_col: str, raw_col: str) -> tuple[DataFrame, DataFrame]:
    """((id, name, type), (id, entity1, entity2, description, confidence, stmt_type)) of raw answers.

    An answer is one row, so both rules are applied within it.
    """
    parsed = responses.select(id_col, F.explode(F.array(parsed_response(F.col(raw_col)))).alias("p")).filter("p is not null")
    names = F.transform(F.coalesce("p.entities", F.array().cast("array<struct<name:string,type:string>>")), lambda e: e["name"])
    rows = parsed.select(id_col, "p", F.explode(F.array(names)).alias("names"))
    first = F.filter("p.entities", lambda e, i: F.array_position("names", e["name"]) == i + 1)
    known = F.filter("p.relations", lambda x: F.array_contains("names", x["entity1"]) & F.array_contains("names", x["entity2"]))
    entities = rows.select(id_col, F.explode(first).alias("e")).select(id_col, "e.name", "e.type")
    relations = rows.select(id_col, F.explode(known).alias("x")).select(id_col, "x.entity1", "x.entity2", "x.description", "x.confidence", F.coalesce("x.stmt_type", F.lit("Fact")).alias("stmt_type"))
    return entities, relations


def merged_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes (id, type, name, confidence, source_name, valid_to, props) after an upsert; new nodes of unknown types are refused.

    The name is the new one, the confidence the greater, source and end keep the first value that isn't null, and
    properties are merged, new values first.  One union and one aggregation; both sides have a node once.
    """
    allowed = new.filter(F.col("type").isin(*NODE_TYPES))
    both = old.withColumn("o", F.lit(0)).unionByName(allowed.withColumn("o", F.lit(1)))
    earliest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("o"))).alias(c)
    pairs = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o", F.map_entries(F.coalesce("props", F.create_map().cast("map<string,string>"))).alias("e")))), lambda x: F.transform(x["e"], lambda e: F.struct(x["o"].alias("o"), e["key"].alias("key"), e["value"].alias("value")))))
    out = both.groupBy("id").agg(F.max_by("type", "o").alias("type"), F.max_by("name", "o").alias("name"), F.max("confidence").alias("confidence"), earliest("source_name"), earliest("valid_to"), pairs.alias("p"), F.max("o").alias("seen"))
    kept = F.filter("p", lambda e: ~F.exists("p", lambda x: (x["key"] == e["key"]) & (x["o"] > e["o"])))
    return out.select("id", "type", "name", "confidence", "source_name", "valid_to", F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"]))).alias("props"))


def move_ledger(moves: DataFrame, company: str, seen: str) -> DataFrame:
    """(company, from_stage, to_stage, direction, evidence, confidence, first_seen, last_seen): each move of a company once, as first told."""
    first = lambda c: F.min_by(c, F.struct(seen, "doc_id", "at")).alias(c)
    return moves.groupBy(company, "from_stage", "to_stage").agg(first("direction"), first("evidence"), first("confidence"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))


def chain_paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(nodes, weights): every directed path of 1 to ``depth`` edges from ``starts`` (id) that walks no edge twice.

    Their number may grow with each hop, which is the operator's answer; each hop is one join on the path's end.
    """
    step = cut(edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("weight").alias("_w")))
    paths = starts.select(F.col("id").alias("end"), F.array("id").alias("nodes"), F.array().cast("array<double>").alias("weights"))
    out = None
    for _ in range(depth):
        used = F.exists(F.sequence(F.lit(1), F.size("nodes")), lambda i: (F.get("nodes", i - 1) == F.col("_src")) & F.coalesce(F.get("nodes", i) == F.col("_dst"), F.lit(False)))
        paths = paths.join(step, F.col("end") == F.col("_src")).filter(~used)
        paths = cut(paths.select(F.col("_dst").alias("end"), F.concat("nodes", F.array("_dst")).alias("nodes"), F.concat("weights", F.array("_w")).alias("weights")))
        out = paths if out is None else out.unionByName(paths)
        if not paths.limit(1).count():
            break
    return out.select("nodes", "weights")


def path_edge_scores(paths: DataFrame) -> DataFrame:
    """(a, b, score): for each undirected edge of paths (sim, nodes), the sum of sim / (2 + its place in the path)."""
    each = paths.filter(F.size("nodes") > 1).select("sim", "nodes", F.posexplode(F.slice("nodes", F.lit(1), F.size("nodes") - 1)).alias("i", "from"))
    to = F.get("nodes", F.col("i") + 1)
    each = each.select(F.least("from", to).alias("a"), F.greatest("from", to).alias("b"), (F.col("sim") / (F.col("i") + 2)).alias("s"))
    return each.groupBy("a", "b").agg(F.sum("s").alias("score"))


def path_view(paths: DataFrame) -> DataFrame:
    """Paths (subject, nodes, rels, weights) as (subject, nodes, edges, hops), edges being (src, rel, tgt, weight)."""
    edges = F.transform(F.arrays_zip(F.slice("nodes", F.lit(1), F.size("rels")).alias("src"), F.col("rels").alias("rel"), F.slice("nodes", F.lit(2), F.size("rels")).alias("tgt"), F.col("weights").alias("weight")), lambda e: F.struct(e["src"].alias("src"), F.coalesce(e["rel"], F.lit("RELATES")).alias("rel"), e["tgt"].alias("tgt"), F.coalesce(e["weight"], F.lit(1.0)).alias("weight")))
    return paths.select("subject", "nodes", edges.alias("edges"), F.size("rels").alias("hops"))


def neighbours(edges: DataFrame, rels: list[str] | None, least: float, top: int) -> DataFrame:
    """(src, dst, rel, weight, place): each node's ``top`` heaviest neighbours over edges of the wanted relations and weight."""
    e = edges.filter(F.col("weight") >= least)
    e = e if rels is None else e.filter(F.col("rel").isin(*rels))
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst", "rel"))
    return e.select("src", "dst", "rel", "weight", place.alias("place")).filter(F.col("place") <= top)


def co_occurrences(mentions: DataFrame, tasks: int | None = None, order: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(src, dst, kind, weight, docs): companies of one document with each other (0.6) and with its products (0.7).

    ``mentions``: doc, company, product, either null; a name that a document repeats counts once.  A document's names are gathered
    once and paired where they are, so no document meets itself in a join; ``order`` puts the companies of a pair in order.
    """
    dealt = mentions.repartition(*([tasks] if tasks else []), "doc").filter(F.col("doc").isNotNull())
    each = dealt.groupBy("doc").agg(F.collect_set("company").alias("companies"), F.collect_set("product").alias("products"))
    each = each.select("companies", "products", F.explode("companies").alias("src"))
    peers = F.transform(F.filter("companies", lambda c: order(c) > order(F.col("src"))), lambda c: F.struct(c.alias("dst"), F.lit("peer").alias("kind")))
    makes = F.transform("products", lambda p: F.struct(p.alias("dst"), F.lit("product").alias("kind")))
    pairs = each.select("src", F.explode(F.concat(peers, makes)).alias("x")).select("src", "x.dst", "x.kind")
    counted = pairs.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("docs"))
    return counted.select("src", "dst", "kind", F.when(F.col("kind") == "peer", 0.6).otherwise(0.7).alias("weight"), "docs")


def point_text(collection: str, cut_at: int = 7000) -> Column:
    """The text whose vector stands for a row of a collection: entities, relations, chunks or evidence."""
    if collection == "entities":
        return F.trim(F.concat_ws(" ", "name", F.nullif("description", F.lit(""))))
    if collection == "relations":
        return F.concat(F.col("src"), F.lit(" 与 "), F.col("dst"), F.lit("："), F.coalesce("description", F.lit("")))
    if collection == "chunks":
        return F.concat_ws("\n", F.nullif("heading", F.lit("")), "content")
    return F.substring("content", 1, cut_at)


def statement_conflicts(statements: DataFrame, newest: int = 20) -> DataFrame:
    """(src, dst, rel, source, valid_from, other_source, kind): for each statement of a pair the newest other one that it contradicts.

    ``statements`` also has polarity: positive against negative is a polarity_conflict, and one that says both is a
    mixed_content_conflict with another source's.  Neutral ones contradict nothing, nor does a statement itself; only a
    pair's ``newest`` statements are looked back at.
    """
    pair = ["src", "dst", "rel"]
    recent = Window.partitionBy(*pair).orderBy(F.desc("valid_from"), F.desc("source"))
    back = statements.withColumn("place", F.row_number().over(recent)).filter(F.col("place") <= newest)
    back = back.select(*pair, F.col("source").alias("other_source"), F.col("valid_from").alias("other_from"), F.col("polarity").alias("other"), "place")
    both = statements.filter("polarity <> 'neutral'").join(back.filter("other <> 'neutral'"), pair).filter("not (valid_from = other_from and source = other_source)")
    opposed = (F.col("polarity") == "positive") & (F.col("other") == "negative") | (F.col("polarity") == "negative") & (F.col("other") == "positive")
    mixed = ((F.col("polarity") == "conflict") | (F.col("other") == "conflict")) & (F.col("source") != F.col("other_source"))
    both = both.withColumn("kind", F.when(opposed, "polarity_conflict").when(mixed, "mixed_content_conflict")).filter("kind is not null")
    return both.groupBy(*pair, "source", "valid_from").agg(F.min_by(F.struct("other_source", "kind"), "place").alias("x")).select(*pair, "source", "valid_from", "x.other_source", "x.kind")


def applied_merges(edges: DataFrame, pairs: DataFrame, listed: str, ranks: dict[str, int]) -> DataFrame:
    """Edges (src, dst, rel, weight, texts, stmt_type, valid_from) after confirmed merges (a, b) of nodes.

    Of a class of merged nodes the smallest id that begins with ``listed`` stays, else the smallest.  Both ends move to
    it; edges between merged nodes go; edges that fall together keep the greatest weight, all texts once, the strongest
    statement type and the earliest begin.
    """
    classes = connected(pairs)
    best = classes.groupBy("root").agg(F.min(F.struct((~F.col("id").startswith(listed)).alias("unlisted"), "id")).alias("k")).select("root", F.col("k.id").alias("kept"))
    best = cut(classes.join(best, "root").select("id", "kept"))
    moved = edges
    for end in ("src", "dst"):
        moved = moved.join(best.select(F.col("id").alias(end), F.col("kept").alias("_kept")), end, "left").withColumn(end, F.coalesce("_kept", end)).drop("_kept")
    strongest = F.max_by("stmt_type", F.coalesce(*[F.when(F.col("stmt_type") == k, F.lit(v)) for k, v in ranks.items()], F.lit(0)))
    out = moved.filter("src <> dst").groupBy("src", "dst", "rel").agg(F.max("weight").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("texts")))).alias("texts"), strongest.alias("stmt_type"), F.min("valid_from").alias("valid_from"))
    return out.select("src", "dst", "rel", "weight", "texts", "stmt_type", "valid_from")


def product_profiles(edges: DataFrame, companies: int = 30, others: int = 20) -> DataFrame:
    """(product, companies, related): each product's heaviest suppliers and heaviest other neighbours, in that order.

    The numbers of both are the operator's parameters; lists of bounded size are what a summary is written from.
    """
    e = edges.select("src", "dst", "weight")
    near = e.filter("dst like 'P:%'").select(F.col("dst").alias("product"), F.col("src").alias("id"), "weight").unionByName(e.filter("src like 'P:%'").select(F.col("src").alias("product"), F.col("dst").alias("id"), "weight"))
    near = near.groupBy("product", "id").agg(F.max("weight").alias("weight")).withColumn("company", F.col("id").startswith("C:"))
    place = F.row_number().over(Window.partitionBy("product", "company").orderBy(F.desc("weight"), "id"))
    near = near.withColumn("place", place).filter(F.col("place") <= F.when(F.col("company"), companies).otherwise(others))
    names = lambda wanted: F.transform(F.array_sort(F.collect_list(F.when(wanted, F.struct("place", "id")))), lambda x: x["id"])
    return near.groupBy("product").agg(names(F.col("company")).alias("companies"), names(~F.col("company")).alias("related"))
