"""Readers that present the given tables as market bars, fundamentals, documents and so on.

Each function is a lazy projection or aggregation over one scan, so filters and column choices made later still reach
the Parquet files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a wide exchange that a task holds, about.
TASK_ROWS = 1_000_000


def tasks(df: DataFrame) -> int:
    """Tasks for an exchange of the rows of a scan: so many that what one holds doesn't grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by (code, trade_date): suppliers are instruments, order lines are trades."""
    trades = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("code"),
        F.to_date("l_shipdate").alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("seq"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("value"),
    )
    return trades.groupBy("code", "trade_date").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("qty").alias("volume"),
        F.round(F.sum("value"), 2).alias("amount"),
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios by (code, as_of): the last ship date of a month stands for the report date."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("code"), F.trunc(F.to_date("l_shipdate"), "month").alias("month")).agg(
        F.max(F.to_date("l_shipdate")).alias("as_of"), F.round(F.avg("l_discount") * 100, 4).alias("pe"), F.round(F.avg("l_tax") * 100, 4).alias("pb"), F.count(F.lit(1)).alias("reports")
    )


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instrument master: code, name, industry (nation) and area (region)."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    dims = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(F.broadcast(dims), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("n_name").alias("industry"), F.col("r_name").alias("area"), F.col("s_acctbal").alias("balance")
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge concept -> instrument: the brands that a supplier ships."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("concept"), F.col("l_suppkey").alias("code")).distinct()


def concept_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limit-up heat by (concept, trade_date): returned lines count as limit-ups."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_returnflag", "l_discount")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    heat = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return heat.groupBy(F.col("p_brand").alias("concept"), F.to_date("l_shipdate").alias("trade_date")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("ups"), F.round(F.avg("l_discount") * 100, 4).alias("pct")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task runs: a user is a task, an error event is a failed run, its value the record count."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("task"), F.col("event_type").alias("kind"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("ts").alias("started_at"), F.col("value").alias("records"), "props"
    )


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as announcements: the first line is the title."""
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1).alias("title"), F.coalesce("text", F.lit("")).alias("body"), "lang", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer pairs: a user's turn with the assistant's next one."""
    turns = table(spark, sf_dir, "conversations")
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(answers, ["conv_id", "turn"])


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of the SUPPLIES edges as numbers: supplier (src) and part (dst)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def _ordered(spark: SparkSession, sf_dir: str, lines: DataFrame, n: int) -> DataFrame:
    """Lines with their order's customer, joined by ``n`` tasks."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.repartition(n, "l_orderkey").join(orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def _share(qty: Column) -> Column:
    """The weight of an edge of this quantity."""
    return F.round(F.least(F.lit(1.0), qty / 100), 4)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal edges supplier -SUPPLIES-> part and part -USED_BY-> customer, weight by share of quantity.

    Grouped by the keys as numbers: ends become names when the groups are there.  Lines are dealt by source over as many tasks
    as the table needs and grouped where they arrive: nearly all pairs are different, so groups before the exchange
    would only hold the rows twice.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_linestatus")
    n = tasks(lines)
    # whether the greatest status is F, as a number: the greatest of strings would need a sort
    status = F.max(F.when(F.col("l_linestatus") == "F", 1).when(F.col("l_linestatus") > "F", 2))
    measures = F.sum("l_quantity").alias("qty"), F.min(F.to_date("l_shipdate")).alias("valid_from"), status.alias("status"), F.count(F.lit(1)).alias("n")
    supplies = lines.repartition(n, "l_suppkey").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(*measures)
    used = _ordered(spark, sf_dir, lines, n).repartition(n, "l_partkey").groupBy(F.col("l_partkey").alias("src"), F.col("o_custkey").alias("dst")).agg(*measures)
    named = [x.withColumns({"src": F.concat(F.lit(a), "src"), "dst": F.concat(F.lit(b), "dst"), "rel": F.lit(rel)}) for x, a, b, rel in ((supplies, "C:", "P:", "SUPPLIES"), (used, "P:", "U:", "USED_BY"))]
    return named[0].unionByName(named[1]).select("src", "dst", "rel", _share(F.col("qty")).alias("weight"), "valid_from", F.when(F.col("status") == 1, "Fact").otherwise("Estimate").alias("stmt_type"), "n")


def heaviest_edges(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(src, dst, weight): at most ``k`` of ``edges`` out of each node, the heaviest, then the smallest target.

    Ranked where each kind's lines are grouped by source, so no edge is exchanged and a task's memory doesn't grow with the table.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    n, place = tasks(lines), F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "dst"))
    supplies, used = lines.repartition(n, "l_suppkey"), _ordered(spark, sf_dir, lines, n).repartition(n, "l_partkey")
    kept = []
    for kind, a, src, b, dst in ((supplies, "C:", "l_suppkey", "P:", "l_partkey"), (used, "P:", "l_partkey", "U:", "o_custkey")):
        e = kind.groupBy(F.col(src).alias("key"), F.col(dst).alias("to")).agg(F.sum("l_quantity").alias("qty"))
        e = e.select("key", F.concat(F.lit(b), "to").alias("dst"), _share(F.col("qty")).alias("weight")).withColumn("place", place)
        kept.append(e.filter(F.col("place") <= k).select(F.concat(F.lit(a), "key").alias("src"), "dst", "weight"))
    return kept[0].unionByName(kept[1])


def part_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The edges into parts (part, of, first) and out of them (part, to, second) by numbers, with their weights, both dealt by part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    n, part = tasks(lines), F.col("l_partkey").alias("part")
    into = lines.repartition(n, "l_partkey").groupBy(part, F.col("l_suppkey").alias("of")).agg(F.sum("l_quantity").alias("qty"))
    out = _ordered(spark, sf_dir, lines, n).repartition(n, "l_partkey").groupBy(part, F.col("o_custkey").alias("to")).agg(F.sum("l_quantity").alias("qty"))
    return into.select("part", "of", _share(F.col("qty")).alias("first")), out.select("part", "to", _share(F.col("qty")).alias("second"))


def part_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The edges into parts (part, src, mid, first) and out of them (part, dst, second), with their weights, both dealt by part.

    Chains of two of ``edges`` are their join on part, and nothing else: suppliers have no edges in and customers none out.
    The names of the ends are made here, so a chain only copies them.
    """
    into, out = part_links(spark, sf_dir)
    into = into.select("part", F.concat(F.lit("C:"), "of").alias("src"), F.concat(F.lit("P:"), "part").alias("mid"), "first")
    return into, out.select("part", F.concat(F.lit("U:"), "to").alias("dst"), "second")
