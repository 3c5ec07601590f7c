"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling, in DataFrame operations only.

Every line has an ID by its content, and a document is the sequence of its line IDs.  Round k of prefix doubling sorts
the suffixes by their first 2**k lines: the pairs of ranks of their halves are grouped and sorted by range, and an
interval's place in that order is the new rank, so ranks grow as suffixes do.  An interval of one suffix is left out
from then on, since no longer prefix of it repeats; the others are the intervals whose longest common prefix is 2**k
lines or more, kept with their first suffix and their size.  A prefix of any other length is the meet of two intervals,
those of its first and of its last 2**k lines.

A run of enough words that repeats lies in such intervals wherever it stands, so it is covered by the least runs of
enough words that begin or end at each of its lines, and these are looked up: of each interval the first copy (by
document id, then line) stays.  What the later copies cover is merged into maximal runs, and their lines are deleted.

Every join is between written tables on exchanged keys, so adaptive execution can split a line that a third of all
documents hold; every grouping is an aggregation with map-side combine, and windows run over one document's lines, in
time linear in them but for the sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, bitmaps, in_bitmaps

#: Bits for a line's number at least, where rows and lines share one 64-bit position; longer texts get more.
LINE_BITS = 21


def _plain(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _with_rows(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``docs`` with the columns _row (orders rows as their ids do, unique) and _id, _text, and the bits for a line.

    The bits hold twice the lines of the longest text.  Unique, non-negative ids that fit beside them are their own row
    numbers; otherwise rows are numbered in the order of id and text, rows that repeat both being one row for the search
    (its copies get the same result).
    """
    rows = docs.select("*", F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    feeds = F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit("")))
    ids = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("c"), F.max(feeds + 1).alias("lines"))
    seen = ids.agg(F.max("lines").alias("lines"), F.max("c").alias("c"), F.min("_id").alias("low"), F.max("_id").alias("high"), F.count_if(F.col("_id").isNull()).alias("nulls")).first()
    bits = max(LINE_BITS, (2 * (seen.lines or 0)).bit_length())
    if seen.c is None or (seen.c == 1 and not seen.nulls and seen.low >= 0 and seen.high < 1 << (62 - bits)):
        return rows.withColumn("_row", F.col("_id")), bits
    keyed = rows.withColumn("_sha", F.sha2("_text", 256))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = keyed.select("_id", "_sha").distinct().repartitionByRange(parts, "_id", "_sha").sortWithinPartitions("_id", "_sha")
    order = scratch.cut(order.withColumn("_at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("_at", 33)
    sizes = order.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))  # a row for each partition
    starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))
    order = order.withColumn("part", part).join(F.broadcast(starts), "part")
    order = scratch.cut(order.select("_id", "_sha", (F.col("start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("_row")), "rows")
    order = order.withColumnRenamed("_id", "_id2").withColumnRenamed("_sha", "_sha2")
    numbered = keyed.join(order, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_sha") == F.col("_sha2")))
    return scratch.cut(numbered.drop("_id2", "_sha2", "_sha"), "numbered"), bits


def _intervals(at: DataFrame, names: list[str], scratch: Scratch, name: str) -> DataFrame:
    """(place, first, size): the intervals of two or more suffixes that share ``names``, with those names.

    Distinct names are sorted over the cluster, and an interval's place is that in the order (growing, not gapless).
    """
    found = at.groupBy(*names).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    found = found.repartitionByRange(*names).sortWithinPartitions(*names)
    return scratch.cut(found.withColumn("place", F.monotonically_increasing_id()), f"{name}-intervals")


def _ranked(at: DataFrame, names: list[str], scratch: Scratch, name: str) -> DataFrame:
    """(pos, rank): the suffixes of intervals of two or more."""
    return scratch.cut(at.join(_intervals(at, names, scratch, name).select(*names, "place"), names).select("pos", F.col("place").alias("rank")), name)


def least_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(pos, length): the least runs of ``min_words`` words that begin, and that end, at each boundary of (_row, pos, words).

    Boundaries and what asks for them are sorted together by the words before them, so one running minimum (maximum)
    finds each end (begin).
    """
    by_row = Window.partitionBy("_row").orderBy("pos")
    before = lines.select("_row", "pos", "words", (F.sum("words").over(by_row) - F.col("words")).alias("before"), F.lead("pos").over(by_row).isNull().alias("last"))
    one = F.struct("pos", "before")
    after = F.struct((F.col("pos") + 1).alias("pos"), (F.col("before") + F.col("words")).alias("before"))
    edges = before.select("_row", F.explode(F.when(F.col("last"), F.array(one, after)).otherwise(F.array(one))).alias("x")).select("_row", "x.*")
    asked = F.array(*[F.struct(F.lit(kind).alias("kind"), (F.col("before") + shift).alias("at")) for kind, shift in ((0, 0), (1, min_words), (2, -min_words))])
    asked = edges.select("_row", "pos", F.explode(asked).alias("x")).select("_row", "pos", "x.*")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    edge = F.when(F.col("kind") == 0, F.col("pos"))
    stop = F.min(edge).over(Window.partitionBy("_row").orderBy(F.desc("at"), "kind").rowsBetween(*so_far))
    start = F.max(edge).over(Window.partitionBy("_row").orderBy("at", "kind").rowsBetween(*so_far))
    runs = asked.select("pos", "kind", stop.alias("stop"), start.alias("start"))
    runs = runs.select(F.when(F.col("kind") == 1, F.struct("pos", "stop")).when(F.col("kind") == 2, F.struct(F.col("start").alias("pos"), F.col("pos").alias("stop"))).alias("x"))
    return runs.filter("x.pos is not null and x.stop is not null").select("x.pos", (F.col("x.stop") - F.col("x.pos")).alias("length")).distinct()


def maximal_runs(runs: DataFrame) -> DataFrame:
    """(_row, gone): the runs (_row, first, last) that touch or overlap as one, in order, disjoint."""
    order = Window.partitionBy("_row").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = runs.withColumn("new", F.coalesce(F.col("first") > reach + 1, F.lit(True)).cast("int"))
    parts = parts.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = parts.groupBy("_row", "part").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return parts.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("gone"))


def deleted_lines(rows: DataFrame, scratch: Scratch, min_words: int, bits: int) -> DataFrame:
    """(_row, gone): for rows of which lines go, the maximal runs to delete, as an array of (first, last) line numbers."""
    words = F.regexp_count("line", F.lit(r"[^ \t\n\x0B\f\r]+"))
    one = rows.select("_row", "_text").dropDuplicates(["_row"]) if "numbered" in scratch.paths else rows.select("_row", "_text")
    lines = one.select("_row", F.posexplode(F.split("_text", "\n")).alias("i", "line"))
    position = F.shiftleft("_row", bits) + F.col("i")
    lines = lines.select(position.alias("pos"), F.unhex(F.md5("line")).alias("id"), words.alias("words"))
    lines = scratch.cut(lines, "lines")
    ranks = [_ranked(lines.select("pos", "id"), ["id"], scratch, "rank-0")]
    nothing = rows.sparkSession.createDataFrame([], "_row long, gone array<struct<first:long,last:long>>")
    if not ranks[0].limit(1).count():
        return nothing

    # only documents with a repeated line have runs
    touched = ranks[0].select(F.shiftright("pos", bits).alias("_row")).distinct()
    rowed = lines.withColumn("_row", F.shiftright("pos", bits)).join(touched, "_row").select("_row", "pos", "words")
    runs = least_runs(rowed, min_words)
    runs = scratch.cut(runs.select("pos", "length", F.floor(F.log2("length") + 1e-9).cast("int").alias("k")), "runs")
    scratch.drop("lines")
    longest = runs.agg(F.max("k")).first()[0]
    if longest is None:
        return nothing

    names = []
    for k in range(longest + 1):
        if k:  # double: a suffix's first 2**k lines are two halves of known rank
            half = 1 << (k - 1)
            second = ranks[-1].select((F.col("pos") - half).alias("pos"), F.col("rank").alias("second"))
            ranks.append(_ranked(ranks[-1].join(second, "pos"), ["rank", "second"], scratch, f"rank-{k}"))
        # runs of 2**k lines or more, below twice that: two intervals meet in them
        head = runs.filter(F.col("k") == k).join(ranks[-1], "pos").withColumn("tail", F.col("pos") + F.col("length") - (1 << k))
        tails = ranks[-1].select(F.col("pos").alias("tail"), F.col("rank").alias("second"))
        names.append(head.join(tails, "tail").select("pos", "length", "rank", "second"))
    named = names[0]
    for n in names[1:]:
        named = named.unionByName(n)
    named = scratch.cut(named, "named")
    for k in range(longest + 1):
        scratch.drop(f"rank-{k}-intervals")
        scratch.drop(f"rank-{k}")
    scratch.drop("runs")
    first = named.groupBy("length", "rank", "second").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    first = scratch.cut(first.select("length", "rank", "second", F.col("first").alias("least")), "first")
    later = named.join(first, ["length", "rank", "second"]).filter("pos > least")
    line = F.col("pos").bitwiseAND(F.lit((1 << bits) - 1))
    later = later.select(F.shiftright("pos", bits).alias("_row"), line.alias("first"), (line + F.col("length") - 1).alias("last"))
    gone = scratch.cut(maximal_runs(later), "gone")
    scratch.drop("named")
    scratch.drop("first")
    return gone


def line_run_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text`` less the lines of later copies of repeated runs, and n_lines, n_deleted.

    A line is deleted when it lies in a run of consecutive lines, of ``min_words`` words or more in all, that also
    begins at an earlier place: at a smaller id, or earlier in the same document.  Lines end at a line feed.  Null
    texts stay null and, like empty ones, have one empty line; rows that repeat id and text get the same result, each
    from the copies before them both; a null id comes first.  An empty table gives no rows.  Very long texts are split
    into lines once.  Other columns stay as they are, whatever their names; those named n_lines and n_deleted are replaced.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    given = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    rest = [c for c in given if c not in (id_col, text_col)]
    # other columns travel as one struct, so that no name of theirs meets one used here
    docs = docs.select(_plain(id_col).alias("doc_id"), _plain(text_col).alias("text"), *([F.struct(*map(_plain, rest)).alias("_rest")] if rest else []))
    rows, line_bits = _with_rows(docs, scratch)
    gone = deleted_lines(rows, scratch, min_words, line_bits)
    bits = scratch.cut(bitmaps(gone, F.xxhash64("_row")), "bits")
    # texts that lose nothing don't travel
    marked = in_bitmaps(rows, F.xxhash64("_row"), bits, "_hit")
    split = F.split("_text", "\n")
    # the lines become a column of their own (a projection would split the text anew for every run)
    hit = marked.filter("_hit").join(gone, "_row", "left").select("*", F.explode(F.array(split)).alias("_lines"))
    runs = F.coalesce("gone", F.array().cast("array<struct<first:long,last:long>>"))
    bounds = F.struct(F.lit(0).cast("long").alias("first"), F.lit(-1).cast("long").alias("last")), F.struct(F.size("_lines").cast("long").alias("first"), F.lit(0).cast("long").alias("last"))
    gaps = F.zip_with(F.concat(F.array(bounds[0]), runs), F.concat(runs, F.array(bounds[1])), lambda x, y: F.slice("_lines", (x["last"] + 2).cast("int"), (y["first"] - x["last"] - 1).cast("int")))
    hit = hit.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_deleted", F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1))
    hit = hit.withColumn("text", F.when(F.col("n_deleted") == 0, F.col("text")).otherwise(F.array_join(F.flatten(gaps), "\n")))
    same = marked.filter("not _hit").withColumn("n_lines", F.size(split).cast("long")).withColumn("n_deleted", F.lit(0).cast("long"))
    columns = [*docs.columns, "n_lines", "n_deleted"]
    own = {id_col: F.col("doc_id"), text_col: F.col("text")}
    out = hit.select(*columns).unionByName(same.select(*columns))
    return out.select(*[own[c].alias(c) if c in own else F.col("_rest")[c].alias(c) for c in given], "n_lines", "n_deleted")
