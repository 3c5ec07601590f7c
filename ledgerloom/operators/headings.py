"""Chapters by headings of several styles, and small chapters put together.

Detection looks at a paragraph and the one before it only, so it runs inside a row; the fold that groups small chapters
runs over a document's token counts, not its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Styles of headings (Markdown, Chinese ordinals, Arabic numbers), and what can't be one.
MARKDOWN = r"^(#{1,6})\s+(.{2,60})"
ORDINAL = r"^([一二三四五六七八九十百零]+)\s*([章节条、\.])\s*([^\n，。、；：]*?)[\s　]*$"
NUMBER = r"^(\d+(?:\.\d+)*)\s*[\.、]\s*([^\n，。、；：]+)[\s　]*$"
LONGEST_NUMBERED, TABLE_LENGTH, TABLE_SHARE = 30, 20, 0.3
#: A paragraph that goes on where the one before was cut: no longer than this, not begun like a heading, and the one
#: before doesn't end in punctuation.
GOES_ON, HEADLIKE, ENDED = 100, r"^[第#一二三四五六七八九十\d]", r"[。！？，；]"
#: Chapters below this many tokens are small; a group of small ones is closed at the second number.
SMALL, GROUPED = 200, 2000

_HEAD, _FIELD, _JOIN, _BREAK = "\x01", "\x02", "\x03", "\x04"


def is_table_line(line: Column) -> Column:
    return F.contains(line, F.lit("|")) | ((F.length(line) > TABLE_LENGTH) & (F.regexp_count(line, F.lit(r"[\d%,]")) > F.length(line) * TABLE_SHARE))


def heading(line: Column) -> Column:
    """struct<title, level> of a line that is a heading, else null."""
    line = F.trim(line)

    def found(title: Column, level: Column) -> Column:
        return F.struct(title.alias("title"), level.cast("int").alias("level"))

    group = lambda pattern, k: F.regexp_extract(line, pattern, k)
    ordinal = F.trim(group(ORDINAL, 3))
    ordinal = F.when(ordinal == "", F.concat(F.lit("第"), group(ORDINAL, 1), group(ORDINAL, 2))).otherwise(ordinal)
    number = F.trim(group(NUMBER, 2))
    depth = F.length(group(NUMBER, 1)) - F.length(F.replace(group(NUMBER, 1), F.lit("."))) + 1
    out = F.when((F.length(line) < 2) | is_table_line(line), F.lit(None))
    out = out.when(line.rlike(MARKDOWN), found(F.trim(group(MARKDOWN, 2)), F.length(group(MARKDOWN, 1))))
    out = out.when(line.rlike(ORDINAL), found(ordinal, F.when(group(ORDINAL, 2) == "节", 2).otherwise(1)))
    return out.when(line.rlike(NUMBER) & (number != "") & (F.length(number) <= LONGEST_NUMBERED), found(number, depth))


def tokens(text: Column) -> Column:
    """The estimate of tokens: 1.5 for a Chinese character, a quarter for any other."""
    chinese = F.regexp_count(text, F.lit("[一-鿿]"))
    return (chinese * 1.5 + (F.length(text) - chinese) * 0.25).cast("int")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def paragraphs(text: Column) -> Column:
    """Runs of lines that aren't blank."""
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^[ \t\r\x0B\f　]+$", "")
    return F.filter(F.transform(F.split(blank, "\n{2,}"), lambda p: F.regexp_replace(p, "^\n+|\n+$", "")), lambda p: F.trim(p) != "")


def headed_chapters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "body") -> DataFrame:
    """(id, chapter, heading, level, body, tokens): chapters in order, from 0; text before the first heading has none.

    A heading without any body gives no chapter; a text of which no chapter is left is one chapter of level 0; a null or
    blank text has none.
    """
    parts = paragraphs(F.col(text_col))

    def piece(p: Column, k: Column) -> Column:
        first = F.substring_index(p, "\n", 1)
        head = heading(first)
        rest = F.when(F.contains(p, F.lit("\n")), F.substring(p, F.length(first) + 2, F.length(p))).otherwise("")
        before = F.when(k == 0, F.lit("")).otherwise(F.get(parts_of, k - 1))
        # what the paragraph before leaves: its own text, or what follows its heading
        before = F.when(heading(F.substring_index(before, "\n", 1)).isNull(), before).when(F.contains(before, F.lit("\n")), before).otherwise("")
        goes_on = (F.length(p) <= GOES_ON) & ~F.substring(F.trim(before), -3, 3).rlike(ENDED) & ~F.trim(first).rlike(HEADLIKE)
        begun = F.concat(F.lit(_HEAD), head["level"].cast("string"), F.lit(_FIELD), head["title"], F.lit(_FIELD), rest)
        return F.when(head.isNotNull(), begun).when(goes_on, F.concat(F.lit(_JOIN), p)).otherwise(F.concat(F.lit(_BREAK), p))

    # the paragraphs are a column of their own, so that looking back doesn't split the text again
    rows = docs.select(id_col, text_col, F.explode(F.array(parts)).alias("_parts")).filter(F.size("_parts") > 0)
    parts_of = F.col("_parts")
    rows = rows.select(id_col, text_col, F.explode(F.array(F.array_join(F.transform("_parts", piece), ""))).alias("_marked"))

    def chapter(part: Column, k: Column) -> Column:
        fields = F.split(part, _FIELD)
        # only under a heading does a cut paragraph go on in the same paragraph
        headed, plain = F.replace(F.get(fields, F.lit(2)), F.lit(_JOIN), F.lit("\n")), F.replace(part, F.lit(_JOIN), F.lit("\n\n"))
        body = _stripped(F.replace(F.when(k > 0, headed).otherwise(plain), F.lit(_BREAK), F.lit("\n\n")))
        return F.struct(F.when(k > 0, F.get(fields, F.lit(1))).otherwise("").alias("heading"), F.when(k > 0, F.get(fields, F.lit(0)).cast("int")).otherwise(1).alias("level"), body.alias("body"))

    found = F.filter(F.transform(F.split("_marked", _HEAD), chapter), lambda c: c["body"] != "")
    whole = F.array(F.struct(F.lit("").alias("heading"), F.lit(0).alias("level"), _stripped(F.col(text_col)).alias("body")))
    each = rows.select(id_col, text_col, F.explode(F.array(found)).alias("c")).select(id_col, F.posexplode(F.when(F.size("c") > 0, F.col("c")).otherwise(whole)).alias("chapter", "c"))
    return each.select(id_col, "chapter", "c.heading", "c.level", "c.body", tokens(F.concat("c.heading", F.lit("\n"), "c.body")).alias("tokens"))


def grouped_chapters(chapters: DataFrame, id_col: str = "doc_id", small: int = SMALL, target: int = GROUPED) -> DataFrame:
    """(id, chapter, heading, level, body, parts): runs of small chapters as one, closed when they reach ``target`` tokens.

    A group has its first heading and its least level; a chapter that isn't small stays as it is.
    """
    start = F.struct(F.lit(-1).alias("group"), F.lit(0).alias("held"), F.lit(False).alias("open"), F.array().cast("array<int>").alias("groups"))

    def step(a: Column, n: Column) -> Column:
        is_small = n < small
        group = F.when(is_small & a["open"], a["group"]).otherwise(a["group"] + 1)
        held = F.when(is_small, F.when(a["open"], a["held"]).otherwise(0) + n).otherwise(0)
        return F.struct(group.alias("group"), held.alias("held"), (is_small & (held < target)).alias("open"), F.concat(a["groups"], F.array(group)).alias("groups"))

    order = F.array_sort(F.collect_list(F.struct("chapter", "tokens")))
    groups = chapters.groupBy(id_col).agg(order.alias("o")).select(id_col, "o", F.explode(F.array(F.aggregate(F.transform("o", lambda x: x["tokens"]), start, step, lambda a: a["groups"]))).alias("g"))
    groups = groups.select(id_col, F.explode(F.arrays_zip("o", "g")).alias("x")).select(id_col, F.col("x.o.chapter").alias("chapter"), F.col("x.g").alias("group"))
    both = chapters.join(groups, [id_col, "chapter"]).groupBy(id_col, "group").agg(F.array_sort(F.collect_list(F.struct("chapter", "heading", "level", "body"))).alias("c"))
    bodies = F.array_join(F.transform("c", lambda x: x["body"]), "\n\n")
    return both.select(id_col, F.col("group").alias("chapter"), F.col("c")[0]["heading"].alias("heading"), F.array_min(F.transform("c", lambda x: x["level"])).alias("level"), bodies.alias("body"), F.size("c").alias("parts"))
