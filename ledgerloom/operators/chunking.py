"""Texts into bounded chunks: an oversize split of three levels, and token windows that overlap from heading to heading.

Both are folds over a row's own pieces, inside the JVM and without a shuffle.  Sizes are added up in quarter tokens
(``units``), so that pieces put together measure exactly what their text does; a fold holds numbers, and texts are joined once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ends of sentences for the oversize split and for windows, paragraphs of windows, and headings.
SENTENCE = r"(?s).+?(?:[。！？；\n]+|\z)"
WINDOW_SENTENCE, WINDOW_PARAGRAPH = r"(?<=[。！？!?.])\s*", r"\n{2,}"
HEADING_LINE = r"(?m)^(?=[^\S\n]*#{1,6}[^\S\n]+\S)"
#: A paragraph with the blank lines that end it.
PARAGRAPH = r"(?s).+?(?:\n[ \t]*\n\s*|\z)"
#: Tokens of a chunk and of a window.
MOST_CHUNK, MOST_WINDOW = 6000, 1024

_MARK = "\x01"
JOINS, FRESH, ALONE = 0, 1, 2


def units(text: Column) -> Column:
    """Quarter tokens: six for a Chinese character, one for any other."""
    chinese = F.regexp_count(text, F.lit("[一-鿿]"))
    return chinese * 5 + F.length(text)


def _most(limit: int) -> int:
    """The most units whose tokens, rounded down, are ``limit``."""
    return 4 * limit + 3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _piece(text: Column, flag: Column | int) -> Column:
    return F.struct(text.alias("text"), units(text).alias("units"), (F.lit(flag) if isinstance(flag, int) else flag).alias("flag"))


def _slices(text: Column, limit: int) -> Column:
    """The text in slices that are within the limit whatever their characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{max(1, _most(limit) // 6)}}}"), F.lit(0))


def packed(pieces: Column, limit: int, joiner: str = "") -> Column:
    """array<string>: pieces (text, units, flag) put together in order while they fit the limit with what joins them.

    A FRESH piece begins a chunk, an ALONE piece is one.
    """
    run = "struct<first:int,n:int>"
    start = F.struct(F.array().cast(f"array<{run}>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("units"), F.lit(False).alias("shut"))

    def step(a: Column, x: Column) -> Column:
        total = a["units"] + len(joiner) + x["units"]
        joins = (a["n"] > 0) & ~a["shut"] & (x["flag"] == JOINS) & (total <= _most(limit))
        done = F.when(joins | (a["n"] == 0), a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), a["n"].alias("n")))))
        return F.struct(
            done.alias("done"),
            F.when(joins, a["first"]).otherwise(a["first"] + a["n"]).alias("first"),
            F.when(joins, a["n"] + 1).otherwise(1).alias("n"),
            F.when(joins, total).otherwise(x["units"]).cast("long").alias("units"),
            (x["flag"] == ALONE).alias("shut"),
        )

    def runs(p: Column) -> Column:
        finish = lambda a: F.when(a["n"] == 0, a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), a["n"].alias("n")))))
        texts = F.transform(p, lambda x: x["text"])
        of = F.aggregate(F.transform(p, lambda x: F.struct(x["units"].alias("units"), x["flag"].alias("flag"))), start, step, finish)
        return _let(texts, lambda t: F.transform(of, lambda r: F.array_join(F.slice(t, r["first"] + 1, r["n"]), joiner)))

    return _let(pieces, runs)


def oversize_chunks(chapters: DataFrame, limit: int = MOST_CHUNK, keys: tuple[str, ...] = ("doc_id", "chapter"), text_col: str = "body") -> DataFrame:
    """(keys, idx, chunk, tokens): each text in chunks of at most ``limit`` tokens, which joined give the text back.

    Whole paragraphs are put together while they fit.  Only a paragraph above the limit goes down to sentences (and begins
    a chunk), and only a sentence above it is cut between characters.  A text within the limit is one chunk; null and empty
    texts have none.
    """
    extract = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    fits = lambda text: units(text) <= _most(limit)

    def sentences(p: Column) -> Column:
        each = F.flatten(F.transform(extract(p, SENTENCE), lambda s: F.when(fits(s), F.array(s)).otherwise(_slices(s, limit))))
        return F.transform(each, lambda s, i: _piece(s, F.when(i == 0, FRESH).otherwise(JOINS)))

    pieces = F.flatten(F.transform(extract(F.col(text_col), PARAGRAPH), lambda p: F.when(fits(p), F.array(_piece(p, JOINS))).otherwise(sentences(p))))
    chunks = F.when(fits(F.col(text_col)), F.array(text_col)).otherwise(packed(pieces, limit))
    rows = chapters.filter(F.length(text_col) > 0).select(*keys, F.posexplode(chunks).alias("idx", "chunk"))
    return rows.select("*", F.floor(units(F.col("chunk")) / 4).cast("int").alias("tokens"))


def tail(text: Column, tokens: int) -> Column:
    """The longest end of a text of at most that many tokens."""
    most = _most(tokens)
    last = F.reverse(F.split(F.right(text, F.lit(most)), ""))
    start = F.struct(F.lit(0).alias("units"), F.lit(0).alias("n"))

    def step(a: Column, c: Column) -> Column:
        total = a["units"] + units(c)
        # once a character doesn't fit, none before it does
        return F.when(total <= most, F.struct(total.alias("units"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(most).alias("units"), a["n"].alias("n")))

    return F.right(text, F.aggregate(F.filter(last, lambda c: c != ""), start, step, lambda a: a["n"]))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), _trim), lambda s: s != "")


def _windows_of(text: Column, limit: int) -> Column:
    """array<string>: one block as windows, by paragraphs, then sentences, then a cut between characters."""

    def long_section(section: Column) -> Column:
        sentences = F.transform(_parts(section, WINDOW_SENTENCE), lambda s: _piece(s, JOINS))
        cut = lambda w: F.when(units(w) <= _most(limit), F.array(w)).otherwise(packed(F.transform(_slices(w, limit), lambda s: _piece(s, JOINS)), limit))
        return F.transform(F.flatten(F.transform(packed(sentences, limit, " "), cut)), lambda w: _piece(w, ALONE))

    sections = F.flatten(F.transform(_parts(text, WINDOW_PARAGRAPH), lambda s: F.when(units(s) <= _most(limit), F.array(_piece(s, JOINS))).otherwise(long_section(s))))
    return F.when(units(text) <= _most(limit), F.array(text)).otherwise(packed(sections, limit, "\n\n"))


def token_windows(docs: DataFrame, limit: int = MOST_WINDOW, overlap: int = 0, percent: float | None = None, id_col: str = "doc_id", text_col: str = "body") -> DataFrame:
    """(id, idx, heading, chunk, tokens): windows of at most ``limit`` tokens that no Markdown heading lies inside of.

    A block begins at each heading line (or at the start, without a heading).  The block after another begins with the
    end of its last window, of ``overlap`` tokens (or ``percent`` of the limit, 0 to 50).  A block above the limit is
    split by paragraphs; a paragraph above it by sentences, joined by spaces while they fit; a sentence above it between
    characters.  Null and blank texts have no windows; a text without headings is one block.
    """
    if percent is not None:
        if not 0 <= percent <= 50:
            raise ValueError("percent must be between 0 and 50")
        overlap = int(limit * percent / 100)
    blocks = F.when(F.col(text_col).rlike(r"(?m)^#{1,6}\s+.+$"), F.split(F.regexp_replace(text_col, HEADING_LINE, _MARK), _MARK)).otherwise(F.array(text_col))
    blocks = F.filter(F.transform(blocks, _trim), lambda b: b != "")
    start = F.struct(F.array().cast("array<struct<heading:string,chunk:string>>").alias("done"), F.lit("").alias("tail"))

    def step(a: Column, block: Column) -> Column:
        text = F.when(a["tail"] != "", F.concat(a["tail"], F.lit("\n\n"), block)).otherwise(block) if overlap > 0 else block
        heading = _trim(F.regexp_extract(block, r"\A#{1,6}[^\S\n]+(.+)", 1))
        named = lambda ws: F.transform(ws, lambda w: F.struct(heading.alias("heading"), w.alias("chunk")))
        end = (lambda ws: tail(F.element_at(ws, -1), overlap)) if overlap > 0 else lambda ws: F.lit("")
        return _let(_windows_of(text, limit), lambda ws: F.struct(F.concat(a["done"], named(ws)).alias("done"), end(ws).alias("tail")))

    # the blocks are a column of their own, so that the fold doesn't split the text again
    rows = docs.select(id_col, F.explode(F.array(blocks)).alias("_blocks"))
    rows = rows.select(id_col, F.posexplode(F.aggregate("_blocks", start, step, lambda a: a["done"])).alias("idx", "w"))
    return rows.select(id_col, "idx", "w.heading", "w.chunk", F.floor(units(F.col("w.chunk")) / 4).cast("int").alias("tokens"))
