"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is read as a sequence: words score above zero, tags below, by weights that labelled pages give.  A linear scan finds
the contiguous stretch with the highest sum.  Words inside an element that labelled pages show to hold no main text (menus,
adverts, comments...) score nothing and aren't returned, so a stretch may run over an advert without taking it along.
Pages are rows that never meet: no shuffle; the weights are small counts of the labelled pages alone.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ship_package
from ledgerloom.llm.labelled_pages import BEGIN, END, PAGES

#: Fixed values of HTML: elements that begin and end a block, that have no end tag, whose content is no markup, and that show no prose.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title".split())
SILENT = frozenset("audio button canvas datalist dialog head noscript object option select svg template video".split())
#: Fixed values of HTML: elements whose name tells what they hold, with no hint needed.
TELLING = frozenset("article aside footer form header main menu nav".split())
#: Fixed values of HTML: an element whose end tag may be left out -> what ends it.
ENDS_P = BLOCKS - {"body", "caption", "head", "html", "legend", "optgroup", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select", "datalist"}}

#: Least and greatest cost of a tag, least and greatest score of a word, and log-odds from which an element's words are taken for boilerplate (or for main text, below the negative).
COSTS, SCORES, SURE = (0.05, 6.0), (0.1, 3.0), 1.5

# a value in quotes may hold ">"; a quote that nothing closes ends nothing
_TAG = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?][^>]*+>?)|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z))")
_HINTS = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]{2,}")
_NOT_ITSELF = frozenset(("has", "no", "not", "with", "without"))
#: Pages whose tokens are kept between the scans; longer ones are cut into tokens again.
KEPT_CHARS = 1 << 20


def hints(attrs: str) -> tuple[str, ...]:
    """Lower-case parts of class, id and role names ("adSlot top" -> ad, slot, top); names such as no-sidebar say nothing."""
    found = []
    for m in _HINTS.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [p.lower() for p in _PARTS.findall(name)]
            found += parts if parts and parts[0] not in _NOT_ITSELF else []
    return tuple(dict.fromkeys(found))


def tokens(page: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """("text", characters, ()), ("open", name, hints) and ("close", name, ()) in page order; a page may break off anywhere."""
    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        start = m.start() if m else len(page)
        if start > at:
            yield "text", page[at:start], ()
        if not m:
            return
        at = m.end()
        if m["comment"]:
            # the shortest comments are "<!-->" and "<!--->"
            short = re.compile(r"-?>").match(page, at)
            end = page.find("-->", at)
            at = short.end() if short else end + 3 if end >= 0 else len(page)
        elif m["name"]:
            name = m["name"].lower()
            if m["end"]:
                yield "close", name, ()
                continue
            yield "open", name, hints(m["attrs"])
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(page, at)
                at = end.start() if end else len(page)
                if not end:
                    yield "close", name, ()


class Elements:
    """Open elements, with the ends that HTML lets authors leave out."""

    def __init__(self) -> None:
        self.open: list[tuple[str, object]] = []
        self.count: Counter = Counter()

    def _pop_to(self, names: set[str], scope: set[str]) -> Iterator[object]:
        """Close the innermost element of ``names`` and all in it, unless one of ``scope`` lies between."""
        if not any(self.count[n] for n in names):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in names:
                while len(self.open) > k:
                    name, mark = self.open.pop()
                    self.count[name] -= 1
                    yield mark
                return
            if self.open[k][0] in scope:
                return

    def push(self, name: str, mark: object) -> None:
        if name not in VOID:
            self.open.append((name, mark))
            self.count[name] += 1

    def before(self, name: str) -> Iterator[object]:
        """Marks of the elements that the start tag ``name`` ends."""
        if name == "body":
            yield from self._pop_to({"head"}, set())
        if name in ENDS_P:
            yield from self._pop_to({"p"}, BLOCKS - {"p"})
        if name in SIBLINGS:
            yield from self._pop_to(SIBLINGS[name], SCOPES[name])

    def end(self, name: str) -> Iterator[object]:
        yield from self._pop_to({name}, set() if name in BLOCKS else BLOCKS)


def _names(name: str, parts: tuple[str, ...], inside: bool) -> tuple[list[str], list[str]]:
    """Features of a tag: those of its hints, and its own name, each with whether it stands in an article first."""
    where = "+" if inside else "-"
    return [f".{p}{where}" for p in parts] + [f".{p}" for p in parts], [name + where, name]


class Weights:
    """Counts of labelled pages -> costs of tags, scores of words, and elements that hold main text or none."""

    def __init__(self, counts: dict[str, tuple[float, float]]):
        self.counts = counts

    def odds(self, kind: str, names: list[str]) -> float | None:
        """Log-odds of lying outside, of the feature that says most; None where none was ever seen."""
        known = [math.log((out + 0.5) / (in_ + 0.5)) for in_, out in (self.counts[f"{kind} {n}"] for n in names if f"{kind} {n}" in self.counts)]
        return max(known, key=abs) if known else None

    def _decide(self, kind: str, name: str, parts: tuple[str, ...], inside: bool) -> float:
        of_hints, own = _names(name, parts, inside)
        n = len(parts)
        # a hint or name that was seen in this place counts as that alone
        said = [self.odds(kind, [f]) if f"{kind} {f}" in self.counts else self.odds(kind, [g]) for f, g in zip(of_hints[:n], of_hints[n:])]
        said = [x for x in said if x is not None]
        if said:
            return max(said) if max(said) >= SURE else max(said, key=abs)
        if kind == "words" and name not in TELLING:
            return 0.0
        one = self.odds(kind, own[:1])
        return one if one is not None else self.odds(kind, own[1:]) or 0.0

    def cost(self, name: str, parts: tuple[str, ...], inside: bool) -> float:
        return min(COSTS[1], max(COSTS[0], self._decide("tag", name, parts, inside)))

    def within(self, name: str, parts: tuple[str, ...], inside: bool) -> float:
        """Below -SURE: the element's words are main text; above SURE: they aren't."""
        if name in ("html", "body") or name not in BLOCKS and not parts:
            return 0.0
        return self._decide("words", name, parts, inside)

    def word(self, linked: bool) -> float:
        x = self.odds("run", ["link" if linked else "plain"])
        return SCORES[0] if x is None else min(SCORES[1], max(SCORES[0], -x))


def _walk(read: Iterator, weights: Weights | None, forms: bool) -> Iterator[tuple]:
    """(token, inside, silent, linked, sure marks opened, sure marks closed) for each token."""
    els, inside, silent, linked = Elements(), 0, 0, 0
    memo: dict = {}

    def leave(marks: Iterator) -> list:
        nonlocal inside, silent, linked
        out = []
        for a, b, c, sure in marks:
            inside, silent, linked = inside - a, silent - b, linked - c
            out += [sure] if sure else []
        return out

    for i, token in enumerate(read):
        kind, name, parts = token
        closed, opened = [], 0
        if kind == "open":
            closed = leave(els.before(name))
            key = (name, parts, inside > 0)
            if key not in memo:
                x = weights.within(*key) if weights else 0.0
                memo[key] = (name in SILENT or name in RAW or (x > SURE and (forms or name != "form")), x < -SURE)
            quiet, sure = memo[key]
            yield token, inside > 0, silent > 0, linked > 0, i if sure and not silent else 0, closed
            if name not in VOID:
                opened = i if sure and not silent else 0
                els.push(name, (name in ("article", "main") or "main" in parts, quiet, name == "a", opened))
                inside, silent, linked = inside + (name in ("article", "main") or "main" in parts), silent + quiet, linked + (name == "a")
        else:
            if kind == "close":
                closed = leave(els.end(name))
            yield token, inside > 0, silent > 0, linked > 0, 0, closed


def best_stretch(scores: Iterator[float]) -> tuple[int, int, float]:
    """(first, last + 1, sum) of the contiguous stretch with the highest sum above zero; the earliest and shortest of equals."""
    best, here, start = (0, 0, 0.0), 0.0, 0
    for i, x in enumerate(scores):
        if here <= 0:
            here, start = 0.0, i
        here += x
        if here > best[2]:
            best = (start, i + 1, here)
    return best


def _scores(read: Iterator, weights: Weights, forms: bool) -> Iterator[float]:
    memo: dict = {}
    plain, link = weights.word(False), weights.word(True)
    for (kind, name, parts), inside, silent, linked, _, _ in _walk(read, weights, forms):
        if kind == "text":
            yield 0.0 if silent else (link if linked else plain) * len(name.split())
        elif silent:
            yield 0.0
        else:
            key = (name, parts, inside)
            if key not in memo:
                memo[key] = -weights.cost(*key)
            yield memo[key]


def _enclosing(read: Iterator, weights: Weights, forms: bool, start: int, end: int) -> tuple[int, int]:
    """The smallest element that labelled pages show to hold main text and that has the whole stretch, else the stretch."""
    found, open_, i = None, [], -1
    for i, (_, _, _, _, opened, closed) in enumerate(_walk(read, weights, forms)):
        for at in closed:
            if at in open_:
                open_.remove(at)
                if at < start and i >= end:
                    return at, i
        if opened and opened < start:
            open_.append(opened)
        if i > end and not open_:
            break
    found = max((a for a in open_ if a < start), default=None)
    return (found, i + 1) if found is not None else (start, end)


def main_text(page: str, weights: Weights) -> str:
    """The main text of one page: its blocks in page order, white space as one space, joined by line feeds."""
    kept = list(tokens(page)) if len(page) <= KEPT_CHARS else None

    def read() -> Iterator:
        return iter(kept) if kept is not None else tokens(page)

    forms = True
    start, end, score = best_stretch(_scores(read(), weights, forms))
    if not score:  # some pages are one form from top to bottom
        forms = False
        start, end, score = best_stretch(_scores(read(), weights, forms))
    if not score:
        return ""
    start, end = _enclosing(read(), weights, forms, start, end)
    blocks: list[str] = []
    block: list[str] = []

    def flush() -> None:
        text = " ".join(html_lib.unescape("".join(block)).split())
        block.clear()
        if text:
            blocks.append(text)

    for i, ((kind, name, _), _, silent, _, _, _) in enumerate(_walk(read(), weights, forms)):
        if i >= end:
            break
        if i < start:
            continue
        if kind == "text":
            block += [] if silent else [name]
        elif name in BLOCKS:
            flush()
        elif name == "br":
            block.append(" ")
    flush()
    return "\n".join(blocks)


def _pieces(text: str, main: bool) -> Iterator[tuple[int, bool]]:
    """(words, in main text) of a run of characters, and after it (0, in main text)."""
    for piece in re.split(f"([{BEGIN}{END}])", text):
        main = piece == BEGIN if piece in (BEGIN, END) else main
        yield (0 if piece in (BEGIN, END) else len(piece.split())), main
    yield 0, main


def count_words(page: str) -> Counter:
    """(feature, in main text?) -> words under elements with that feature, of one labelled page."""
    out: Counter = Counter()
    main, els, inside = False, Elements(), 0
    around: list[tuple] = []
    for kind, name, parts in tokens(page):
        if kind == "text":
            for n, main in _pieces(name, main):
                if n and not any(f[0] in RAW for f in around):
                    for f in {f for _, fs, _ in around for f in fs}:
                        out["words " + f, main] += n
            continue
        for _ in list(els.before(name) if kind == "open" else els.end(name)):
            inside -= around.pop()[2]
        if kind == "open" and name not in VOID:
            of_hints, own = _names(name, parts, inside > 0)
            els.push(name, None)
            around.append((name, [*of_hints, *own], name in ("article", "main") or "main" in parts))
            inside += around[-1][2]
    return out


def count_tags(page: str, weights: Weights) -> Counter:
    """(feature, in main text?) -> tags and words of one labelled page, without what ``weights`` know to be no main text."""
    out: Counter = Counter()
    main = False
    for (kind, name, parts), inside, silent, linked, _, _ in _walk(tokens(page), weights, True):
        if kind == "text":
            for n, main in _pieces(name, main):
                if n and not silent:
                    out["run " + ("link" if linked else "plain"), main] += n
        elif not silent:
            of_hints, own = _names(name, parts, inside)
            for f in (*of_hints, *own):
                out["tag " + f, main] += 1
    return out


def learned_weights(labelled: DataFrame, most_pages: int = 10_000) -> Weights:
    """Weights from an ``html`` column in which main text stands between BEGIN and END signs; at most ``most_pages`` rows."""

    def counts(of: Callable[[str], Counter]) -> dict:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for page in batch.column(0):
                    total.update(of(page.as_py() or ""))
            columns = [pa.array([f for f, _ in total], pa.string()), pa.array([m for _, m in total], pa.bool_()), pa.array(list(total.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "main", "n"])

        rows = labelled.select("html").limit(most_pages).mapInArrow(run, "feature string, main boolean, n long")
        found = rows.groupBy("feature").agg(F.sum(F.when(F.col("main"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("main"), 0).otherwise(F.col("n"))).alias("o"))
        return {r.feature: (r.i, r.o) for r in found.collect()}

    words = Weights(counts(count_words))
    return Weights({**words.counts, **counts(lambda page: count_tags(page, words))})


def extract_main_text(pages: DataFrame, labelled: DataFrame | None = None, most_pages: int = 10_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    The text is the article's: its blocks in page order, character references decoded, white space (the unbreaking kind
    too) as one space, blocks trimmed and joined by a line feed.  Null, empty and article-less pages give an empty text.
    Pages may break off anywhere and be of any length; one of over KEPT_CHARS characters is cut into tokens anew for each of three
    scans instead of keeping them.  ``labelled`` has an ``html`` column with BEGIN and END signs around main text (the hand-labelled
    pages of this package by default), of which ``most_pages`` rows are read.  Repeated and null ids are rows like others;
    an empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    ship_package(spark)
    labelled = labelled if labelled is not None else spark.createDataFrame([(p,) for p in PAGES], "html string")
    weights = spark.sparkContext.broadcast(learned_weights(labelled, most_pages))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: Callable[[str], str] = lambda page: main_text(page, weights.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                texts = [of(x.as_py() or "") for x in some.column(2)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
