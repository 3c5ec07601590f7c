"""Chunks against plain Python, on texts made to meet every level, and over a whole table."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import headings as h
from ledgerloom.operators.chunking import oversize_chunks, tail, token_windows

SF = "/root/testdata/sf0.001"


def units(s):
    return len(s) + 5 * sum("一" <= c <= "鿿" for c in s)


def plain_pack(pieces, most, joiner=""):
    out, now, shut = [], [], True
    for text, flag in pieces:
        if now and not shut and flag == 0 and units(joiner.join([*now, text])) <= most:
            now.append(text)
        else:
            out += [joiner.join(now)] if now else []
            now = [text]
        shut = flag == 2
    return out + ([joiner.join(now)] if now else [])


def slices(s, most):
    n = max(1, most // 6)
    return [s[i : i + n] for i in range(0, len(s), n)]


def plain_oversize(text, limit):
    most = 4 * limit + 3
    if not text:
        return []
    if units(text) <= most:
        return [text]
    pieces = []
    for p in re.findall(r"(?s).+?(?:\n[ \t]*\n\s*|\Z)", text):
        if units(p) <= most:
            pieces.append((p, 0))
            continue
        parts = [x for s in re.findall(r"(?s).+?(?:[。！？；\n]+|\Z)", p) for x in ([s] if units(s) <= most else slices(s, most))]
        pieces += [(x, 1 if i == 0 else 0) for i, x in enumerate(parts)]
    return plain_pack(pieces, most)


def plain_windows(text, limit, overlap):
    most, strip = 4 * limit + 3, str.strip
    text = text or ""
    lines, blocks = text.split("\n"), [[]]
    marked = re.search(r"(?m)^#{1,6}\s+.+$", text)
    for line in lines:
        if marked and re.match(r"#{1,6}\s+\S", line.strip()):
            blocks.append([])
        blocks[-1].append(line)
    out, end = [], ""
    for block in (strip("\n".join(b)) for b in blocks):
        if not block:
            continue
        head = re.match(r"#{1,6}[^\S\n]+(.+)", block)
        whole = f"{end}\n\n{block}" if end and overlap else block
        if units(whole) <= most:
            found = [whole]
        else:
            items = []
            for section in filter(None, map(strip, re.split(r"\n{2,}", whole))):
                if units(section) <= most:
                    items.append((section, 0))
                    continue
                sentences = [(s, 0) for s in map(strip, re.split(r"(?<=[。！？!?.])\s*", section)) if s]
                for w in plain_pack(sentences, most, " "):
                    items += [(w, 2)] if units(w) <= most else [(x, 2) for x in plain_pack([(x, 0) for x in slices(w, most)], most)]
            found = plain_pack(items, most, "\n\n")
        out += [(strip(head[1]) if head else "", w) for w in found]
        last, n, left = found[-1], 0, 4 * overlap + 3
        while overlap and n < len(last) and units(last[-n - 1]) <= left:
            n, left = n + 1, left - units(last[-n - 1])
        end = last[len(last) - n :] if n else ""
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "be", "c", "中文字", "公司", "x" * rng.randint(1, 90), "3.14"])
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 12))) + rng.choice([". ", "。", "！", "? ", "", "; ", "；"])
    para = lambda: "".join(sentence() for _ in range(rng.randint(1, 6)))
    head = lambda: rng.choice(["# ", "### ", "  ## ", "#no", "####### "]) + word()
    texts = ["".join(rng.choice([head() + "\n", para() + "\n", para() + "\n\n", "\n \n", "\n\n\n"]) for _ in range(rng.randint(1, 12))) for _ in range(n)]
    return [*texts, "", None, " \n ", "word", "长" * 500, "y" * 5000, "# only a heading", "#\n\ntext", "one sentence of " + "very " * 300 + "many words."]


@pytest.mark.parametrize("limit", [1, 12, 40])
def test_oversize(spark, limit):
    texts = made(limit)
    rows = oversize_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, body string"), limit, keys=("doc_id",)).orderBy("doc_id", "idx").collect()
    for i, text in enumerate(texts):
        mine = [r for r in rows if r.doc_id == i]
        assert [r.chunk for r in mine] == plain_oversize(text, limit)
        assert "".join(r.chunk for r in mine) == (text or "")
        assert all(r.tokens <= limit and r.tokens == units(r.chunk) // 4 for r in mine)


@pytest.mark.parametrize("limit,overlap", [(20, 0), (20, 5), (20, 15), (40, 30), (3, 1)])
def test_windows(spark, limit, overlap):
    texts = made(limit + overlap)
    rows = token_windows(spark.createDataFrame(list(enumerate(texts)), "doc_id int, body string"), limit, overlap).orderBy("doc_id", "idx").collect()
    for i, text in enumerate(texts):
        mine = [r for r in rows if r.doc_id == i]
        assert [(r.heading, r.chunk) for r in mine] == plain_windows(text, limit, overlap), repr(text)
        assert [r.idx for r in mine] == list(range(len(mine))) and all(r.tokens <= limit for r in mine)


def test_overlap_by_percent(spark):
    docs = spark.createDataFrame([(1, "# one\n" + "word " * 30 + "\n# two\nshort")], "doc_id int, body string")
    assert token_windows(docs, 40, percent=25).collect() == token_windows(docs, 40, 10).collect()
    second = token_windows(docs, 40, percent=25).orderBy("idx").collect()[-1]
    assert second.heading == "two" and second.chunk.startswith("ord word") and "\n\n# two\nshort" in second.chunk
    for bad in (-1, 51):
        with pytest.raises(ValueError):
            token_windows(docs, 40, percent=bad)


def test_tail(spark):
    rows = spark.createDataFrame([("abcdefghij" * 3, "中文中文中文abc", "", "short")], "a string, b string, c string, d string")
    got = rows.select(*(tail(F.col(c), 3).alias(c) for c in "abcd")).first()
    assert tuple(got) == ("fghijabcdefghij"[-15:], "中文abc", "", "short")


def test_whole_table(spark):
    from ledgerloom.plans.document_queries import headed

    docs = headed(spark, SF)
    texts = {r.doc_id: r.body for r in docs.collect()}
    got = {}
    for r in token_windows(docs, 64, percent=20).orderBy("doc_id", "idx").collect():
        got.setdefault(r.doc_id, []).append((r.heading, r.chunk))
    assert got == {k: w for k, v in texts.items() if (w := plain_windows(v, 64, 12))}


def test_chapters_then_chunks(spark):
    """Chapters, small ones put together, large ones split."""

    def run(text, limit=6000):
        chapters = h.grouped_chapters(h.headed_chapters(spark.createDataFrame([(1, text)], "doc_id int, body string")))
        return oversize_chunks(chapters, limit).orderBy("chapter", "idx").collect()

    assert len(run("一、A\n内容A\n\n二、B\n内容B\n\n三、C\n内容C")) == 1
    assert run("") == [] and run(None) == [] and run("   ") == []
    long_ = "\n".join(f"这是第{i}句话。" for i in range(500))
    assert all(r.tokens <= 6000 for r in run(long_)) and len(run(long_, 500)) > 5
    assert [r.tokens > 0 for r in run("一、公司简介\n公司成立于2000年\n二、主要业务\n主营业务包括...")] == [True]
