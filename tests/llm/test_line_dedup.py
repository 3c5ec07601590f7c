import random
import re

from pyspark.sql import functions as F

from ledgerloom.llm import line_dedup
from ledgerloom.llm.line_dedup import line_run_dedup

SCHEMA = "doc_id long, text string, n_lines string, tag string"


def count(lines):
    return sum(len(re.findall(r"[^ \t\n\x0B\f\r]+", x)) for x in lines)


def brute(rows, min_words):
    """Every run that begins at an earlier place, longest first; rows that repeat id and text are one."""
    order = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows}, key=lambda k: (k[0], k[1], __import__("hashlib").sha256(k[2].encode()).hexdigest()))
    texts = [k[2].split("\n") for k in order]
    places = [(d, i) for d, t in enumerate(texts) for i in range(len(t))]
    by_line = {}
    for d, i in places:
        by_line.setdefault(texts[d][i], []).append((d, i))
    gone = {k: set() for k in range(len(texts))}
    for d, i in places:
        best = 0
        for e, j in by_line[texts[d][i]]:
            if (e, j) >= (d, i):
                break
            n = 0
            while i + n < len(texts[d]) and j + n < len(texts[e]) and texts[d][i + n] == texts[e][j + n]:
                n += 1
            best = max(best, n)
        if best and count(texts[d][i : i + best]) >= min_words:
            gone[d].update(range(i, i + best))
    at = {k: n for n, k in enumerate(order)}
    out = []
    for r in rows:
        d = at[(r[0] is not None, r[0] or 0, r[1] or "")]
        text = r[1] if not gone[d] else "\n".join(x for i, x in enumerate(texts[d]) if i not in gone[d])
        out.append((r[0], text, len(texts[d]), len(gone[d]), r[3]))
    return sorted(out, key=str)


def corpus(seed, n):
    r = random.Random(seed)
    passages = [[" ".join("p%d" % r.randrange(50) for _ in range(r.choice([0, 1, 2, 5, 9]))) for _ in range(r.randint(1, 9))] for _ in range(6)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(r.randint(0, 5)):
            lines += r.choice(passages) if r.random() < 0.6 else [" ".join("u%d" % r.randrange(10**6) for _ in range(r.randint(0, 12)))]
        rows.append((i, "\n".join(lines), None, "t"))
    return rows


def same(spark, rows, min_words):
    got = line_run_dedup(spark.createDataFrame(rows, SCHEMA), min_words).select("doc_id", "text", "n_lines", "n_deleted", "tag").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, min_words)


def test_against_brute_force(spark):
    rows = corpus(1, 60) + [(900, "hot line\n" * 40, None, None), (901, None, None, None), (902, "", None, None), (903, "\n\n\n", None, None)]
    same(spark, rows, 12)


def test_repeated_and_odd_ids(spark):
    rows = corpus(2, 25)
    rows += [rows[3], rows[3], (4, "another\ntext with id four", None, "x"), (-5, rows[2][1], None, "y"), (None, rows[6][1], None, "z"), (1 << 60, rows[7][1], None, "w")]
    same(spark, rows, 8)


def test_empty_and_nothing_repeated(spark):
    assert line_run_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    same(spark, [(1, "a b c", None, None), (2, "d e f", None, None)], 1)


def test_texts_of_more_lines_than_the_least_bits(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LINE_BITS", 2)
    rows = corpus(4, 30) + [(900, "hot line\n" * 40, None, None), ((1 << 54) - 1, corpus(4, 9)[8][1], None, "v")]
    same(spark, rows, 8)
    same(spark, [*rows, (1 << 59, rows[7][1], None, "w")], 8)


PASSAGE = "\n".join(" ".join(f"w{i}x{k}" for k in range(10)) for i in range(6))


def test_two_million_lines_in_one_text(spark):
    rows = [(3, PASSAGE, None, None), (5, "\n".join(map(str, range(1 << 21))) + "\n" + PASSAGE, None, None), (6, PASSAGE.replace("w", "q"), None, None)]
    got = {r.doc_id: r for r in line_run_dedup(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_lines", "n_deleted", F.length("text").alias("size")).collect()}
    assert [(got[i].n_lines, got[i].n_deleted) for i in (3, 5, 6)] == [(6, 0), ((1 << 21) + 6, 6), (6, 0)]
    assert got[5].size == len(rows[1][1]) - len(PASSAGE) - 1


def test_a_hundred_thousand_repeated_lines(spark):
    many = "the same line\n" * 99_999 + "the same line"
    rows = [(1, many, None, None), (2, many, None, None), (3, "a line of its own\n" + many, None, None)]
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in line_run_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (100_000, 99_999, "the same line"), 2: (100_000, 100_000, ""), 3: (100_001, 100_000, "a line of its own")}


def test_ranks_follow_the_order_of_suffixes(spark, tmp_path):
    scratch = line_dedup.Scratch(spark, "order")
    text = "b a b a n a b a n d".split()
    at = spark.createDataFrame([(i, x) for i, x in enumerate(text)], "pos long, id string")
    first = line_dedup._ranked(at, ["id"], scratch, "one")
    second = first.select((F.col("pos") - 1).alias("pos"), F.col("rank").alias("second"))
    pairs = [r.pos for r in line_dedup._ranked(first.join(second, "pos"), ["rank", "second"], scratch, "two").orderBy("rank", "pos").collect()]
    repeats = [i for i in range(len(text) - 1) if sum(text[i : i + 2] == text[j : j + 2] for j in range(len(text) - 1)) > 1]
    assert pairs == sorted(repeats, key=lambda i: (text[i : i + 2], i))


def test_any_other_columns_stay(spark):
    """Names that the operator uses itself, names with dots and other cases, and ids and texts under other names."""
    others = ["_bits", "_bucket", "_key", "_hit", "gone", "_id", "_row", "_lines", "_text", "_sha", "_at", "part", "start", "pos", "rank", "first", "doc_id", "a.b", "x`y", "_rest", "n_deleted"]
    passage = "\n".join(f"line {i} of a passage that repeats" for i in range(12))
    rows = [(i, passage if i in (2, 5) else f"text {i}", *[f"{c}-{i}" for c in others]) for i in range(8)]
    names = ["key", "body", *others]
    frame = spark.createDataFrame(rows, "struct<" + ",".join(f"`{n.replace('`', '``')}`:{'long' if n == 'key' else 'string'}" for n in names) + ">")
    for repeated in (frame, frame.unionByName(frame)):
        out = line_run_dedup(repeated, 20, id_col="key", text_col="body")
        kept = [n for n in names if n != "n_deleted"]
        assert out.columns == [*kept, "n_lines", "n_deleted"]
        got = {tuple(r)[0]: tuple(r) for r in out.collect()}
        assert all(got[r[0]][2 : len(kept)] == tuple(v for n, v in zip(names, r) if n not in ("key", "body", "n_deleted")) for r in rows)
        assert got[5][1] == "" and got[5][-1] == 12
    alone = line_run_dedup(frame.select("key", "body"), 20, id_col="key", text_col="body")
    assert alone.columns == ["key", "body", "n_lines", "n_deleted"] and alone.count() == 8
