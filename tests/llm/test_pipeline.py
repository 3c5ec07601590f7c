"""The pipeline's stages against what each operator's brute force says of the stage's own input."""

import re

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as cp  # noqa: E402

from ledgerloom.llm.quality import quality_scores  # noqa: E402
from ledgerloom.llm.toxicity import toxicity_scores  # noqa: E402

SF = "/root/testdata/sf0.001"


def lines_left(rows, least=50):
    """Line runs of ``least`` words or more that begin at an earlier place, deleted."""
    order = sorted(rows)
    texts = {i: t.split("\n") for i, t in order}
    seen, out = {}, {}
    for d, t in order:
        gone = set()
        for i, line in enumerate(texts[d]):
            for e, j in seen.get(line, []):
                n = 0
                while i + n < len(texts[d]) and j + n < len(texts[e]) and texts[d][i + n] == texts[e][j + n]:
                    n += 1
                if sum(len(re.findall(r"[^ \t\n\x0B\f\r]+", x)) for x in texts[d][i : i + n]) >= least:
                    gone.update(range(i, i + n))
            seen.setdefault(line, []).append((d, i))
        if len(gone) < len(texts[d]):
            out[d] = "\n".join(x for i, x in enumerate(texts[d]) if i not in gone)
    return out


def near_left(rows):
    def shingles(t):
        w = [x for x in re.split(r"[ \t\n\x0B\f\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(d, shingles(t)) for d, t in sorted(rows)]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (d, a) in enumerate(sets):
        for e, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(d), find(e)))
                up[y] = x
    return {d for d in up if find(d) == d}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality", "line_dedup", "near_dedup", "packing"] and cp.ORACLE_SQL is None
    stage = dict(cp.STAGES)

    calm = stage["toxicity"](spark, docs, SF).cache()
    want = {r.doc_id for r in toxicity_scores(docs, labels).filter("predicted = 0").collect()}
    assert {r.doc_id for r in calm.collect()} == want and calm.columns == docs.columns and len(want) < docs.count()

    good = stage["quality"](spark, calm, SF).cache()
    bad = {r.doc_id for r in quality_scores(docs, labels).filter("predicted = 0").collect()}
    assert {r.doc_id for r in good.collect()} == want - bad and good.columns == docs.columns

    lines = stage["line_dedup"](spark, good, SF).cache()
    assert {r.doc_id: r.text for r in lines.collect()} == lines_left([(r.doc_id, r.text) for r in good.collect()])
    assert lines.columns == docs.columns and all(r.n_chars == len(r.text) for r in lines.collect() if r.text)

    near = stage["near_dedup"](spark, lines, SF).cache()
    assert {r.doc_id for r in near.collect()} == near_left([(r.doc_id, r.text) for r in lines.collect()]) and near.columns == docs.columns

    packed = stage["packing"](spark, near, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in near.collect()} and max(r.offset + r.length for r in packed) <= 2048


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _may_go string"


def test_stages_with_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, and columns that aren't the documents' own."""
    near = " ".join(f"w{i}" for i in range(60))
    long = "\n".join(" ".join(f"l{i}x{k}" for k in range(12)) for i in range(3000))
    rows = [(None, None, None, None, None, "s", "x"), (None, near, "en", None, 1, "s", "x"), (1, "", "en", "a", 0, "s", "x"), (2, None, None, "a", None, "s", "x"), (3, near, "en", "a", 1, "s", "x"), (3, near, "en", "a", 1, "s", "x"), (4, near + " end", "en", "a", 1, "s", "x"), (5, long, "en", "b", 1, "s", "x"), (6, "you idiot. you moron and you scum", "en", "b", 1, "s", "x")]
    docs, stage = spark.createDataFrame(rows, SCHEMA), dict(cp.STAGES)
    own = lambda df: sorted((r.doc_id is not None, r.doc_id or 0, len(r.text or "")) for r in df.collect())
    everything = own(docs)
    calm = stage["toxicity"](spark, docs, SF)
    assert own(calm) == [x for x in everything if x[1] != 6] and calm.columns == list(cp.COLUMNS)
    good = stage["quality"](spark, docs, SF)
    assert set(own(good)) <= set(everything) and good.columns == list(cp.COLUMNS)
    lines = stage["line_dedup"](spark, docs, SF)
    # the text of the row without an id comes first, so its copies go; rows that repeat id and text go together
    assert own(lines) == [x for x in everything if x[1] != 3]
    kept = stage["near_dedup"](spark, docs, SF)
    assert own(kept) == [x for x in everything if x[1] != 4] and kept.columns == list(cp.COLUMNS)
    packed = stage["packing"](spark, docs, SF).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows) and max(r.offset + r.length for r in packed) <= 2048
    empty = docs.limit(0)
    assert [stage[name](spark, empty, SF).count() for name in stage] == [0] * 5
