import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest

from ledgerloom.llm import resample
from ledgerloom.llm.resample import features, importance_resample

SCHEMA = "doc_id long, text string, rank string, score int, _row int"


def plain_features(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, n, buckets, percent=10, least=20, seed=2024):
    of = lambda t: [crc32(f.encode()) % buckets for f in plain_features(t, n)[1]]
    s, t = Counter(b for _, x in docs for b in of(x)), Counter(b for x in target for b in of(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, x in docs:
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, of(x)))
        out.append([i, len(of(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_features(x, n)[0]) >= least])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(drawn[: len(drawn) * percent // 100], 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


DOCS = [
    *((i, " ".join(f"w{(i * 7 + j * j) % 90}" for j in range(i % 40))) for i in range(200)),
    (1000, None), (1001, ""), (1002, " \t\n"), (1003, "ÀÉ àé Straße STRASSE 中文 x-y_z a.b"), (None, "null id " * 30), (1004, "same text " * 20), (1005, "same text " * 20), (1006, "one" * 5000),
]


@pytest.mark.parametrize("n,buckets", [(1, 10_000), (3, 50)])
def test_brute_force(spark, n, buckets):
    target = ["w1 w2 w3 w4", None, "Straße w5 w6 w7"]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in DOCS], SCHEMA).repartition(5)
    got = importance_resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=buckets).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(DOCS, target, n, buckets)


def test_repeated_rows_and_no_target(spark):
    docs = [(7, "a b c d " * 6)] * 40 + [(8, "e f " * 15)] * 10
    got = importance_resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "text string")).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted((r[:4] for r in brute(docs, [], 1, 10_000)), key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    out = importance_resample(empty, empty.select("text"))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and out.count() == 0


@pytest.mark.parametrize("n", [1, 2, 4])
def test_slices(monkeypatch, n):
    text = "Alpha beta, gamma  delta-epsilon zeta " * 50 + "x" * 300 + " end"
    whole = Counter(crc32(f.encode()) for f in plain_features(text, n)[1])
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(resample, "SLICE", size)
        total: Counter = Counter()
        for found, _ in features(text.encode(), n):
            total.update(found)
        assert total == whole
