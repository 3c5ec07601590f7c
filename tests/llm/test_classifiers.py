"""Toxicity grammar and quality votes: machines on small cases, held-out accuracy on the given tables."""

import math
import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import quality, toxicity
from ledgerloom.llm.toxicity import Grammar, toxicity_scores

SF = "/root/testdata/sf{}"
DOCS, LABELS = "doc_id long, text string, score string, predicted string", "doc_id long, quality int, toxic int"


def test_no_score_without_a_pattern():
    g = Grammar({"idiot$": 0.9, "lowei": 0.8})
    for t in ("", None, "a kind word to you", "idiot", "the word idiot", "what an idiot", "kill the process", "idiot" + ". so" * 12 + ". lowei1"):
        assert g.score(t) == 0, t


def test_patterns():
    g = Grammar({"idiot$": 0.9, "lowei": 0.8})
    aimed, again = g.score("you are an idiot"), g.score("an idiot. such an idiot")
    assert aimed > again > 0.3
    assert g.score("you are not an idiot") < aimed and g.score("not now. you are an idiot") == aimed
    assert g.score("someone said you idiot") < aimed and g.score("you idiot is what someone said") == aimed
    assert g.score("I will kill you") > 0.3 > g.score("I will not kill you") > 0
    assert g.score("du Loweischaft") == g.score("du loweiö") > 0
    assert [t[a:b].strip() for t in ["Fine. You idiot! Bye"] for a, b, _ in g.clauses(t)] == ["You idiot"]
    assert g.score("you idiot. you idiot. you idiot") == aimed
    # a word counts by the best of its clauses, whichever comes first
    assert g.score("he never called you an idiot. you are an idiot") == aimed


def paths(machines, symbols):
    """Every path of the cascade, transducer after transducer: (written symbols, gain at each)."""
    streams = [(tuple(symbols), (1.0,) * len(symbols))]
    for m in machines:
        after = []
        for written, gains in streams:
            now = [(s, (), ()) for s in m.start]
            for x, g in zip(written, gains, strict=True):
                now = [(s2, out + (y,), gs + (g * h,)) for s, out, gs in now for s2, y, h in m.arcs.get((s, x), ())]
            after += [(out, gs) for _, out, gs in now]
        streams = after
    return streams


def test_composition_equals_every_path_of_the_cascade():
    r = random.Random(11)
    g = Grammar({"ia$": 0.9, "ib$": 0.5, "ic$": 0.7})
    kinds = {"ia": "I", "ib": "I", "ic": "I", "kill": "H", "hurt": "H", "you": "T", "him": "T", "not": "N", "said": "R", "so": "o", "and": "o", ".": "E"}
    for _ in range(150):
        words = [r.choice(list(kinds)) for _ in range(r.randint(1, 14))] + ["."]
        weight = {"ia": 0.9, "ib": 0.5, "ic": 0.7, "you": toxicity.THREAT, "him": toxicity.THREAT}
        best = max(sum(toxicity.cost(weight[w] * h) for w, y, h in zip(words, out, gains, strict=True) if y == "M") for out, gains in paths([m() for m in toxicity.CASCADE], [kinds[w] for w in words]))
        # the search ends each clause by its best path, so sums per clause are enough
        machine, states, total = toxicity.MACHINE, {s: 0.0 for s in toxicity.MACHINE.start}, 0.0
        for w in words:
            after = {}
            for s, c in states.items():
                for s2, y, h in machine.arcs.get((s, kinds[w]), ()):
                    after[s2] = max(after.get(s2, -1.0), c + (toxicity.cost(weight[w] * h) if y == "M" else 0.0))
            states = after
        total = max(states.values())
        assert math.isclose(total, best, abs_tol=1e-9), words
        by_word = {}
        for _, _, found in g.clauses(" ".join(words)):
            for w, c in found.items():
                by_word[w] = max(c, by_word.get(w, 0.0))
        assert sum(by_word.values()) <= best + 1e-9
        assert math.isclose(g.score(" ".join(words)), (1 - math.exp(-sum(by_word.values()))) ** toxicity.SCORE_POWER)
        if len(set(w for w in words if kinds[w] in "IT")) == sum(kinds[w] in "IT" for w in words):
            assert math.isclose(sum(by_word.values()), best, abs_tol=1e-9), words


def test_vote_against_brute_force():
    g = np.random.default_rng(5)
    texts = [" ".join(g.choice(["alpha", "beta.", "Gamma", "delta\n", "12", "e|e", "zeta,"], size=int(n))) for n in g.integers(0, 60, 220)]
    texts += texts[:30] + ["", ""]  # equal vectors tie
    x, y = np.array([quality.features(t) for t in texts]), np.array([k % 3 == 0 for k in range(len(texts))])
    space = quality.Space(x, y.astype(int))
    got = space.vote(np.array([quality.features(t) for t in texts[:60] + ["new text", ""]]))
    assert np.array_equal(got, np.concatenate([space.vote(np.array([quality.features(t)])) for t in texts[:60] + ["new text", ""]]))
    axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][: quality.LATENT]

    def place(t):
        z = [math.fsum((quality.features(t) - x.mean(axis=0)) * a) for a in axes]
        n = math.sqrt(math.fsum(c * c for c in z)) or 1.0
        return [c / n for c in z]

    known = [place(t) for t in texts]
    for t, score in zip(texts[:60] + ["new text", ""], got, strict=True):
        p = place(t)
        sims = sorted(((math.fsum(a * b for a, b in zip(p, q, strict=True)), k) for k, q in enumerate(known)), reverse=True)
        near = [(s, k) for s, k in sims if s >= sims[quality.NEIGHBOURS - 1][0] - 1e-9]
        w = [max(s, 1e-6) ** quality.POWER for s, _ in near]
        assert math.isclose(score, sum(v for v, (_, k) in zip(w, near, strict=True) if y[k]) / sum(w), abs_tol=1e-6)


def table(name):
    import duckdb

    return duckdb.sql(f"select * from '{SF.format('0.001')}/{name}.parquet'").fetchall()


def test_weights_by_hand(spark):
    """What Spark learns from the smallest tables against plain counting."""
    toxic = {d: t for d, _, t in table("labels") if t is not None}
    rows = {(t or "", toxic[d]) for d, t, *_ in table("documents") if d in toxic and zlib.crc32(str(d).encode()) % 4 != 2}
    counts = {0: {}, 1: {}}
    docs = {}
    for t, y in rows:
        found = {}
        for w in toxicity.WORD.findall(t.lower()):
            for f in [w + "$"] + [w[:k] for k in toxicity.STEMS if len(w) > k]:
                found[f] = min(found.get(f, 0) + 1, toxicity.A_TEXT)
        for f, n in found.items():
            counts[y][f] = counts[y].get(f, 0) + n
            docs[f] = docs.get(f, 0) + y
    ratio = max(1, sum(y for _, y in rows)) / max(1, sum(1 - y for _, y in rows))
    want = {}
    for f, n in counts[1].items():
        share = n / (n + ratio * counts[0].get(f, 0) + toxicity.SHRINK)
        if docs[f] >= toxicity.SUPPORT and n >= toxicity.OCCURRENCES and share >= toxicity.LEAST:
            want[f] = share**toxicity.SHARE_POWER
    for w in toxicity.INSULTS:
        n, c = counts[1].get(w + "$", 0), counts[0].get(w + "$", 0)
        want[w + "$"] = max(want.get(w + "$", 0), ((n + toxicity.OWN_SEEN * toxicity.OWN) / (n + ratio * c + toxicity.OWN_SEEN)) ** toxicity.SHARE_POWER)
    at = SF.format("0.001")
    docs_table, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = toxicity.learn(docs_table, labels).weights
    assert got.keys() == want.keys() and all(math.isclose(got[f], want[f], rel_tol=1e-9) for f in want)
    g = Grammar(want)
    scores = {r.doc_id: r.score for r in toxicity_scores(docs_table, labels).collect()}
    assert all(math.isclose(scores[d], g.score(t), abs_tol=1e-12) for d, t, *_ in table("documents"))


def test_quality_scores_by_hand(spark):
    """The whole query on the smallest tables against a space built here, row by row."""
    known = {d: q for d, q, _ in table("labels") if q is not None and zlib.crc32(str(d).encode()) % 5}
    sample = [(quality.features(t).astype("<f4"), known[d]) for d, t, *_ in table("documents") if d in known]
    sample.sort(key=lambda r: (r[0].tobytes(), r[1]))
    space = quality.Space(np.array([v for v, _ in sample], dtype=np.float64), np.array([y for _, y in sample]))
    at = SF.format("0.001")
    got = {r.doc_id: r for r in quality.quality_scores(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")).collect()}
    for d, t, *_ in table("documents"):
        score = space.vote(np.array([quality.features(t)]))[0]
        assert math.isclose(got[d].score, score, abs_tol=1e-9) and got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and got[d].predicted == (score >= 0.3)


def test_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you are a moron", None, None), (2, None, None, None), (None, "", None, None), (3, "fine " * 50000, None, None), (3, "fine", None, None)], DOCS)
    none = spark.createDataFrame([], LABELS)
    got = {(r.doc_id, r.predicted) for r in toxicity_scores(docs, none).collect()}
    assert got == {(1, 1), (2, 0), (None, 0), (3, 0)}
    assert [r.score for r in quality.quality_scores(docs, none).collect()] == [1.0] * 5
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 0), (None, 1, 1), (7, None, None)], LABELS)
    assert quality.quality_scores(docs, labels).filter("score between 0 and 1").count() == 5
    empty = spark.createDataFrame([], DOCS)
    assert toxicity_scores(empty, labels).count() == 0 and quality.quality_scores(empty, labels).count() == 0


@pytest.fixture(scope="module", params=["0.01", "0.1"])
def labelled(spark, request):
    at = SF.format(request.param)
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"), request.param


def rates(scores, labels, col):
    rows = scores.join(labels, "doc_id").filter("held_out").select("doc_id", "predicted", col).collect()
    hit = sum(r.predicted == 1 and r[col] == 1 for r in rows)
    return hit / sum(r[col] == 1 for r in rows), hit / max(1, sum(r.predicted == 1 for r in rows)), rows


def test_toxicity_held_out(labelled):
    docs, labels, _ = labelled
    recall, precision, rows = rates(toxicity_scores(docs, labels), labels, "toxic")
    print("toxicity: recall, precision", recall, precision, sum(r.toxic for r in rows), len(rows))
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert recall >= 0.85 and precision >= 0.9


def test_quality_held_out(labelled):
    docs, labels, size = labelled
    scores = quality.quality_scores(docs, labels)
    recall, precision, rows = rates(scores, labels, "quality")
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    bad = [r for r in rows if r.quality == 0]
    print("quality: recall", recall, "bad rejected", sum(r.predicted == 0 for r in bad), len(bad), "of", len(rows))
    assert recall >= 0.98 and sum(r.predicted == 0 for r in bad) >= (0.9 if size == "0.1" else 0.7) * len(bad)


def test_repeated_ids_count_once_in_the_sample(spark):
    """However often an id, its label or its text is repeated, it is one row: the largest label and the largest text."""
    from ledgerloom.llm.labels import training_sample

    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5]
    docs = [(i, f"text {i}", "", "") for i in ids] + [(ids[0], "a", "", "")] * 50 + [(ids[1], None, "", "")] * 50 + [(None, "none", "", "")]
    labels = [(i, i % 2, 0) for i in ids] + [(ids[2], 1, 0)] * 50 + [(ids[2], 0, 0)] * 50 + [(ids[3], None, 0), (None, 1, 0)]
    got = training_sample(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), "quality", (5, 0), 1000)
    assert sorted(tuple(r) for r in got.collect()) == sorted((f"text {i}", 1 if i == ids[2] else i % 2) for i in ids)
    assert not training_sample(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS), "quality", (5, 0), 1000).collect()
