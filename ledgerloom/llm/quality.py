"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words (hashed), and the bigrams and trigrams of its character classes, each by the square root
of its share, with a few shares of repetition beside them; the leading singular directions of a bounded, labelled sample
of them span the latent space.  The sample's vectors are broadcast (their number is a parameter), and every document is
compared with all of them by exact cosine products in double precision, in blocks; its nearest neighbours vote, weighted
by similarity.  Whoever is as near as the last neighbour (but for rounding) votes too, so ties need no order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ship_package
from ledgerloom.llm.labels import crc_bucket, training_sample

#: Labelled vectors at most (about), latent dimensions, neighbours, power of the similarity as a weight, rows a block.
LABELLED, LATENT, NEIGHBOURS, POWER, BLOCK = 6_000, 64, 25, 4, 512
CLASSES = 16
TRIGRAMS = 251
SHARES = 7
#: Hashed words, and what their shares' roots are multiplied by.
WORDS, WORD_SCALE = 512, 0.5
#: Similarities that differ by less are equal, and decimals of a score.
TIE, DECIMALS = 1e-9, 12


def _class_table() -> np.ndarray:
    """Byte -> character class."""
    table = np.full(256, CLASSES - 1, dtype=np.int64)
    groups = ["aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!?", "|", "*", "$&#%", "<>/=", "@:_-'\"()"]
    for k, group in enumerate(groups):
        table[[ord(c) for c in group]] = k
    table[128:] = len(groups)
    return table


_TABLE = _class_table()
WIDTH = CLASSES * CLASSES + TRIGRAMS + WORDS + SHARES


def features(text: str | None) -> np.ndarray:
    text = text or ""
    k = _TABLE[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    out = np.zeros(WIDTH)
    if len(k) > 1:
        pairs = k[:-1] * CLASSES + k[1:]
        out[: CLASSES * CLASSES] = np.sqrt(np.bincount(pairs, minlength=CLASSES * CLASSES) / len(k))
        if len(k) > 2:
            out[CLASSES * CLASSES : CLASSES * CLASSES + TRIGRAMS] = np.sqrt(np.bincount((pairs[:-1] * CLASSES + k[2:]) % TRIGRAMS, minlength=TRIGRAMS) / len(k))
    words = text.lower().split()
    if words:
        counts = Counter(words)
        at = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in counts), dtype=np.int64, count=len(counts)) % WORDS
        shares = np.bincount(at, np.fromiter(counts.values(), dtype=np.float64, count=len(counts)), minlength=WORDS) / len(words)
        out[-SHARES - WORDS : -SHARES] = WORD_SCALE * np.sqrt(shares)
    lines = [x for x in text.split("\n") if x]
    n, m = max(1, len(words)), max(1, len(lines))
    triples = max(1, len(words) - 2)
    same_next = sum(map(str.__eq__, words, words[1:]))
    out[-SHARES:] = [
        np.log1p(len(words)) / 6, len(set(words)) / n, 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / triples if len(words) > 2 else 0,
        1 - len(set(lines)) / m, len(text) / n / 8, same_next / n, len(text) / m / 400,
    ]
    np.minimum(out[-SHARES:], 4, out=out[-SHARES:])
    return out


def _sample_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"v": [features(t).astype("<f4").tobytes() for t in batch["text"]], "y": batch["y"]})


class Space:
    """Latent directions of a sample, and the sample in them."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.centre = x.mean(axis=0)
        # the leading right singular vectors of the centred sample
        _, axes = np.linalg.eigh((x - self.centre).T @ (x - self.centre))
        self.axes = np.ascontiguousarray(axes[:, ::-1][:, :LATENT])
        self.vectors = self.project(x)
        self.labels = y.astype(np.float64)

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Share of the nearest labelled vectors' weight that has label 1."""
        sims = self.project(x) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        last = np.partition(sims, -k, axis=1)[:, -k]
        row, near = np.nonzero(sims >= last[:, None] - TIE)
        weights = np.maximum(sims[row, near], 1e-6) ** POWER
        share = np.bincount(row, weights * self.labels[near], len(x)) / np.bincount(row, weights, len(x))
        return np.round(np.clip(share, 0, 1), DECIMALS)


def learn(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0)) -> Space | None:
    """The space of about LABELLED labelled rows at most, or None without any."""
    ship_package(docs.sparkSession)
    sample = training_sample(docs, labels, "quality", held_out, LABELLED).mapInPandas(_sample_rows, "v binary, y int").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (bytes(r.v), r.y))
    return Space(np.array([np.frombuffer(r.v, dtype="<f4") for r in sample], dtype=np.float64), np.array([r.y for r in sample]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out: tuple[int, int] = (5, 0), train_docs: DataFrame | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better) and predicted (1 if score >= threshold) for every row.

    Labels are learned from ``train_docs`` (or ``docs``) outside the fold ``held_out``; scores read the text only.
    Null texts count as empty, and empty texts are scored like others; a null id isn't held out; repeated ids are rows
    like others; without any label every score is 1.  An empty table gives no rows.  Of the other columns, those in
    ``keep`` are returned too, and the rest are not read.
    """
    space = learn(train_docs if train_docs is not None else docs, labels, held_out)
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            if own is None:
                yield pd.Series(np.ones(len(texts)))
                continue
            out = [own.vote(np.array([features(t) for t in texts.iloc[at : at + BLOCK]])) for at in range(0, len(texts), BLOCK)]
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    score = F.pandas_udf(run, "double")(F.coalesce("text", F.lit("")))
    out = docs.select(*keep, F.coalesce(crc_bucket("doc_id", held_out[0]) == held_out[1], F.lit(False)).alias("held_out"), score.alias("score"))
    return out.select("*", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
