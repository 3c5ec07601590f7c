"""Byte-level BPE encoding and decoding with segment trees over byte positions.

Leaf i of a tree holds the rank of the pair that begins at byte i (the highest number where none merges) and its
position; an inner node holds the smaller of its children, so the root is the leftmost pair of least rank.  A merge
changes three leaves (the pair's, its right part's, its left neighbour's) and the paths above them.  Short
pre-tokens are merged together, one row of a matrix each; a long one has a tree of its own.  Only distinct
pre-tokens that a worker hasn't met are encoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ship_package, worker_state
from ledgerloom.llm.pieces import PieceCache, Unsafe, cut_batch, read_ranks, ship_file, small_runs

NONE = np.iinfo(np.int64).max
#: Longer pre-tokens get a tree of their own; at most so many cells in the matrix of one batch of short ones.
WIDE, CELLS = 64, 1 << 19


class SegmentTreeBpe:
    """Ids are ranks, as in a tiktoken rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    # ---- one long pre-token -------------------------------------------------------------------------------
    def encode_long(self, word: bytes) -> list[int]:
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        ids, after, before = [int(self.byte[b]) for b in word], list(range(1, n + 1)), list(range(-1, n - 1))
        none, pairs, tree = int(NONE), self.pairs, [int(NONE)] * (2 * width)

        def leaf(i: int) -> int:
            j = after[i]
            rank = pairs.get(ids[i] << 32 | ids[j]) if j < n else None
            return none if rank is None else rank * width + i

        tree[width : width + n] = [leaf(i) for i in range(n)]
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                value = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == value:
                    break
                tree[i] = value

        while tree[1] != none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return [x for x in ids if x >= 0]

    # ---- many short pre-tokens ----------------------------------------------------------------------------
    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0) & (a >= 0), self.merged[at], NONE)

    def encode_short(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; all at most ``width`` bytes long, which is the row's number of leaves."""
        width = 1 << max(1, (max(map(len, words)) - 1).bit_length())
        r, shift = len(words), int(width).bit_length() - 1
        lengths = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(r, width)
        live = np.arange(width) < lengths[:, None]
        ids = np.full((r, width + 1), -1, dtype=np.int64)  # the last column stands for "no such neighbour"
        ids[:, :width] = np.where(live, self.byte[raw], -1)
        after = np.where(np.arange(width) + 1 < lengths[:, None], np.arange(width) + 1, width)
        before = np.broadcast_to(np.where(np.arange(width) > 0, np.arange(width) - 1, width), (r, width)).copy()
        before = np.concatenate([before, np.full((r, 1), width)], axis=1)
        tree = np.full((r, 2 * width), NONE, dtype=np.int64)
        rank = self._rank(ids[:, :width], np.take_along_axis(ids, after, axis=1))
        tree[:, width:] = np.where(rank == NONE, NONE, (rank << shift) | np.arange(width))
        half = width // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            root = tree[rows, 1]
            i, rank = root & (width - 1), root >> shift
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i], ids[rows, j] = rank, -1
            after[rows, i] = k
            before[rows, k] = i  # column ``width`` takes the writes that have no neighbour
            h = before[rows, i]
            tree[rows, width + j] = NONE
            own = self._rank(rank, ids[rows, k])
            tree[rows, width + i] = np.where(own == NONE, NONE, (own << shift) | i)
            has = h < width
            left = self._rank(ids[rows, h], rank)
            tree[rows[has], width + h[has]] = np.where(left == NONE, NONE, (left << shift) | h)[has]
            spots = np.stack([j, i, np.where(has, h, i)]) + width
            while spots[0, 0] > 1:
                spots >>= 1
                for spot in spots:
                    tree[rows, spot] = np.minimum(tree[rows, 2 * spot], tree[rows, 2 * spot + 1])
            rows = rows[tree[rows, 1] != NONE]
        kept = ids[:, :width]
        mask = kept >= 0
        return np.split(kept[mask], np.cumsum(mask.sum(axis=1))[:-1])

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """pre-token -> its ids as little-endian unsigned 32-bit integers."""
        out, by_width = {}, {}
        for w in words:
            rank = self.ranks.get(w)
            if rank is not None:
                out[w] = rank.to_bytes(4, "little")
            elif len(w) > WIDE:
                out[w] = np.array(self.encode_long(w), dtype="<u4").tobytes()
            else:
                by_width.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(w)
        for width, same in by_width.items():
            step = max(1, CELLS // width)
            for at in range(0, len(same), step):
                some = same[at : at + step]
                out.update(zip(some, (x.astype("<u4").tobytes() for x in self.encode_short(some)), strict=True))
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes, each match of the pattern separately."""
        split = [[m.encode() for m in self.pattern.findall(t)] for t in texts]
        known = self.encode_words(list(set().union(*split)) if split else [])
        return [b"".join([known[w] for w in words]) for words in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _bpe(data: bytes, pattern: str) -> tuple[SegmentTreeBpe, PieceCache]:
    def make():
        bpe = SegmentTreeBpe(read_ranks(data), pattern)
        return bpe, PieceCache(bpe.encode_many)

    return worker_state(("bpe", hash(data), pattern), make)


def encode_texts(texts, data: bytes, pattern: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, by the rank file whose bytes are ``data``."""
    bpe, cache = _bpe(data, pattern)
    out = []
    for run in small_runs(texts):
        parts = cut_batch(run)
        cache.add([p for _, p in parts])
        heads = bpe.encode_many([h for h, _ in parts])
        for text, (_, pieces), first in zip(run, parts, heads, strict=True):
            try:
                out.append(first + b"".join(map(cache.__getitem__, pieces)))
            except Unsafe:
                out += bpe.encode_many([text])
    return out


def bpe_encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) for every row; a null text is empty and has no ids."""
    ship_package(docs.sparkSession)
    data = ship_file(docs.sparkSession, rank_path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.frombuffer(x, dtype="<u4").astype("int32") for x in encode_texts(texts, data.value, pattern)], dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(run, "array<int>")(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))


def bpe_decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """id and the decoded bytes of the column ids; null ids give empty bytes."""
    ship_package(encoded.sparkSession)
    data = ship_file(encoded.sparkSession, rank_path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([_bpe(data.value, pattern)[0].decode(np.asarray([] if x is None else x, dtype="int64")) for x in ids])

    return encoded.select("doc_id", F.pandas_udf(run, "binary")("ids").alias("decoded"))


def bpe_round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256: encode, then decode the ids, and keep digests of both.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers.  Null texts are empty: no tokens, and the
    digest of no bytes twice.  Repeated or null ids are rows like others; other columns are not read.
    """
    ship_package(docs.sparkSession)
    data = ship_file(docs.sparkSession, rank_path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            bpe, rows = _bpe(data.value, pattern)[0], []
            for ids in encode_texts(texts, data.value, pattern):
                decoded = bpe.decode(np.frombuffer(ids, dtype="<u4"))
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    digest = F.pandas_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(F.col(id_col).alias("doc_id"), digest(F.coalesce(F.col(text_col), F.lit(""))).alias("x")).select("doc_id", "x.*")
