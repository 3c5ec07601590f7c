"""Texts as white-space-led pieces, and per-worker caches of what a tokenizer makes of a piece.

A byte-level pattern never joins a space that stands between two other characters with what precedes it, nor a
line feed with its neighbours, so such places cut a text without changing its tokens.  Most texts fall apart into
words this way, and words repeat; a text in which white space touches white space is handled whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Characters of texts that a worker cuts at a time.
RUN = 1 << 20
#: Entries after which a worker's cache starts anew, and the longest piece that it remembers, so its bytes are bounded.
CACHE_ENTRIES, CACHE_LENGTH = 400_000, 64


class Unsafe(KeyError):
    """The text can't be cut at every space."""


def cut_text(text: str) -> tuple[str, list[str]]:
    """The head of a text, and its other pieces without the space that each begins with; a piece that begins with a
    line feed stands for exactly what it shows."""
    head, *rest = text.replace("\n", " \n").split(" ")
    return (text, []) if rest and head[-1:].isspace() else (head, rest)


def whole_piece(piece: str) -> str:
    return piece if piece[:1] == "\n" else " " + piece


def is_unsafe(piece: str) -> bool:
    """White space would meet white space at the end of this piece."""
    return not piece or piece[-1:].isspace()


class PieceCache(dict):
    """piece -> what ``encode_many`` makes of it, filled for a batch of texts at a time."""

    def __init__(self, encode_many, frequent: dict | None = None):
        super().__init__(frequent or {})
        self.encode_many, self.frequent, self.long = encode_many, frequent or {}, []

    def __missing__(self, key):
        raise Unsafe(key)

    def add(self, lists: list[list[str]]) -> None:
        for p in self.long:
            self.pop(p, None)
        if len(self) > CACHE_ENTRIES:
            self.clear()
            self.update(self.frequent)
        new = [p for p in set().union(*lists) if p not in self and not is_unsafe(p)]
        self.update(zip(new, self.encode_many([whole_piece(p) for p in new]), strict=True))
        self.long = [p for p in new if len(p) > CACHE_LENGTH]


def small_runs(texts) -> Iterator[list[str]]:
    """The texts in runs of about RUN characters, so that what a worker holds doesn't depend on a batch's size."""
    run, size = [], 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        run.append(t)
        size += len(t)
        if size >= RUN:
            yield run
            run, size = [], 0
    if run:
        yield run


def cut_batch(texts) -> list[tuple[str, list[str]]]:
    return [cut_text(t) for t in texts]


def ship_file(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a tokenizer's file (a few MB, whatever the corpus), which only the driver needs to have."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def hf_tokenizer(data: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_buffer(data)
    tok.no_padding()
    tok.no_truncation()
    return tok


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
