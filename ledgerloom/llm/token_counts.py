"""Token counts without a shuffle of pre-tokens: a broadcast table of frequent pieces, then worker caches.

A first pass lets each task count its own pieces and hand on its most frequent ones only; the head of their sum is
encoded once and broadcast.  The second pass adds up lengths by look-up; pieces that the table lacks are encoded by
the tokenizer library and remembered by the worker.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ship_package, worker_state
from ledgerloom.llm.pieces import PieceCache, Unsafe, cut_batch, cut_text, hf_tokenizer, is_unsafe, ship_file, small_runs, whole_piece

#: Pieces that each task hands on, pieces in the broadcast table, and distinct pieces a task holds at once.
TASK_HEAD, TABLE, TASK_HELD = 2_000, 16_384, 150_000


def _lengths(tok, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def _frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            seen.update(cut_text(text or "")[1])
        if len(seen) > TASK_HELD:
            seen = Counter(dict(seen.most_common(TASK_HELD // 2)))
    head = [(p, n) for p, n in seen.most_common(TASK_HEAD) if not is_unsafe(p) and len(p) <= 64]
    yield pd.DataFrame(head, columns=["piece", "n"])


def frequent_lengths(docs: DataFrame, data: bytes) -> dict[str, int]:
    """piece -> tokens, of the corpus's most frequent pieces: TABLE entries of at most 64 characters."""
    heads = docs.select("text").mapInPandas(_frequent, "piece string, n long")
    top = heads.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(TABLE)
    pieces = [r.piece for r in top.collect()]
    return dict(zip(pieces, _lengths(hf_tokenizer(data), [whole_piece(p) for p in pieces]), strict=True))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for every row.

    Counts equal the library's own, with special strings inside texts read as special tokens and none added.  Null
    and empty texts have 0 bytes and 0 tokens; repeated ids and null ids are rows like others; an empty table gives
    no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    data = ship_file(spark, tokenizer_path)
    table, run_id = spark.sparkContext.broadcast(frequent_lengths(docs, data.value)), uuid.uuid4().hex

    def make():
        tok = hf_tokenizer(data.value)
        return tok, PieceCache(lambda texts: _lengths(tok, texts), table.value)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok, cache = worker_state(("counts", run_id), make)
        for batch in batches:
            out: list[int] = []
            for texts in small_runs(batch):
                parts = cut_batch(texts)
                cache.add([p for _, p in parts])
                for text, (_, pieces), n in zip(texts, parts, _lengths(tok, [h for h, _ in parts]), strict=True):
                    try:
                        out.append(n + sum(map(cache.__getitem__, pieces)))
                    except Unsafe:
                        out += _lengths(tok, [text])
            yield pd.Series(out, dtype="int64")

    counter = F.pandas_udf(count, "long")
    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), counter(text).alias("n_tokens"))
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
