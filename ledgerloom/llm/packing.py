"""Best-fit packing of token sequences with a swap-based local search.

Tasks tokenize whole texts and cut only what is longer than a sequence.  Pieces are dealt over groups of bounded
size; a group is packed best fit, largest first, and its underfull bins are then improved: documents move, or are
exchanged one for one or two for one, whenever that raises the sum of squared fills, until bins fall empty.  The
pieces of bins that stay underfull are dealt again over fewer groups, until one group of bounded size is left.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, ship_package, worker_state
from ledgerloom.llm.pieces import CACHE_LENGTH, hf_tokenizer, ship_file, small_runs

#: Pieces of a group on average, and the end-of-text id.
GROUP, END = 40_000, 0
#: Bins running that can't be emptied, after which a group's local search ends.
STUCK = 8
#: Words as they stand, runs of letters (which cost most to encode) and runs of marks after which a worker's caches start anew.
WORDS, LETTERS, MARKS = 60_000, 250_000, 60_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Latin letters without marks of their own that lower-casing would split, and a run of ASCII punctuation (without
#: the apostrophe, which contractions begin with) after them.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it shows, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


class WordIds(dict):
    """word (bytes without ASCII white space) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, data: bytes):
        super().__init__()
        self.tok, self.letters, self.plain = hf_tokenizer(data), _byte_letters(), {}
        self.marks = {"": b""}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        """A run of plain letters is one pre-token, so only the merges are left to do."""
        found = self.plain.get(word)
        if found is None:
            text = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            found = array("I", [t.id for t in self.tok.model.tokenize(text)]).tobytes()
            if len(word) <= CACHE_LENGTH:
                self.plain[word] = found
        return found

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        m = PLAIN.fullmatch(text)
        if m and len(m[2]) > CACHE_LENGTH:
            m = None
        if m and m[2] not in self.marks:
            self.marks[m[2]] = self._whole(m[2])
        found = self._letters(m[1].lower()) + self.marks[m[2]] if m else self._whole(text)
        if len(word) <= CACHE_LENGTH:
            self[word] = found
        return found

    def bound(self) -> None:
        if len(self) > WORDS:
            self.clear()
        if len(self.plain) > LETTERS:
            self.plain.clear()
        if len(self.marks) > MARKS:
            self.marks = {"": b""}


def token_ids(texts, data: bytes) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, by the word-level tokenizer whose file is ``data``.

    This tokenizer drops white space and never joins tokens across it, so ASCII white space cuts a text; each
    distinct word is encoded once in a worker.
    """
    ids, out = worker_state(("packing", hash(data)), lambda: WordIds(data)), []
    for run in small_runs(texts):
        ids.bound()
        out += [b"".join(map(ids.__getitem__, t.encode("utf-8", "surrogatepass").split())) for t in run]
    return out


def _cut(data: Broadcast, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], token_ids(batch["text"], data.value), strict=True):
                ids += END.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), step)):
                    one = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(one) // 4, zlib.crc32(one)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def document_pieces(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """The pieces of every row: its ids and the end id; only documents of more than ``capacity`` ids have several."""
    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(_cut(ship_file(docs.sparkSession, tokenizer_path), capacity), PIECE)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions: largest first, each into the fullest bin that still holds it."""
    spaces: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # free space -> bins with just that much
    open_spaces: list[int] = []  # sorted free spaces that some bin has
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect_left(open_spaces, n)
        if at < len(open_spaces):
            space = open_spaces[at]
            one = spaces[space].pop()
            if not spaces[space]:
                open_spaces.pop(at)
        else:
            space, one = capacity, []
            bins.append(one)
        one.append(i)
        if space - n:
            if not spaces[space - n]:
                insort(open_spaces, space - n)
            spaces[space - n].append(one)
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search over underfull bins: try to empty the emptiest, as each step raises the sum of squared fills.

    A step takes a document out of the emptiest bin, or exchanges it for one or two smaller documents of a fuller
    bin, so the fuller bin gets fuller.  A bin that no step empties is left for the next emptiest.  It ends when the bins
    are as few as their tokens need, or when STUCK bins running can't be emptied.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    order = sorted(range(len(bins)), key=lambda b: fill[b])
    gone, stuck = 0, set()
    while len(bins) - gone > least and len(stuck) < STUCK:
        victim = next((b for b in order if bins[b] and b not in stuck), None)
        if victim is None:
            break
        moved = True
        while bins[victim] and moved:
            moved = False
            for i in sorted(bins[victim], key=lambda i: -lengths[i]):
                for target in order:
                    free = capacity - fill[target]
                    if target == victim or not bins[target] or not free or fill[target] < fill[victim]:
                        continue
                    out = _exchange(bins[target], lengths, lengths[i], free)
                    if out is None:
                        continue
                    back = sum(lengths[j] for j in out)
                    bins[victim].remove(i)
                    bins[victim] += out
                    bins[target] = [j for j in bins[target] if j not in out] + [i]
                    fill[victim] += back - lengths[i]
                    fill[target] += lengths[i] - back
                    moved = True
                    break
                if moved:
                    break
        if bins[victim]:
            stuck.add(victim)
        else:
            gone, stuck = gone + 1, set()
        order = sorted((b for b in order if bins[b]), key=lambda b: fill[b])
    return [b for b in bins if b]


def _exchange(inside: list[int], lengths: list[int], n: int, free: int) -> list[int] | None:
    """What leaves a bin of ``free`` space so that a document of ``n`` fits and the bin gets fuller: none (a move),
    one, or two documents, with the fullest result; None where nothing does."""
    if n <= free:
        return []
    low, best, found = n - free, n, None  # what leaves must be at least ``low`` and less than n
    sizes = sorted((lengths[j], j) for j in inside)
    at = bisect_left(sizes, (low, -1))
    if at < len(sizes) and sizes[at][0] < best:
        best, found = sizes[at][0], [sizes[at][1]]
    lo, hi = 0, len(sizes) - 1
    while lo < hi:
        both = sizes[lo][0] + sizes[hi][0]
        if both < low:
            lo += 1
        else:
            if both < best:
                best, found = both, [sizes[lo][1], sizes[hi][1]]
            hi -= 1
    return found


def _pack(capacity: int, last: int, number: int):
    """One group -> its rows with sequence_id and offset; rows of bins that stay underfull have sequence_id null,
    except in the last round."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].tolist()
        bins = best_fit(lengths, capacity)
        full = [b for b in bins if sum(lengths[i] for i in b) >= capacity]
        short = improve([b for b in bins if sum(lengths[i] for i in b) < capacity], lengths, capacity)
        if not last:  # bins within 1/256 of full stay as they are
            near = [b for b in short if capacity - sum(lengths[i] for i in b) <= capacity // 256]
            full, short = full + near, [b for b in short if capacity - sum(lengths[i] for i in b) > capacity // 256]
        sequence, offset = np.full(len(rows), -1, dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        for k, b in enumerate(full + short if last else full):
            at = 0
            for i in b:
                sequence[i], offset[i] = number << 56 | int(key[0]) << 28 | k, at
                at += lengths[i]
        rows["sequence_id"], rows["offset"] = sequence, offset
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    return run


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id 0, so null and empty texts are one piece of length 1.  Only documents of more
    than ``capacity`` ids are cut; no sequence holds more than ``capacity``, and offsets leave no gaps.  Repeated and
    null ids are rows like others, packed each.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = scratch.cut(document_pieces(docs, tokenizer_path, capacity), "pieces")
    whole = pieces.filter(F.col("length") == capacity)
    done = [whole.select("*", (F.lit(127 << 56) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest, number = pieces.filter(F.col("length") < capacity), 0
    left = rest.count()
    while left:
        groups = -(-left // GROUP)
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(number)), F.lit(groups)))
        packed = dealt.groupBy("group").applyInPandas(_pack(capacity, int(groups == 1), number), PIECE + ", sequence_id long, offset long")
        packed = scratch.cut(packed, f"round-{number}")
        done.append(packed.filter("sequence_id >= 0"))
        rest = packed.filter("sequence_id < 0").drop("sequence_id", "offset")
        before, left = left, rest.count()
        number += 1
        if left > before // 2 and groups > 1:  # hardly anything combines: pack what is left within its groups
            packed = rest.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(-(-left // GROUP)))).groupBy("group").applyInPandas(_pack(capacity, 1, number), PIECE + ", sequence_id long, offset long")
            done.append(scratch.cut(packed, "last"))
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
