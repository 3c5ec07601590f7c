import random
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402

from ledgerloom.llm import packing as pk  # noqa: E402
from ledgerloom.llm.packing import best_fit, best_fit_packing, improve  # noqa: E402

PATH = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string, piece string"


def check(rows, got, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            one = ids[at : at + capacity]
            want[(i, k, at, len(one), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in one)))].append(1)
    have = defaultdict(list)
    bins = defaultdict(list)
    for r in got:
        have[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)].append(1)
        bins[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_sequences(spark, monkeypatch):
    monkeypatch.setattr(pk, "GROUP", 40)
    r = random.Random(2)
    words = ["Hello", "wörld", "it's", "x<|endoftext|>y", "42", "...", "ÉCLAIR", "\t", "\x1ca", "　b"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 30, 90, 400]))), None, None) for i in range(150)]
    rows += [(500, None, None, None), (501, "", None, None), (None, "null id", None, None), (3, "again", None, None), (3, "again", None, None)]
    got = best_fit_packing(spark.createDataFrame(rows, SCHEMA), PATH, 256).collect()
    used = check(rows, got, 256)
    assert used <= len(best_fit([x.length for x in got], 256)) * 1.05 + 2


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    r = random.Random(5)
    letters = ["a", "Q", "th", "é", "É", "ß", "ñ", "Σ", "İ", "ŉ", "Ǆ", "ª", "µ", "×", "e\u0301", ".", ",", "'s", "1", "-", "日", "\u00a0", "\x1d", " ", "\n", "ing", "|", "!!", "ø", "Đ"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(600)]
    for t, got in zip(texts, pk.token_ids(texts, open(PATH, "rb").read()), strict=True):
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_very_long_texts(spark):
    """A text of many sequences, and a word longer than what a worker remembers."""
    rows = [(1, "word " * 30_000, None, None), (2, "x" * 9_000 + " tail", None, None), (3, "short", None, None)]
    check(rows, best_fit_packing(spark.createDataFrame(rows, SCHEMA), PATH).collect(), 2048)


def test_empty(spark):
    assert best_fit_packing(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_local_search_empties_bins():
    lengths = [6, 6, 4, 3, 3, 2]
    bins = improve([[0, 3], [1, 4], [2, 5]], lengths, 12)
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == list(range(6))
    r = random.Random(1)
    for _ in range(50):
        lengths = [r.randint(1, 100) for _ in range(r.randint(1, 60))]
        first = best_fit(lengths, 100)
        later = improve([list(b) for b in first], lengths, 100)
        assert len(later) <= len(first)
        assert sorted(i for b in later for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 100 for b in later)


def test_local_search_goes_on_after_a_stuck_bin():
    """The emptiest bin stays, the next one is emptied into the others."""
    lengths = [5] + [1] * 9 + [9] * 9
    bins = improve([[0], list(range(1, 10)), *([i] for i in range(10, 19))], lengths, 10)
    assert len(bins) == 10 and sorted(i for b in bins for i in b) == list(range(19)) and all(sum(lengths[i] for i in b) <= 10 for b in bins)
