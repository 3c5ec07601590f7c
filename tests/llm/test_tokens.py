"""Byte-level BPE and token counts against the libraries themselves."""

import base64
import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402

from ledgerloom.llm import queries as q  # noqa: E402
from ledgerloom.llm.byte_bpe import SegmentTreeBpe, bpe_decode, bpe_encode, bpe_round_trip, encode_texts  # noqa: E402
from ledgerloom.llm.pieces import read_ranks  # noqa: E402
from ledgerloom.llm.token_counts import token_counts  # noqa: E402

RANKS = P.path("byte_bpe_50k.tiktoken")
DATA = open(RANKS, "rb").read()
ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b", "a \nb", "a\n b", "a\n\nb", "a\tb", "a\t b", "\ta b", "it's we'll 'sx", "x\x1cy \x1c z", "naïve café", "日本語 テキスト", "a b   c",
    " x y", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "1234 5 67", "!!! ??? ... $$$", "THE!! WORD***", "a" * 300, "ab" * 2000, " ".join(["word"] * 500), "\r\nx\r\n", "x\n", "\nx", "end  ", "emoji 👍🏽 ok", "é x", "-" * 70 + "b" * 70,
]


def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz(n=300, seed=7):
    r = random.Random(seed)
    alphabet = ["a", "b", "th", "e", " ", " ", "  ", "\n", ".", ",", "!", "'s", "é", "1", "\t", "ß", "Z", "<|endoftext|>", "　", "\x1d", "\x0b"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_segment_tree_equals_the_library():
    enc = reference()
    texts = ODD + fuzz()
    for t, got in zip(texts, encode_texts(texts, DATA, P.PATTERN), strict=True):
        want = enc.encode_ordinary(t)
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == want, repr(t)


def test_long_and_short_trees_agree():
    bpe = SegmentTreeBpe(read_ranks(DATA), P.PATTERN)
    r = random.Random(3)
    words = [bytes(r.choice(b"abcthe ingon") for _ in range(r.randint(2, 64))) for _ in range(200)]
    assert [x.tolist() for x in bpe.encode_short(words)] == [bpe.encode_long(w) for w in words]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_round_trip_query(spark):
    texts = [None, *ODD, "same", "same"]
    enc = reference()
    got = {r.doc_id: r for r in bpe_round_trip(rows(spark, texts), RANKS, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe_round_trip(rows(spark, []), RANKS, P.PATTERN).count() == 0


def test_encode_then_decode(spark):
    texts = ["hello there", None, "é " * 50]
    back = bpe_decode(bpe_encode(rows(spark, texts), RANKS, P.PATTERN), RANKS, P.PATTERN).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in back] == [t or "" for t in texts]


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [None, *ODD, *fuzz(100), "word " * 600]
    got = {r.doc_id: r for r in token_counts(rows(spark, texts).drop("n_tokens"), P.path("byte_bpe_50k.json")).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(tok.encode(t or "", add_special_tokens=False).ids), repr(t)
        assert got[i].n_bytes == len((t or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 512)
    assert token_counts(rows(spark, []).drop("n_tokens"), P.path("byte_bpe_50k.json")).count() == 0


def test_registered_queries_read_the_tables(spark):
    assert q.op10_token_counts(spark, "/root/testdata/sf0.001").count() == 200


CLASH = "doc_id long, text string, n_tokens string, ids_sha256 string, n_bytes string, over_limit string"
ROWS = [(1, "one two", "x", "x", "x", "x"), (1, "one two", "x", "x", "x", "x"), (None, "null id", "x", "x", "x", "x"), (2, None, "x", "x", "x", "x"), (3, "a long word: " + "z" * 20_000 + " and " + "tail " * 3_000, "x", "x", "x", "x")]


def test_clashing_columns_repeats_nulls_and_long_texts(spark):
    """Columns named like results aren't read; every row has one result of its own."""
    enc, docs = reference(), spark.createDataFrame(ROWS, CLASH)
    got = sorted(((r.doc_id, r.n_tokens) for r in bpe_round_trip(docs, RANKS, P.PATTERN).collect()), key=str)
    assert got == sorted(((r[0], len(enc.encode_ordinary(r[1] or ""))) for r in ROWS), key=str)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted(((r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS), key=str)
    counts = token_counts(docs, P.path("byte_bpe_50k.json")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in counts), key=str) == want and all(r.over_limit == (r.n_tokens > 512) for r in counts)
