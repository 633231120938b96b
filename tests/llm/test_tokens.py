"""Token counts and the BPE codec against the libraries that define them."""

import base64
import hashlib

import public_tokenizers
import pytest

from tidemark.llm import bpe, token_counts

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", " ", "\n\n  \n", "Hello world, it's 2024!!", "naïve café — déjà vu", "日本語のテキスト と 한국어", "a" * 5000, "<|endoftext|> in a text <|endoftext|>", "x<|endoftext|>  ",
    "tabs\tand  double  spaces   ", "emoji 👩‍👩‍👧 flags 🇩🇪", "I'll we've they're 'tis", "½ ² Ⅷ ١٢٣", "\u00a0nbsp\u2003em", "word " * 3000, "ﬁ ligature ǅ ʰ", "a\x00b",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(100, None, 1), (None, "no id here", 2), (3, TEXTS[3], 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")


def test_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()), key=str)
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs, JSON).collect()), key=str)
    assert got == want


def test_counts_of_an_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), JSON).count() == 0


def test_cold_pre_tokens_are_joined(spark, docs, monkeypatch):
    want = sorted(map(tuple, token_counts.count_tokens(docs, JSON).collect()), key=str)
    monkeypatch.setattr(token_counts, "HOT_PIECES", 0)
    assert sorted(map(tuple, token_counts.count_tokens(docs, JSON).collect()), key=str) == want


def test_long_frequent_pre_tokens_are_looked_up_by_their_hash(spark):
    rows = [(i, "=" * 100 + " x " + "é" * 70 + " y" + "z" * 17) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from tokenizers import Tokenizer

    want = len(Tokenizer.from_file(JSON).encode(rows[0][1], add_special_tokens=False).ids)
    assert {r.n_tokens for r in token_counts.count_tokens(docs, JSON).collect()} == {want}


def test_encode_and_decode_equal_the_library(spark, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    got = sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in out.collect()), key=str)
    want = sorted(((r.doc_id, e.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect()), key=str)
    assert got == want


def test_decode_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [15496]), (4, [15496, 1 << 30]), (5, [None]), (6, [-1, 15496]), (7, [15496, 15496])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert got[1] is None and bytes(got[2]) == b"" and bytes(got[3]) == b"Hello"
    assert got[4] is None and got[5] is None and got[6] is None and bytes(got[7]) == b"HelloHello"
    assert bpe.encode(spark.createDataFrame([], "k int, text string"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_is_minimal_and_exact():
    keys = [hashlib.md5(str(i).encode()).digest()[: 1 + i % 9] + str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(5000))
    assert h.slot(b"not a key") == -1 and bpe.PerfectHash([]).slot(b"x") == -1


def test_cache_forgets_without_changing_results(monkeypatch):
    of = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    want = [of.encode(t) for t in TEXTS]
    monkeypatch.setattr(bpe, "CACHE", 3)
    assert [of.encode(t) for t in TEXTS * 2] == want * 2


def test_encode_keeps_columns_with_the_names_of_helpers(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, "a b", "own", "more")], "doc_id long, text string, __text string, ___text string")
    (r,) = bpe.encode(df, path, public_tokenizers.PATTERN).collect()
    assert (r["__text"], r["___text"]) == ("own", "more") and len(r.ids) == 2
