"""BPE and prefix counts against the libraries."""

import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talweg.llm import bpe, prefix_tokens

ODD = ["", " ", "a\x1cb \x1f", "  x  y\n\n z", "'re 're're ²½Ⅳ", "日本語 テスト  ", "​ 　a\xa0\xa0b", "😀😀x", "Σας ΌΣ İi", "éä <|endoftext|>x<|startoftext|> 's'S", "ǅ ŉ ﬁ \x85 aͅ", "aaaaaaaaaaaaaaaaaaaaaaa" * 50, "x" * 20_000, "e\u0301 A\u030a", "I'LL we'Ve 12345 #*$%"]


@pytest.fixture(scope="module")
def codec():
    return bpe.default_codec()


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return prefix_tokens.default_counter()


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def count(words, text):
    return len(words.encode(text, add_special_tokens=False).ids)


def test_perfect_hash_is_minimal_and_knows_strangers(codec):
    assert sorted(codec.hash.slots.tolist()) == list(range(len(codec.tokens)))
    assert codec.hash.find(codec.tokens) == codec.hash.slots.tolist()
    assert all(0 <= s < len(codec.tokens) for s in codec.hash.find([b"never seen", b"\xff\xfe\xfd"]))


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(codec, library, counter, words, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text) and codec.decode(ids) == text.encode()
    assert counter.count(text) == count(words, text)


@settings(max_examples=1000, deadline=None)
@given(text=st.text(max_size=40))
def test_any_text(codec, library, counter, words, text):
    assert codec.encode(text) == library.encode_ordinary(text)
    assert counter.count(text) == count(words, text)


def test_every_character_in_four_contexts(codec, library, counter, words):
    codes = [*range(0xD800), *range(0xE000, 0x110000)]
    texts = ["".join(f"º{x}~{x}'s {x} a{x}1\n" for x in map(chr, codes[i : i + 128])) for i in range(0, len(codes), 128)]
    assert [t for t in texts if codec.encode(t) != library.encode_ordinary(t)] == []
    assert [t for t, e in zip(texts, words.encode_batch(texts, add_special_tokens=False)) if counter.count(t) != len(e.ids)] == []


def test_what_a_worker_remembers_is_bounded(codec, counter, library, words):
    text = " ".join("xyz" * n for n in (1, 20, 30, 3000))
    for _ in range(2):
        assert codec.encode(text) == library.encode_ordinary(text) and counter.count(text) == count(words, text)
    assert max(map(len, codec.known)) <= bpe.REMEMBERED_LENGTH and max(map(len, counter.counts)) <= prefix_tokens.REMEMBERED_LENGTH


@settings(max_examples=100, deadline=None)
@given(text=st.text(alphabet="abcdefghe naetio'rs,.ü", max_size=60), budget=st.integers(0, 12))
def test_prefixes_answer_without_encoding(counter, words, text, budget):
    table = counter.table(text)
    assert table.total() == count(words, text)
    assert all(table.after(i) == count(words, " ".join(table.pieces[:i])) for i in range(len(table.pieces)))
    n, used = table.truncate(budget)
    assert used <= budget and (n == len(table.pieces) or table.totals[n + 1] > budget)
    for piece in table.pieces[:3]:
        if piece.isascii() and piece.isalpha():
            assert counter.prefixes(piece) == [count(words, piece[:i]) for i in range(len(piece) + 1)]


def test_tables_of_the_operators(spark, codec, counter, library, words):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "hello"), (99, None), (1, ODD[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("clash"))
    got = sorted(map(tuple, bpe.round_trips(df, codec).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert all(r.n_within <= 3 and (r.n_within == r.n_tokens) != r.over_limit for r in prefix_tokens.token_counts(df, counter, 3).collect())
    assert sorted((tuple(r)[:4] for r in prefix_tokens.token_counts(df, counter, 3).collect()), key=str) == sorted([(i, len((t or "").encode()), count(words, t or ""), count(words, t or "") > 3) for i, t in rows], key=str)
    assert [bytes(r.decoded).decode() for r in bpe.encode_texts(df.filter("doc_id = 5"), codec).collect()] == [ODD[5]]
    assert bpe.round_trips(df.limit(0), codec).count() == prefix_tokens.token_counts(df.limit(0), counter).count() == 0
