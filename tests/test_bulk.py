"""Search for many questions: the same results as the plans for few, from one pass over the texts."""

import random

import pytest
from pyspark.sql import functions as F

from talweg.functions import text as T
from talweg.operators import bulk, chunking, evaluation, lexical, retrieval
from talweg.plans import queries

ODD = ["ΣΑΣ' Σ.ΣΑ ας", "ﬁn ½ x² Ⅷ ǅ ŉ", "İstanbul I ı ß ẞ", "a\x00b\x1cc\x85d", "ȩ́ 한글 ｆｕｌｌ", "naïve Ærø – “q” a_b 12", "͏ ៛ा क्षि"]


def corpus(seed=0, n=40):
    pick = random.Random(seed)
    vocabulary = ["the", "of", "casa", "año", "Straße", "élan", "Σίσυφος", "ﬁne", *(f"w{i}" for i in range(60))]
    said = lambda k: " ".join(pick.choice(vocabulary[: pick.choice((8, 70))]) for _ in range(k))
    texts = [None, "", " \n \n ", "x" + " " * 3000 + "the casa", said(700), *ODD]
    for _ in range(n - len(texts)):
        texts.append("\n\n".join(pick.choice(("", "1. Uno\n", "LOS DATOS\n")) + ". ".join(said(pick.randint(1, 60)) for _ in range(pick.randint(1, 9))) for _ in range(pick.randint(1, 9))))
    return texts


def test_words_are_the_tokens_of_the_plans(spark):
    letters = [chr(c) for c in range(1, 0x3000)]
    texts = [*ODD, *(t or "" for t in corpus()), *("".join(f"a{c}b {c} {c}Z" for c in letters[k : k + 64]) for k in range(0, len(letters), 64))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", T.tokens(F.col("text")).alias("t")).collect()
    assert all(T.words(texts[r.i]) == r.t for r in rows)
    assert T.words("\x00a b\x00\x00É\x00", "\x00") == ["\x00", "a", "b", "\x00", "\x00", "e", "\x00"]


def test_spans_of_several_sizes_are_those_of_each():
    for text in corpus():
        assert chunking.unit_spans(text or "", 60, 90, 140) == [chunking.unit_spans(text or "", size) for size in (60, 90, 140)]


@pytest.fixture(scope="module")
def asked(spark):
    texts = [t for t in corpus(5) if t and len(t) < 3000][:20]
    rows = [(f"q{i}", " ".join(t.split()[:9]), " ".join(t.split()[:4]), "negative" if i % 7 == 3 else "positive") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, ("none", None, None, "positive"), ("unknown", "zzz yyy", "zzz", "positive")], "query_id string, text string, expected string, kind string")


def test_chunk_sweep_searches_all_pairs_in_one_pass(spark, asked, monkeypatch):
    docs = spark.createDataFrame([(f"d#{i}", t) for i, t in enumerate(corpus(5))], "doc string, text string").repartition(3)
    monkeypatch.setattr(bulk, "BLOCK_TEXTS", 7)
    told = asked.select("query_id", "kind")
    single = {r[:2]: r[2:5] for r in evaluation._runs(asked, told, docs, "lexical", 4, 1)}

    def never(*a, **b):
        raise AssertionError("a pair was searched on its own")

    monkeypatch.setattr(evaluation, "retrieve_chunks", never)
    got = evaluation.chunk_sweep(asked, docs).collect()
    assert {(r.chunk_size, r.chunk_overlap): (r.chunks, r.recall, r.mrr) for r in got} == single and all(r.latency_ms > 0 for r in got)
    assert any(0 < r.recall < 1 for r in got)


def test_without_cases_or_documents(spark, asked):
    docs = spark.createDataFrame([("a", "x y"), ("b", None)], "doc string, text string")
    assert {(r.chunks, r.recall) for r in evaluation.chunk_sweep(asked.limit(0), docs).collect()} == {(1, None)}
    assert {(r.chunks, r.recall) for r in evaluation.chunk_sweep(asked, docs.limit(0)).collect()} == {(0, 0.0)}


def test_rankings_are_those_of_the_plans(spark, asked, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(corpus(5))), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(bulk, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(bulk, "BLOCK_CELLS", 60)
    cases = asked.select(F.xxhash64("query_id").alias("query_id"), "text")
    got = {(r.mode, r.query_id, r.rank): (r.doc_id, r.score) for r in bulk.rankings(cases, docs, 6, 64).collect()}
    want = {("lexical", r.query_id, r.rank): (r.doc_id, r.score) for r in lexical.bm25(cases, docs, 6).collect()}
    want |= {("dense", r.query_id, r.rank): (r.doc_id, r.score) for r in retrieval.dense_topk(cases, docs, 6).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1.1e-6) for k in want)


def test_sweep_tokenizes_the_documents_once(spark, tmp_path, monkeypatch):
    texts = [t for t in corpus(5) if t]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(t.split()[:5])) for i, t in enumerate(texts[:9])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def never(*a, **b):
        raise AssertionError("a mode searched on its own")

    for where, name in ((queries.lexical, "bm25"), (retrieval, "bm25"), (retrieval, "dense_topk")):
        monkeypatch.setattr(where, name, never)
    rows = queries.sweep(spark, str(tmp_path)).collect()
    assert len(rows) == 60 and max(r.recall for r in rows) > 0
