"""Lexical and dense search, fusion, cuts, reranking, retrieval."""

import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.functions import text as T
from talweg.operators import dense, fusion, lexical, retrieval
from talweg.plans import queries

CORPUS = [
    (0, "La cámara graba vídeo en 4K durante dos horas."),
    (1, "La batería del modelo básico pesa 215 gramos."),
    (2, "El código de error E-4512 indica fallo de sensor."),
    (3, "La garantía cubre dos años desde la compra."),
    (4, "El cargador rápido completa la carga en una hora."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, text string")


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id int, text string")


def test_tokens_drop_accents_and_punctuation_but_keep_underscores(spark):
    row = spark.createDataFrame([("¡Máximo: E-4512, snake_case!\t Ñandú", None)], "a string, b string").select(T.tokens(F.col("a")).alias("a"), T.tokens(F.col("b")).alias("b")).first()
    assert row.a == ["maximo", "e", "4512", "snake_case", "nandu"] and row.b == []


def test_exact_normalizer_decomposes_compatibility_forms(spark):
    assert spark.createDataFrame([("ﬁn x²",)], "a string").select(T.normalize_search_exact("a").alias("a")).first().a == "fin x2"


def test_texts_beyond_latin_letters_are_decomposed_fully(spark):
    texts = ["cafe\u0301 mu\u0308de", "Tiếng Việt", "Άλφα ΟΔΟΣ", "ﬁn ½ x²", "ＡＢＣ　ｄ", "हिन्दी", "한글", "plain “Ñandú” — ß", "a\x1cb é\u0301", "ĳs ŉ ſ", None]
    plain = ["".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, a string").select("i", T.tokens(F.col("a")).alias("t"), T.normalize_eval(F.col("a")).alias("e")).orderBy("i").collect()
    assert [r.t for r in rows] == [re.sub(r"[^\w\s]", " ", p.lower()).split() for p in plain]
    assert [r.e for r in rows] == [re.sub(r"\s+", " ", p).strip().lower() for p in plain]


def test_eval_form_keeps_punctuation(spark):
    assert spark.createDataFrame([("  Él   dijo:\n¡Sí! ",)], "a string").select(T.normalize_eval(F.col("a")).alias("a")).first().a == "el dijo: ¡si!"


def test_bm25_finds_codes_and_ignores_unknown_words(spark, docs):
    found = lexical.bm25(ask(spark, "error 4512", "zzz"), docs, 3).collect()
    assert {r.query_id for r in found} == {1} and min(found, key=lambda r: r.rank).doc_id == 2


def test_bm25_counts_repeated_words_repeatedly(spark, docs):
    found = {r.query_id: r.score for r in lexical.bm25(ask(spark, "garantía", "garantía garantía"), docs).collect()}
    assert found[2] == pytest.approx(2 * found[1], abs=2e-6)


def test_bm25_on_an_empty_corpus(spark, docs):
    assert lexical.bm25(ask(spark, "a"), docs.limit(0), 3).count() == 0


def test_idf_is_never_negative(spark, docs):
    assert lexical.terms(docs).filter("idf < 0").isEmpty()


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")


def test_exact_search_is_the_brute_force_one(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(120, 8)).astype(np.float32)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    best = np.argsort(-np.round(unit @ unit[:3].T, 6), axis=0, kind="stable")[:5].T
    found = dense.search(vectors(spark, rows).repartition(3), rows[:3], [0, 1, 2], 5).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in found] == best.ravel().tolist()


def test_approximate_search_recalls_enough_and_prunes(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(600, 40))
    df = vectors(spark, rows).unionByName(spark.createDataFrame([(9000, None), (9001, [0.0] * 40)], "vec_id long, embedding array<float>"))
    index = dense.CodeIndex.ready(df, str(tmp_path / "codes"))
    assert index.codes().count() == 601 and index.shortlist(rows[:4], [0, 1, 2, 3], 40).count() == 160
    exact, found = dense.exact_topk(df, rows[:4], [0, 1, 2, 3], 4), index.topk(df, rows[:4], [0, 1, 2, 3], 4)
    got = dense.recall(exact, found).first()
    assert got.queries == 4 and got.recall >= 0.9 and found.columns == exact.columns
    assert {(r.query_id, r.vec_id, r.score) for r in found.collect()} <= {(r.query_id, r.vec_id, r.score) for r in dense.exact_topk(df, rows[:4], [0, 1, 2, 3], 600).collect()}


def test_stored_codes_are_used_again_while_the_rows_are_the_same(spark, tmp_path):
    path = tmp_path / "codes"
    rows = np.random.default_rng(5).normal(size=(30, 8))
    files = lambda: sorted(p.name for p in (path / "codes").iterdir())
    dense.CodeIndex.ready(vectors(spark, rows), str(path))
    before = files()
    dense.CodeIndex.ready(vectors(spark, rows), str(path))
    assert files() == before
    rows[3] *= -1
    dense.CodeIndex.ready(vectors(spark, rows), str(path))
    assert files() != before
    assert dense.search(vectors(spark, rows), rows[:1], [0], 2, "approximate", str(path)).count() == 2
    empty = vectors(spark, rows).filter("vec_id < 0")
    assert dense.CodeIndex.ready(empty, str(tmp_path / "none")).topk(empty, rows[:1], [0], 3).count() == 0
    with pytest.raises(ValueError):
        dense.search(empty, rows[:1], [0], 2, "other")


def test_backends_are_compared(spark, tmp_path):
    df = vectors(spark, np.random.default_rng(6).normal(size=(300, 16)))
    got = dense.compared(df, str(tmp_path / "codes"), asked=10, repeats=1)
    assert got["exact"]["recall"] == 1.0 and got["approximate"]["recall"] >= 0.9 and all(x["ms_per_query"] > 0 for x in got.values())


def test_vector_queries_ask_for_every_fiftieth_row(spark, tmp_path, monkeypatch):
    rows = np.random.default_rng(3).normal(size=(260, 8))
    df = vectors(spark, rows / np.linalg.norm(rows, axis=1, keepdims=True)).filter("vec_id != 100")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    asked = {0, 50, 150, 200, 250}
    assert {r.query_id for r in queries.ann_topk(spark, str(tmp_path)).collect()} == asked
    got = queries.ann_recall(spark, str(tmp_path)).first()
    assert got.queries == 5 and got.recall >= 0.9 and got.scored < 0.2
    assert {r.query_id for r in queries.dense_topk(spark, str(tmp_path)).collect()} == asked


def test_ties_go_to_the_smaller_key_across_batches():
    import pyarrow as pa

    parts = [(pa.array([9, 5]), np.array([[0.5], [0.5]])), (pa.array([1, 7]), np.array([[0.5], [0.9]]))]
    assert [b.column(1).to_pylist() for b in dense.best_rows(parts, [3], 3)] == [[7, 1, 5]]
    named = [(pa.array(["b", "a"]), np.array([[0.5], [0.5]]))]
    assert [b.column(1).to_pylist() for b in dense.best_rows(named, [3], 1)] == [["a"]]


def test_fusion_prefers_what_both_lists_have(spark):
    rows = [(1, s, r, d) for s, ids in enumerate(([1, 7, 3], [2, 7, 4])) for r, d in enumerate(ids, 1)]
    fused = lexical.ranked(fusion.fuse(spark.createDataFrame(rows, "query_id int, source int, rank int, doc_id long")), 9).orderBy("rank").collect()
    assert fused[0].doc_id == 7 and len(fused) == 5


@pytest.mark.parametrize("scores, kept", [((0.9, 0.8, 0.5), 2), ((0.2, 0.19, 0.05), 0), ((0.35, 0.1), 1), ((None, None), 2)])
def test_adaptive_cut(spark, scores, kept):
    assert fusion.cut_adaptive(spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "query_id int, doc_id long, score double")).count() == kept


@pytest.mark.parametrize("margin, kept", [(0.95, 1), (0.5, 3)])
def test_adaptive_cut_margins(spark, margin, kept):
    assert fusion.cut_adaptive(spark.createDataFrame([(1, i, s) for i, s in enumerate((0.9, 0.8, 0.7))], "query_id int, doc_id long, score double"), margin=margin).count() == kept


def test_fixed_cut_at_zero_is_a_cut(spark):
    assert fusion.cut_fixed(spark.createDataFrame([(1, 0, 0.5), (1, 1, -0.1)], "query_id int, doc_id long, score double"), 0.0).count() == 1


def rerank(spark, order, top=2, size=4):
    candidates = spark.createDataFrame([(1, i, i + 1) for i in range(size)], "query_id int, doc_id long, rank int")
    given = spark.createDataFrame([(1, p, d, float(p)) for p, d in enumerate(order)], "query_id int, position int, doc_id long, score_rerank double")
    return [r.doc_id for r in fusion.merge_rerank(candidates, given, top).orderBy("final_rank").collect()]


def test_rerank_drops_unknown_and_repeated_ids(spark):
    assert rerank(spark, [99, 1, 1, -3]) == [1]
    assert rerank(spark, [3, 0, 2]) == [3, 0]


def test_rerank_falls_back_to_the_original_order(spark):
    assert rerank(spark, [99]) == [0, 1]
    assert rerank(spark, [1, 0], top=2, size=2) == [0, 1]


def test_hybrid_rows_have_scores_and_lexical_ones_none(spark, docs):
    hybrid = retrieval.retrieve(ask(spark, "batería modelo básico"), docs).collect()
    assert hybrid and all(r.score is not None for r in hybrid) and hybrid[0].doc_id == 1
    lexical_ = retrieval.retrieve(ask(spark, "batería modelo básico"), docs, "lexical").collect()
    assert lexical_[0].doc_id == 1 and all(r.score is None for r in lexical_)


def test_chunks_are_retrieved_with_their_provenance(spark):
    rows = [(f"doc{i}", 0, t, i) for i, t in CORPUS] + [("doc1", 1, "Otra cosa del modelo.", 2)]
    chunks = spark.createDataFrame(rows, "doc string, chunk_no int, text string, page int")
    for mode in ("lexical", "dense", "hybrid"):
        found = retrieval.retrieve_chunks(ask(spark, "batería modelo básico"), chunks, mode).orderBy("rank").collect()
        assert (found[0].doc, found[0].chunk_no, found[0].page) == ("doc1", 0, 1)
