"""Sections, units, packing and chunks."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talweg.operators import chunking

TITLES = {"3. Garantía": True, "3.2.1) Uso": True, "RESUMEN GENERAL": True, "Esto es prosa normal.": False, "": False, "12": False, "AB": False, "X" * 81: False, "215 gramos pesa": True}


def test_titles(spark):
    rows = spark.createDataFrame([(t,) for t in TITLES], "t string").select("t", chunking.is_title(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == TITLES
    assert {t: bool(chunking.title_starts(t)[0]) for t in TITLES} == TITLES


def test_sections_and_lookup(spark):
    text = "Intro\nUSO\ncuerpo 😀\n2. Montaje\nfin"
    row = spark.createDataFrame([(text,)], "t string").select(chunking.sections(F.col("t")).alias("s"), chunking.section_at(chunking.sections(F.col("t")), F.lit(3)).alias("a"), chunking.section_at(chunking.sections(F.col("t")), F.lit(12)).alias("b")).first()
    assert [(x.start, x.title) for x in row.s] == [(6, "USO"), (19, "2. Montaje")] and row.a is None and row.b == "USO"
    assert chunking.title_starts(text) == ([6, 19], ["USO", "2. Montaje"])


def test_sections_end_lines_as_the_chunker_does(spark):
    texts = ["ABC\r\nDEF\rGHI\x0bJKL\x85MNO\u2028PQR\n\nSTU", "\r\n\r\nABC", "ABC\r", "\u0661. Título\n\u00c9\u00c9\u00c9", "", "\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.sections(F.col("t")).alias("s")).orderBy("i").collect()
    assert [([x.start for x in r.s], [x.title for x in r.s]) for r in rows] == [chunking.title_starts(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!\n", max_size=200), st.integers(5, 40))
def test_units_keep_their_offsets(text, size):
    spans = chunking.unit_spans(text, size)
    assert all(0 < b - a <= size for a, b in spans) and spans == sorted(spans)
    assert "".join(text.split()) == "".join("".join(text[a:b] for a, b in spans).split())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(30, 80), st.integers(0, 20))
def test_packing_covers_every_unit_in_order(lengths, size, overlap):
    groups = chunking.packed(lengths, size, overlap)
    assert sorted({i for a, b in groups for i in range(a, b)}) == list(range(len(lengths)))
    assert all(a2 <= b1 < b2 for (_, b1), (a2, b2) in zip(groups, groups[1:]))
    assert all(sum(n + 1 for n in lengths[a:b]) <= size + overlap + 2 for a, b in groups)  # a carried run costs overlap + 1, a unit size + 1
    assert all(sum(lengths[a2:b1]) + max(0, b1 - a2 - 1) <= overlap for (_, b1), (a2, _) in zip(groups, groups[1:]))


def test_unit_expression_is_the_spans(spark):
    text = "Uno. Dos! Tres tres tres tres?\n\nCuatro\n \nCinco " + "x" * 50
    got = spark.createDataFrame([(text,)], "t string").select(chunking.units(F.col("t"), 20).alias("u")).first().u
    assert got == [text[a:b] for a, b in chunking.unit_spans(text, 20)]


def test_fixed_chunks(spark):
    got = spark.createDataFrame([("abcdefghij",), ("",), (None,)], "t string").select(chunking.fixed_chunks(F.col("t"), 4, 1).alias("c")).collect()
    assert [r.c for r in got] == [["abcd", "defg", "ghij"], [], []]


def test_pages_join_and_chunks_know_their_page(spark):
    pages = spark.createDataFrame([("a", 2, "Segunda página con texto."), ("a", 1, "USO\nPrimera página."), ("b", 1, "Otra.")], "doc string, page int, text string")
    joined = chunking.join_pages(pages)
    assert {r.doc: r.text for r in joined.collect()} == {"a": "USO\nPrimera página.\n\nSegunda página con texto.", "b": "Otra."}
    rows = chunking.chunks(joined, 25, 5).orderBy("doc", "chunk_no").collect()
    assert [(r.doc, r.page, r.section) for r in rows] == [("a", 1, "USO"), ("a", 2, "USO"), ("b", 1, None)]
    assert rows[0].text == "[a > USO]\nUSO\nPrimera página." and rows[0].header == "a > USO"


def test_chunks_stay_within_size_and_overlap():
    text = "Frase de prueba con palabras. " * 60
    assert all(len(c["body"]) <= 260 for c in chunking.chunk_text(text, "d", size=200, overlap=20))


@pytest.mark.parametrize("text", ["", "  \n\n ", None])
def test_blank_documents_have_no_chunks(spark, text):
    assert chunking.chunks(spark.createDataFrame([("d", text)], "doc string, text string")).count() == 0
