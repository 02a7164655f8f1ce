"""Settings, collections, rerankers, history stores, streams of answers, upload names."""

import time

import pytest
from pyspark.sql import functions as F

from talweg.operators import answering, catalog, context, evaluation, fusion, indexing, validation
from talweg.settings import Settings, flag, whole
from talweg.sources import files, tables
from talweg.streaming.indexing import maintain


def test_settings():
    assert [flag(x) for x in ("1", "Sí", " ON ", "no", "", None)] == [True, True, True, False, False, False] and flag(None, True)
    assert (whole(" 7 ", 1), whole("x", 1), whole(None, 2)) == (7, 1, 2)
    read = Settings.read({"TALWEG_MODE": "lexical", "TALWEG_CHUNK_SIZE": "500", "TALWEG_SCORERS": "a, b", "TALWEG_RERANK": "yes", "TALWEG_TOP": "many"})
    assert (read.mode, read.index.chunk_size, read.scorers, read.rerank, read.top) == ("lexical", 500, ("a", "b"), True, 4)
    with pytest.raises(ValueError):
        Settings.read({"TALWEG_MODE": "other"})


def test_collections(spark, tmp_path):
    found = catalog.Collections(spark, str(tmp_path / "data"), size=1)
    assert found.names() == [] and found.create("one") and not found.create("one") and found.create("two") and found.exists("one")
    for name in ("..", "a/b", "", None, "ñ", "one\n"):
        with pytest.raises(ValueError):
            found.create(name)
    (tmp_path / "data" / "one" / "docs" / "a.txt").write_text("USO\nUna frase. Otra frase.")
    (tmp_path / "data" / "two" / "docs" / "b.txt").write_text("Texto dos.")
    assert found.reindex("one")["new"] == 1 and found.reindex("one")["pending"] == 0 and found.reindex("one", force=True)["new"] == 1 and found.reindex("two")["new"] == 1
    assert found.chunks("one").first().section == "USO" and found.chunks("two").count() == 1 and found.cache.names() == ["two"]
    assert found.delete("two") and found.names() == ["one"] and found.cache.names() == []


def test_listing_has_a_row_a_document(spark):
    docs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("-bad", "w"), (None, "v")], "collection string, document string")
    got = sorted(map(tuple, catalog.listing(docs, docs.filter("collection = 'a'")).collect()))
    assert got == [("a", "x", 2, True), ("a", "y", 2, True), ("b", "z", 1, False)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc string, text string")


def test_versions_of_an_index(spark, tmp_path):
    index = indexing.Index(spark, str(tmp_path / "index"))
    assert index.manifest() is None and index.chunks() is None and index.stale(frame(spark, [("a", "x")]))
    rows = [(f"d{i}", f"Texto {i}. " * 5) for i in range(30)]
    index.build(frame(spark, rows))
    assert not index.stale(frame(spark, rows)) and index.stale(frame(spark, rows[:3]))
    first = {p.name for p in (tmp_path / "index" / "data" / "1").iterdir() if p.name.startswith("bucket")}
    counts = index.build(frame(spark, [("d0", "Otro.")] + rows[1:]))
    second = {p.name for p in (tmp_path / "index" / "data" / "2").iterdir() if p.name.startswith("bucket")}
    assert counts["buckets"] == 1 == len(second) and second <= first and (counts["changed"], counts["unchanged"]) == (1, 29)
    assert {r.doc for r in index.chunks().collect()} == {d for d, _ in rows}
    ordered = [(r.doc, r.chunk_no) for r in index.ordered_chunks().orderBy("chunk_id").collect()]
    assert ordered == sorted(ordered) and [r.chunk_id for r in index.ordered_chunks().orderBy("chunk_id").collect()] == list(range(30))
    index.update(frame(spark, [("new", "Nuevo.")]))
    assert index.chunks().count() == 31 and index.manifest().count() == 31
    # a build that ends before its configuration is written leaves the last version
    (tmp_path / "index" / "commits" / "4" / "manifest").mkdir(parents=True)
    (tmp_path / "index" / "data" / "4").mkdir()
    assert index.versions() == [1, 2, 3] and index.chunks().count() == 31
    index.vacuum()
    assert index.versions() == [3] and index.chunks().count() == 31 and not (tmp_path / "index" / "data" / "4").exists()
    # a corrupt manifest is none
    for p in (tmp_path / "index" / "commits" / "3" / "manifest").glob("*.parquet"):
        p.write_bytes(b"broken")
    for p in (tmp_path / "index" / "commits" / "3" / "manifest").glob(".*.crc"):
        p.unlink()
    assert index.manifest() is None
    assert index.build(frame(spark, rows))["new"] == 30 and index.manifest().count() == 30
    assert index.build(frame(spark, []))["removed"] == 30 and index.chunks().count() == 0
    index.delete()
    assert index.manifest() is None


def test_a_stream_keeps_an_index(spark, tmp_path):
    index = indexing.Index(spark, str(tmp_path / "index"))
    source = tmp_path / "in"
    schema = "doc string, text string, at int"
    spark.createDataFrame([("a", "Uno.", 1), ("a", "Dos.", 2), ("b", "Tres.", 1)], schema).write.mode("append").json(str(source))
    run = lambda: maintain(spark.readStream.schema(schema).json(str(source)), index, str(tmp_path / "state")).awaitTermination()
    run()
    assert {(r.doc, r.body) for r in index.chunks().collect()} == {("a", "Dos."), ("b", "Tres.")}
    spark.createDataFrame([("b", "Cuatro.", 2)], schema).write.mode("append").json(str(source))
    run()
    assert {(r.doc, r.body) for r in index.chunks().collect()} == {("a", "Dos."), ("b", "Cuatro.")}


def turns(spark, *rows):
    return spark.createDataFrame([(s, i, "user", t, None) for s, i, t in rows], tables.TURN_SCHEMA)


def test_history_is_appended_replaced_and_deleted(spark, tmp_path):
    store = tables.History(spark, str(tmp_path / "h"))
    texts = lambda s: [r.text for r in store.load(s).collect()]
    assert texts("a") == []
    store.append(turns(spark, ("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")))
    store.append(turns(spark, ("a", 3, "w")))
    assert texts("a") == ["x", "y", "w"] and texts("b") == ["z"]
    store.replace(turns(spark, ("a", 1, "new")))
    assert texts("a") == ["new"] and texts("b") == ["z"]
    store.delete(turns(spark, ("a", 0, "")))
    assert texts("a") == []
    store.append(turns(spark, ("a", 9, "again")))
    assert texts("a") == ["again"]


def test_json_history(spark, tmp_path):
    path = str(tmp_path / "history.json")
    assert tables.load_json_history(spark, path).count() == 0
    for text in ("hola", "adiós"):
        tables.save_json_history(spark.createDataFrame([(2, "model", text), (1, "user", "¿?")], "turn_id long, role string, text string"), path)
    assert [r.text for r in tables.load_json_history(spark, path).collect()] == ["¿?", "adiós"]
    (tmp_path / "bad.json").write_text('{"turn_id": 1, "role"')
    assert tables.load_json_history(spark, str(tmp_path / "bad.json")).count() == 0


def test_cases_must_be_there(spark, tmp_path):
    (tmp_path / "empty.json").write_text("[]")
    for name in ("empty.json", "missing.json"):
        with pytest.raises(ValueError):
            tables.cases(spark, str(tmp_path / name))


def test_files_without_names_or_text(spark):
    rows = spark.createDataFrame([(None, b"x"), ("a.pdf", b"%PDF-broken"), ("b.txt", None), ("c.TXT", "hóla".encode()), ("noext", b"x")], "doc string, content binary")
    assert [(r.doc, r.text) for r in files.extract(rows).collect()] == [("c.TXT", "hóla")]
    assert files.scanned(b"", lambda _: [(1, " leído "), (2, " ")]) == [(1, "leído")] and files.scanned(b"", None) == []
    assert files.scanned(b"", lambda _: 1 / 0) == []


def test_scorers_fall_back(spark, monkeypatch):
    def broken(question, texts):
        raise RuntimeError("down")

    def slow(question, texts):
        time.sleep(5)
        return [(0, 1.0)]

    monkeypatch.setattr(fusion, "SCORERS", {"broken": broken, "slow": slow, "longest": lambda q, ts: sorted(((i, float(len(t))) for i, t in enumerate(ts)), key=lambda x: -x[1]) + [(99, 1.0)], "none": lambda q, ts: []})
    rows = spark.createDataFrame([(1, f"d{i}", i + 1, "x" * i) for i in range(5)] + [(2, "e", 1, None)], "query_id int, doc_id string, rank int, text string")
    questions = spark.createDataFrame([(1, "q"), (2, None)], "query_id int, text string")
    order = lambda *names, **more: [r.doc_id for r in fusion.reranked(rows, questions, names, 2, **more).filter("query_id = 1").orderBy("final_rank").collect()]
    assert order("longest") == ["d4", "d3"] == order("broken", "longest") and order("none", "broken") == ["d0", "d1"]
    assert fusion.asked("q", ["a"], [slow], seconds=0.05) == []
    with pytest.raises(ValueError):
        fusion.reranked(rows, questions, ["unheard"], 2)
    assert fusion.parsed_ranking('```json\n[{"id": 2, "score": 0.5}, 1, "x"]\n```') == [(2, 0.5), (1, -1.0)]
    with pytest.raises(ValueError):
        fusion.parsed_ranking("no idea")


def test_streams_are_repeated_only_before_their_first_piece():
    calls = []

    def busy_first():
        calls.append(1)
        if len(calls) == 1:
            raise answering.Busy
        yield from "ab"

    assert list(answering.streamed(busy_first, sleep=lambda _: None)) == ["a", "b"]

    def busy_later():
        yield "a"
        raise answering.Busy

    got = []
    with pytest.raises(answering.Busy):
        for piece in answering.streamed(busy_later, sleep=lambda _: None):
            got.append(piece)
    assert got == ["a"]


def test_embedding_for_a_task(spark):
    embed = lambda texts, task=None: [[1.0, 0.0] if task == "query" else [0.0, 2.0] for _ in texts]
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "doc_id string, text string")
    assert {tuple(r.embedding) for r in answering.embedded(rows, embed, task="query", workers=2).collect()} == {(1.0, 0.0)}
    assert {tuple(r.embedding) for r in answering.embedded(rows, embed).collect()} == {(0.0, 1.0)}


def test_names_and_prompts():
    assert len({validation.stored_name("a.PDF") for _ in range(5)}) == 5 and validation.stored_name("x/y.PDF").endswith(".pdf") and "." not in validation.stored_name("a.exe")
    assert len(validation.new_session_id()) == 32 and len(validation.correlation_id()) == 12
    assert context.BEGIN in context.system_prompt() and "[2]" in context.system_prompt() and "[2]" not in context.system_prompt(numbered=False)


def test_latency_and_order_of_a_sweep(spark):
    rows = spark.createDataFrame([("a", "positive", 1, 10.0), ("a", "negative", None, 30.0), ("b", None, None, 5.0)], "m string, kind string, position int, latency_ms double")
    got = evaluation.by_mrr(evaluation.recall_mrr(rows, ("m",)), "m").collect()
    assert [(r.m, r.mrr, r.mean_latency_ms) for r in got] == [("a", 1.0, 20.0), ("b", 0.0, 5.0)]


def test_chunk_sweep_chunks_anew(spark):
    body = "Frase número {} de relleno para el índice. "
    docs = spark.createDataFrame([("d", "".join(body.format(i) for i in range(200)) + "La clave es azul."), ("e", "Nada.")], "doc string, text string")
    cases = spark.createDataFrame([(1, "clave azul", "la clave es azul"), (2, "inexistente", "no está")], "query_id int, text string, expected string")
    rows = evaluation.chunk_sweep(cases, docs).collect()
    assert {(r.chunk_size, r.chunk_overlap) for r in rows} == set(evaluation.chunk_sizes()) and len({r.chunks for r in rows}) > 2
    assert all(r.recall == 0.5 and r.mrr == 0.5 for r in rows)
