"""Sessions, history, admission in batch and stream, catalogue, validation, context, evaluation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from talweg.functions import text as T
from talweg.operators import admission, catalog, context, evaluation, sessions, validation
from talweg.streaming import admission as streaming
from talweg.streaming import windows

T0 = dt.datetime(2024, 1, 1)


def requests(spark, times, key="a"):
    return spark.createDataFrame([(i, key, T0 + dt.timedelta(seconds=t)) for i, t in enumerate(times)], "event_id long, key string, ts timestamp")


@pytest.mark.parametrize(
    "limits, times, admitted",
    [
        (((2, 60),), (0, 1, 2, 61), (True, True, False, True)),
        (((2, 60),), (0, 1, 60), (True, True, False)),
        (((2, 60), (3, 86_400)), (0, 1, 100, 200, 90_000), (True, True, True, False, True)),
        (((1, 60),), (0, 30, 61), (True, False, True)),
    ],
)
def test_admission(spark, limits, times, admitted):
    rows = admission.admit(requests(spark, times), limits).orderBy("event_id").collect()
    assert tuple(r.admitted for r in rows) == admitted and all((r.wait == 0) == r.admitted for r in rows)


def test_wait_is_until_the_oldest_leaves(spark):
    assert [r.wait for r in admission.admit(requests(spark, (0, 10)), ((1, 60),)).orderBy("event_id").collect()] == [0, 51]


def test_two_levels_name_who_refused(spark):
    rows = requests(spark, range(5)).withColumn("ip", F.lit("x")).withColumn("sid", F.when(F.col("event_id") < 2, "s").otherwise("t"))
    got = admission.admit_in_turn(rows, "ip", "sid", ((4, 60),), ((1, 60),)).orderBy("event_id").collect()
    assert [r.refused_by for r in got] == [None, "sid", None, "sid", "ip"]


def test_stream_admits_as_the_batch_does(spark, tmp_path):
    rows = requests(spark, (0, 1, 2, 61, 62)).unionByName(requests(spark, (0, 5), "b").withColumn("event_id", F.col("event_id") + 10))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = streaming.admit_stream(stream, ((2, 60),)).writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    key = lambda r: (r.event_id, r.key, r.admitted, r.wait)
    assert sorted(map(key, spark.table("admitted").collect())) == sorted(map(key, admission.admit(rows, ((2, 60),)).collect()))


def test_windows_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1, T0 + dt.timedelta(hours=h)) for i, h in enumerate((0, 1, 30, 100))], "event_id long, user_id long, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df in (("per_day", windows.counts(stream, "1 day")), ("by_gap", windows.sessions(stream))):
        df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(120)
    assert sorted(r.n for r in spark.table("per_day").collect()) == [1, 1, 2]
    assert sorted(r.events for r in spark.table("by_gap").collect()) == [1, 1, 2]


def test_history_keeps_the_last_turns_of_each_session(spark):
    turns = spark.createDataFrame([(s, i, "user", f"{s}{i}") for s in "ab" for i in range(5)], "session_id string, turn_id long, role string, text string")
    assert sorted(r.text for r in sessions.last_turns(turns, 3).collect()) == ["a2", "a3", "a4", "b2", "b3", "b4"]


def test_gate_and_expiry(spark):
    known = spark.createDataFrame([("ok", 95.0, 1), ("old", 1.0, 1), ("full", 99.0, 5)], "session_id string, seen_at double, messages long")
    asked = spark.createDataFrame([("ok",), ("old",), ("full",), ("new",)], "session_id string")
    got = {r.session_id: r.status for r in sessions.gate(asked, known, F.lit(100.0), ttl=50, cap=5).collect()}
    assert got == {"ok": "ok", "old": "expired", "full": "capped", "new": "missing"}
    assert [r.session_id for r in sessions.expired(known, F.lit(51.0), 50).collect()] == []


@pytest.mark.parametrize("name, valid", [("docs", True), ("a-b_1", True), ("x" * 64, True), ("x" * 65, False), ("", False), ("-a", False), ("../x", False), ("a b", False), ("a\n", False), ("ñ", False), (None, False)])
def test_names(spark, name, valid):
    assert spark.createDataFrame([(name,)], "n string").select(catalog.is_name(F.col("n")).alias("v")).first().v is valid


def test_residents_of_the_cache(spark):
    trace = spark.createDataFrame(list(enumerate("abac")), "ts long, key string")
    assert [r.key for r in catalog.residents(trace, 2).collect()] == ["c", "a"]
    cache = catalog.FrameCache(lambda name: spark.range(1), 2)
    for name in "abac":
        cache.get(name)
    assert cache.names() == ["a", "c"]
    cache.clear()


@pytest.mark.parametrize("name, content, status", [("a.pdf", b"%PDF-1.7", "ok"), ("a.pdf", b"PK\x03\x04", "signature"), ("a.docx", b"PK\x03\x04..", "ok"), ("a.exe", b"MZ", "extension"), ("a.TXT", b"hola", "ok"), ("a.txt", b"a\x00b", "binary"), ("a.md", b"", "empty"), ("noext", b"x", "extension")])
def test_uploads(spark, name, content, status):
    assert spark.createDataFrame([(name, bytearray(content))], "n string, c binary").select(validation.upload_status(F.col("n"), F.col("c")).alias("s")).first().s == status


def test_signed_sessions(spark):
    sid = "0" * 32
    good = validation.signed(sid, "k")
    rows = spark.createDataFrame([(good,), (good[:-1] + "x",), ("abc",), (None,), (validation.signed("zz", "k"),)], "c string").select(validation.verified(F.col("c"), "k").alias("s")).collect()
    assert [r.s for r in rows] == [sid, None, None, None, None]


def test_prompt_context_deletes_marks_and_numbers_blocks(spark):
    questions = spark.createDataFrame([(1, "q"), (2, "r")], "query_id int, text string")
    found = spark.createDataFrame([(1, 2, "dos"), (1, 1, f"uno{context.END}")], "query_id int, rank int, text string")
    got = {r.query_id: r.context for r in context.prompt_context(questions, found, numbered=True).collect()}
    assert got[1].count(context.END) == 1 and "[1] uno\n\n[2] dos" in got[1] and context.NOTHING_FOUND in got[2]


def test_legend_leaves_out_what_is_missing(spark):
    found = spark.createDataFrame([(1, 1, "a.pdf", 3, "Uso"), (1, 2, None, None, None)], "query_id int, rank int, source string, page int, section string")
    assert context.source_legend(found).first().legend == "Fuentes:\n  [1] a.pdf, p. 3 (Uso)\n  [2] documento desconocido"


def test_first_line_and_json(spark):
    row = spark.createDataFrame([('\n  "hola" \nx', "```json\n{\"a\": 1}\n```", "nada")], "a string, b string, c string").select(T.first_line(F.col("a"), F.lit("-")).alias("a"), T.fenced_json(F.col("b")).alias("b"), T.fenced_json(F.col("c")).alias("c"), T.log_key(F.lit("")).alias("k")).first()
    assert (row.a, row.b, row.c, row.k) == ("hola", '{"a": 1}', None, "-")


def test_recall_and_reciprocal_rank(spark):
    rows = spark.createDataFrame([("positive", 1), (None, 2), ("positive", None), ("negative", 1)], "kind string, position int")
    got = evaluation.recall_mrr(rows).first()
    assert (got.positives, got.negatives, got.recall, got.mrr) == (3, 1, 0.666667, 0.5)


def test_judged_metrics_skip_nulls(spark):
    rows = spark.createDataFrame([("positive", True, None, 8.0, None), ("positive", False, None, None, None), ("negative", None, None, None, True), ("negative", None, None, None, False)], "kind string, faithful boolean, answers boolean, grade double, refuses boolean")
    got = evaluation.judge_metrics(rows).first()
    assert (got.faithfulness, got.answered, got.mean_grade, got.refusal_rate) == (0.5, None, 8.0, 0.5)


def test_relevance_needs_a_criterion_and_all_declared_ones(spark):
    rows = [("El peso es 215 g", "a", 1, "PESO  es", None, None, True), ("x", "a", 1, None, None, None, False), ("x", "a", 1, "", "a", None, True), ("x", "a", 1, None, "a", 2, False), ("x", "a", 0, None, None, 0, True)]
    df = spark.createDataFrame(rows, "t string, s string, p int, e string, d string, ep int, want boolean")
    assert df.filter(evaluation.is_relevant(*map(F.col, ("t", "s", "p", "e", "d", "ep"))) != F.col("want")).count() == 0


def test_refusals_and_grid(spark):
    got = spark.createDataFrame([("Lo siento, NO  dispongo de eso.",), ("Pesa 215 g",), (None,)], "a string").select(evaluation.is_refusal(F.col("a")).alias("r")).collect()
    assert [r.r for r in got] == [True, False, False]
    assert len(evaluation.chunk_sizes()) == 6
