"""Pluggable models: retry, rewriting, a turn, embedding, judging."""

import pytest
from pyspark.sql import functions as F

from talweg.operators import answering


def test_retry_waits_longer_and_gives_up():
    waits, left = [], [2]

    def busy():
        if left[0]:
            left[0] -= 1
            raise answering.Busy
        return "ok"

    assert answering.with_retry(busy, sleep=waits.append) == "ok" and waits[0] < waits[1]
    left[0] = 9
    with pytest.raises(answering.Busy):
        answering.with_retry(busy, sleep=waits.append)
    with pytest.raises(ZeroDivisionError):
        answering.with_retry(lambda: 1 / 0, sleep=waits.append)


def test_rewriting_is_only_a_help():
    seen = []
    generate = lambda p: seen.append(p) or '\n "¿Cuánto pesa la cámara?" \nnota'
    assert answering.rewritten("¿y pesa?", [], generate) == "¿y pesa?" and not seen
    history = [("user", f"t{i}") for i in range(10)]
    assert answering.rewritten("¿y pesa?", history, generate) == "¿Cuánto pesa la cámara?"
    assert "t3" not in seen[0] and "Usuario: t4" in seen[0]
    assert answering.rewritten("q", history, lambda p: 1 / 0) == "q" and answering.rewritten("q", history, lambda p: " ") == "q"


def test_a_turn_retrieves_with_the_rewrite_and_answers_the_question():
    asked, told = [], []
    talk = answering.Conversation(lambda q: asked.append(q) or "material", lambda p: told.append(p) or "respuesta")
    talk.ask("hola")
    talk.ask("¿y?")
    assert asked == ["hola", "respuesta"] and told[-1].endswith("¿y?") and len(talk.history) == 4
    for i in range(50):
        talk.ask(str(i))
    assert len(talk.history) == answering.HISTORY


def test_embedding_keeps_keys_and_unit_length(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(35)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.embedding for r in answering.embedded(rows, lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()}
    assert len(got) == 35 and all(abs(v[0] ** 2 + v[1] ** 2 - 1) < 1e-5 and abs(v[0] / v[1] - i) < 1e-3 for i, v in got.items())


def test_judges_may_fail(spark):
    rows = spark.createDataFrame([(1, "q", "c", "a"), (2, "q", "c", "boom"), (3, "q", "c", "odd")], "query_id int, text string, context string, answer string")
    verdicts = {"a": {"faithful": True, "answers": False, "grade": 7}, "odd": {"faithful": "yes", "grade": True}}
    got = {r.query_id: tuple(r)[1:] for r in answering.judged(rows, lambda q, c, a: verdicts[a]).collect()}
    assert got == {1: (True, False, 7.0), 2: (None, None, None), 3: (None, None, None)}


def test_client_address(spark):
    df = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "9.9.9.9"), (None, "9.9.9.9"), (None, None)], "f string, p string")
    pick = lambda trusted: [r.a for r in df.select(answering.client_address(F.col("f"), F.col("p"), trusted).alias("a")).collect()]
    assert pick(True) == ["1.2.3.4", "9.9.9.9", "-"] and pick(False) == ["9.9.9.9", "9.9.9.9", "-"]
