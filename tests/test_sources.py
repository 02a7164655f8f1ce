"""Extractors, the HTML expression, the incremental index, and the driver's entry points."""

import io
import zipfile

from pyspark.sql import functions as F

from talweg.operators.indexing import Index, IndexConfig, is_stale
from talweg.sources import files, html, tables

PAGE = "<html><head><title>t</title><meta charset=x></head><body><style>p{}</style><p>Hola &amp; <b>mundo</b></p><script>var a='</p>'</script><!-- no --><div>Fin</div></body></html>"


def docx(*paragraphs):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        body = "".join("<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in p) + "</w:p>" for p in paragraphs)
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return buffer.getvalue()


def test_html_text(spark):
    assert spark.createDataFrame([(PAGE,), (None,)], "h string").select(html.visible_text("h").alias("t")).collect()[0].t.split() == ["Hola", "&", "mundo", "Fin"]
    assert html.parsed_text("<meta charset=x><p>a</p>", strict_void=True) == "" and html.parsed_text("<meta charset=x><p>a</p>") == "a"
    assert html.parsed_text("&copy; &middot; &eacute;&#8217;&#x41; &nosuch; &amp;lt; a&nbsp;b &lt;p&gt;") == "© · é’A &nosuch; &lt; a\xa0b <p>"
    assert html.parsed_text("a<br/>b<br>c<!-- x -->d</div></script>e") == "a \n \n b \n c d \n e"
    assert html.parsed_text("<style>x<style>y</style>z</style>w") == "z w" and html.parsed_text("<script>never closed") == "" == html.parsed_text(None)
    assert html.parsed_text("<pre>a\n\n\n\nb</pre>") == "a\n\nb"


def test_files_of_every_kind(spark, tmp_path):
    for name, content in {"a.txt": b" hola ", "b.html": PAGE.encode(), "c.docx": docx(("Uno ", "dos"), ("",), ("tres",)), "d.docx": b"broken", "e.xlsx": b"x", "f.md": b"  "}.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "sub").mkdir()
    scanned = files.scan(spark, str(tmp_path))
    assert {r.doc for r in scanned.collect()} == {"a.txt", "b.html", "c.docx", "d.docx", "f.md"} and all(len(r.hash) == 64 for r in scanned.collect())
    got = {r.doc: r.text for r in files.extract(scanned).collect()}
    assert set(got) == {"a.txt", "b.html", "c.docx"} and got["a.txt"] == "hola" and got["c.docx"] == "Uno dos\n\ntres"


def test_index_is_built_incrementally(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    frame = lambda rows: spark.createDataFrame(rows, "doc string, text string")
    long = "Una frase bastante larga para trocear. " * 60
    assert index.build(frame([("a", long), ("b", "corto"), ("c", "")]))["pending"] == 3
    before = {(r.doc, r.chunk_no): r.text for r in index.chunks().collect()}
    assert index.build(frame([("a", long), ("b", "corto"), ("c", "")]))["pending"] == 1  # nothing to reuse of an empty document
    counts = index.build(frame([("a", long), ("b", "otro"), ("d", "nuevo")]))
    assert (counts["unchanged"], counts["changed"], counts["new"], counts["removed"], counts["pending"]) == (1, 1, 1, 1, 2)
    after = {(r.doc, r.chunk_no): r.text for r in index.chunks().collect()}
    assert {k: v for k, v in after.items() if k[0] == "a"} == {k: v for k, v in before.items() if k[0] == "a"} and ("b", 0) in after and not any(k[0] == "c" for k in after)
    assert {r.doc: r.n_chunks for r in index.manifest().collect()}["d"] == 1
    assert Index(spark, str(tmp_path / "index"), IndexConfig(chunk_size=500)).manifest() is None
    now = frame([("a", long)]).select("doc", F.sha2("text", 256).alias("hash"))
    assert is_stale(now, index.manifest())


def test_cases_are_read_with_a_fixed_schema(spark, tmp_path):
    (tmp_path / "cases.json").write_text('[{"id": "p1", "pregunta": "¿Peso?", "esperado": "215", "pagina": 2}, {"id": "n1", "tipo": "negativo", "pregunta": "x"}]', encoding="utf-8")
    got = {r.query_id: (r.kind, r.expected, r.page) for r in tables.cases(spark, str(tmp_path / "cases.json")).collect()}
    assert got == {"p1": ("positive", "215", 2), "n1": ("negative", None, None)}


def test_runs_and_logs_are_appended(spark, tmp_path):
    for _ in range(2):
        tables.append_run(spark.createDataFrame([(0.5, 3)], "recall double, cases int"), {"top_k": 4}, str(tmp_path / "runs"))
        tables.write_log(spark.createDataFrame([("chat", 1)], "evento string, n int"), str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "runs"), header=True).count() == 2
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ['{"evento":"chat","n":1}'] * 2


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
