"""The registered queries of the engine's own operators, over the whole test tables."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from talweg.functions import text as T
from talweg.functions.vectors import l2_normalized
from talweg.operators import admission, bulk, catalog, chunking, context, dense, evaluation, fusion, indexing, lexical, retrieval, sessions, validation
from talweg.session import shared_folder, table
from talweg.sources.html import visible_text

#: The questions of the search queries: one repeats a word, one has an unknown word.
QUESTIONS = ((1, "the thing and enble"), (2, "that that erst"), (3, "Nicht schein, der"), (4, "qué ciónez los"), (5, "xyzzy eau des"))
#: The vector searches ask for every row whose id is divisible by this, against all rows.
EVERY = 50
DAY = 86_400
LIMITS = ((2, 3600), (3, DAY))


_t = table


def _docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "text")


def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id int, text string")


def _cases(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _turns(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_id"), "role", "text")


def _events(spark, sf_dir):
    return _t(spark, sf_dir, "events")


def tokens(spark, sf_dir):
    words = _docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


def term_freq(spark, sf_dir):
    return lexical.term_frequencies(_docs(spark, sf_dir))


def bm25_terms(spark, sf_dir):
    return lexical.terms(_docs(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(_docs(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


def bm25_topk(spark, sf_dir):
    return lexical.bm25(_questions(spark), _docs(spark, sf_dir), retrieval.TOP)


def _exact(spark, sf_dir, top):
    rows = _t(spark, sf_dir, "embeddings")
    return dense.by_blocks(rows, EVERY, lambda ids, matrix: dense.exact_topk(rows, matrix, ids, top))


def _approximate(spark, sf_dir, top):
    rows = _t(spark, sf_dir, "embeddings")
    index = dense.CodeIndex.ready(rows, f"{shared_folder(spark)}/codes-{sha256(sf_dir.encode()).hexdigest()[:16]}")
    return dense.by_blocks(rows, EVERY, lambda ids, matrix: index.topk(rows, matrix, ids, top))


def dense_topk(spark, sf_dir):
    return _exact(spark, sf_dir, retrieval.CANDIDATES)


def ann_topk(spark, sf_dir):
    return _approximate(spark, sf_dir, retrieval.CANDIDATES)


def ann_recall(spark, sf_dir):
    """Recall at 4, and the part of the rows that are scored by their vectors."""
    rows = _t(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull()).agg(F.count("*").alias("n"))
    found = dense.recall(_exact(spark, sf_dir, retrieval.TOP), _approximate(spark, sf_dir, retrieval.TOP))
    return found.crossJoin(F.broadcast(rows)).select("recall", "queries", F.least(F.lit(1.0), F.lit(dense.SHORTLIST * retrieval.TOP) / F.col("n")).alias("scored"))  # one row


def l2_norm(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(l2_normalized(F.col("embedding"))).alias("place", "value"))
    return rows.select("vec_id", "place", F.round("value", 6).alias("value"))


def _two_rankings(spark, sf_dir):
    return dense_topk(spark, sf_dir).select(F.lit(1).alias("query_id"), F.col("query_id").alias("source"), "rank", F.col("vec_id").alias("doc_id"))


def rrf_fusion(spark, sf_dir):
    return lexical.ranked(fusion.fuse(_two_rankings(spark, sf_dir)), retrieval.CANDIDATES)


def _scored(spark, sf_dir):
    return dense_topk(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")


def threshold_adaptive(spark, sf_dir):
    return fusion.cut_adaptive(_scored(spark, sf_dir))


def threshold_fixed(spark, sf_dir):
    return fusion.cut_fixed(_scored(spark, sf_dir), 0.4)


def hybrid_search(spark, sf_dir):
    return retrieval.retrieve(_questions(spark), _docs(spark, sf_dir))


def normalize_eval(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize_eval(F.col("text")).alias("plain"))


def _relevance(spark, sf_dir):
    cases, docs = _cases(spark, sf_dir), _docs(spark, sf_dir)
    found = lexical.bm25(cases, docs, retrieval.CANDIDATES).select("query_id", "doc_id", "rank")
    none = F.lit(None)
    met = found.join(docs, "doc_id").join(cases.withColumnRenamed("text", "expected"), "query_id")
    return met.select("query_id", "doc_id", "rank", evaluation.is_relevant(F.col("text"), none, none, F.col("expected"), none, none.cast("int")).alias("hit"))


def relevance(spark, sf_dir):
    return _relevance(spark, sf_dir)


def eval_recall_mrr(spark, sf_dir):
    cases = _cases(spark, sf_dir).select("query_id").withColumn("kind", F.lit("positive"))
    return evaluation.recall_mrr(evaluation.first_hits(cases, _relevance(spark, sf_dir)))


def eval_judge_metrics(spark, sf_dir):
    met = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return evaluation.judge_metrics(met.select(F.when(F.col("lang") == "en", "positive").otherwise("negative").alias("kind"), (F.col("quality") == 1).alias("faithful"), (F.col("quality") == 1).alias("answers"), F.col("quality").cast("double").alias("grade"), (F.col("toxic") == 1).alias("refuses")))


def sweep(spark, sf_dir):
    """Modes x top_k x thresholds: one pass over the documents for all modes, the rest are filters of its rows."""
    cases, docs = _cases(spark, sf_dir), _docs(spark, sf_dir)
    found = bulk.rankings(cases, docs, retrieval.CANDIDATES, retrieval.DIMENSIONS)  # nothing is cut yet
    near = docs.join(F.broadcast(found.select("doc_id").distinct()), "doc_id", "left_semi")  # the candidates of the cases
    fused = lexical.ranked(fusion.fuse(found), retrieval.CANDIDATES).select("query_id", "doc_id", "rank")
    hybrid = retrieval.cosines(fused, cases, near).withColumn("mode", F.lit("hybrid"))
    runs = found.withColumn("score", F.when(F.col("mode") == "dense", F.col("score"))).unionByName(hybrid)
    best = F.max("score").over(Window.partitionBy("mode", "query_id"))
    runs = runs.withColumn("floor", F.greatest(F.lit(fusion.FLOOR), fusion.MARGIN * best))
    expected = cases.select("query_id", T.normalize_eval(F.col("text")).alias("expected"))
    pairs = found.select("query_id", "doc_id").distinct().join(expected, "query_id")
    met = near.select("doc_id", T.normalize_eval(F.col("text")).alias("plain")).join(F.broadcast(pairs), "doc_id")
    hits = met.filter(F.coalesce(F.contains("plain", "expected"), F.lit(False))).select("query_id", "doc_id")  # else Spark normalizes all documents, to leave out nulls
    marked = runs.join(hits.withColumn("hit", F.lit(True)), ["query_id", "doc_id"], "left")
    grid = spark.createDataFrame([(m, k, u) for m in evaluation.MODES for k in evaluation.TOP_KS for u in evaluation.THRESHOLDS], "mode string, top_k int, threshold double")
    kept = marked.join(F.broadcast(grid), "mode").filter(F.col("score").isNull() | (F.col("score") >= F.coalesce("threshold", "floor")))  # 60 rows
    place = F.row_number().over(Window.partitionBy("mode", "top_k", "threshold", "query_id").orderBy("rank", "doc_id"))
    firsts = kept.withColumn("place", place).filter("place <= top_k AND hit").groupBy("mode", "top_k", "threshold", "query_id").agg(F.min("place").alias("position"))
    n = cases.agg(F.count("*").alias("n"))
    sums = firsts.groupBy("mode", "top_k", "threshold").agg(F.count("*").alias("found"), F.sum(1.0 / F.col("position")).alias("rr"))
    same = (F.col("g.mode") == F.col("s.mode")) & (F.col("g.top_k") == F.col("s.top_k")) & F.col("g.threshold").eqNullSafe(F.col("s.threshold"))
    met = grid.alias("g").join(sums.alias("s"), same, "left").select("g.mode", "g.top_k", "g.threshold", "s.found", "s.rr").crossJoin(F.broadcast(n))  # one row
    rows = met.select("mode", "top_k", F.coalesce(F.col("threshold").cast("string"), F.lit("adaptive")).alias("threshold"), F.round(F.coalesce("found", F.lit(0)) / F.col("n"), 6).alias("recall"), F.round(F.coalesce("rr", F.lit(0.0)) / F.col("n"), 6).alias("mrr"))
    return evaluation.by_mrr(rows, "mode", "top_k", "threshold")


def chunk_sweep(spark, sf_dir):
    """Chunking parameters, each with all documents chunked anew and the benchmark's passages searched for. Times vary, so they aren't returned."""
    cases = _cases(spark, sf_dir).withColumn("expected", F.col("text"))
    return evaluation.chunk_sweep(cases, _named(spark, sf_dir)).drop("latency_ms")


def refusals(spark, sf_dir):
    return _turns(spark, sf_dir).select("session_id", "turn_id", evaluation.is_refusal(F.col("text")).alias("refusal"))


def section_titles(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.inline(chunking.sections(F.col("text"))))
    return rows.select("doc_id", F.col("start").cast("bigint").alias("start"), "title")


def asof_section(spark, sf_dir):
    """The section at every 500th character."""
    found = _docs(spark, sf_dir).filter(F.length("text") > 0).select("doc_id", F.length("text").alias("n"), chunking.sections(F.col("text")).alias("s"))
    return chunking.asof_rows(found, F.sequence(F.lit(0), F.col("n") - 1, F.lit(500)))



def units(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.units(F.col("text"))).alias("unit_no", "unit"))


def fixed_chunks(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.fixed_chunks(F.col("text"))).alias("chunk_no", "chunk"))


def _named(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")


def chunks(spark, sf_dir):
    return chunking.chunks(_named(spark, sf_dir))


def chunks_per_doc(spark, sf_dir):
    docs = _named(spark, sf_dir)
    return indexing.chunks_per_document(docs, docs.select("doc", F.explode(chunking.fixed_chunks(F.col("text")))))


def chunk_order(spark, sf_dir):
    """Fixed chunks numbered over the whole corpus, by document and number."""
    rows = _named(spark, sf_dir).select("doc", F.posexplode(chunking.fixed_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return indexing.numbered(rows, "doc", "chunk_no").select("chunk_id", "doc", "chunk_no", F.length("chunk").alias("length"))


def doc_fingerprint(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", indexing.fingerprint(F.col("text")).alias("hash"))


def _old_manifest(spark, sf_dir):
    """A former state: the labelled documents, those of low quality with another content, and the benchmark's items."""
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    old = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc"), indexing.fingerprint(F.when(F.col("quality") == 1, F.col("text")).otherwise("")).alias("hash"))
    return old.unionByName(_t(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("doc"), indexing.fingerprint(F.col("text")).alias("hash")))


def index_diff(spark, sf_dir):
    now = _docs(spark, sf_dir).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc"), indexing.fingerprint(F.col("text")).alias("hash"))
    return indexing.difference(now, _old_manifest(spark, sf_dir))


def index_reusable(spark, sf_dir):
    """The manifest's counts are those of the stored chunks, but for documents labelled toxic."""
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    stored = docs.select(F.col("doc_id").alias("doc"), F.coalesce("toxic", F.lit(0)).alias("toxic"), chunking.fixed_chunks(F.col("text")).alias("c"))
    manifest = stored.select("doc", (F.size("c") + F.col("toxic")).alias("n_chunks"))
    return indexing.reusable(stored.select("doc", F.explode("c").alias("chunk")), manifest)


def html_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", visible_text(F.col("html")).alias("text"))


def history_last_n(spark, sf_dir):
    return sessions.last_turns(_turns(spark, sf_dir))


def rewrite_context(spark, sf_dir):
    return context.rewrite_context(_turns(spark, sf_dir))


def turns_per_session(spark, sf_dir):
    return sessions.turns_per_session(_turns(spark, sf_dir))


def session_count(spark, sf_dir):
    return sessions.session_count(_turns(spark, sf_dir))


def _activity(spark, sf_dir):
    return sessions.session_activity(_events(spark, sf_dir).select(F.col("user_id").alias("session_id"), "ts"))


def session_activity(spark, sf_dir):
    return _activity(spark, sf_dir)


def _now(spark, sf_dir):
    return F.lit(_events(spark, sf_dir).agg(F.max(sessions.seconds(F.col("ts")))).first()[0])


def session_gate(spark, sf_dir):
    """Requests of the customers; the events' users have sessions."""
    asked = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"))
    return sessions.gate(asked, _activity(spark, sf_dir), _now(spark, sf_dir), cap=60)


def expired_sessions(spark, sf_dir):
    return sessions.expired(_activity(spark, sf_dir), _now(spark, sf_dir), ttl=6 * 3600).select("session_id")


def user_sessions(spark, sf_dir):
    rows = sessions.split_by_inactivity(_events(spark, sf_dir).select("user_id", "event_id", "ts"))
    return rows.select("user_id", F.col("session_no").cast("bigint").alias("session_no"), sessions.seconds(F.col("started")).alias("started"), sessions.seconds(F.col("ended")).alias("ended"), "events")


def capped_messages(spark, sf_dir):
    return sessions.within_cap(_events(spark, sf_dir).select("user_id", "event_id", "ts"), 50).select("user_id", "event_id", F.col("n").cast("bigint").alias("n"))


def sliding_counts(spark, sf_dir):
    return sessions.sliding_counts(_events(spark, sf_dir), DAY)


def rate_limit(spark, sf_dir):
    return admission.admit(_events(spark, sf_dir).select("event_id", F.col("user_id").alias("key"), "ts"), LIMITS)


def _found(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    best = lexical.bm25(_questions(spark), docs, retrieval.TOP)
    return best.join(docs, "doc_id").select("query_id", "rank", "doc_id", "text")


def prompt_context(spark, sf_dir):
    return context.prompt_context(_questions(spark), _found(spark, sf_dir), numbered=True)


def source_legend(spark, sf_dir):
    rows = _found(spark, sf_dir).withColumn("section", F.try_element_at(chunking.sections(F.col("text")), F.lit(1))["title"])
    return context.source_legend(rows.select("query_id", "rank", F.col("doc_id").alias("source"), F.lit(1).alias("page"), "section"))


def first_line(spark, sf_dir):
    return _turns(spark, sf_dir).select("session_id", "turn_id", T.first_line(F.concat(F.lit(' \n "'), F.col("text"), F.lit('"')), F.lit("?")).alias("line"))


def llm_json(spark, sf_dir):
    answer = F.concat(F.lit("```json\nHere: "), F.col("props"), F.lit("\n```"))
    return _events(spark, sf_dir).select("event_id", T.fenced_json(answer).alias("json"))


def event_props(spark, sf_dir):
    props = _events(spark, sf_dir).select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return props.select("event_id", F.explode("m").alias("key", "value"))


def valid_names(spark, sf_dir):
    names = _t(spark, sf_dir, "documents").select(F.col("source").alias("name")).unionByName(_t(spark, sf_dir, "pages").select(F.substring_index("url", "/", -1).alias("name"))).unionByName(_t(spark, sf_dir, "part").select(F.col("p_name").alias("name")))
    return names.distinct().select("name", catalog.is_name(F.col("name")).alias("valid"))


def upload_validation(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select(F.concat(F.substring_index("url", "/", -1), F.lit("")).alias("name"), F.col("html").alias("content"), F.col("page_id").alias("id"))
    docs = _t(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".TXT")).alias("name"), F.col("text").alias("content"), F.col("doc_id").alias("id"))
    items = _t(spark, sf_dir, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(".pdf")).alias("name"), F.concat(F.lit("%PDF"), F.substring("text", 1, 1), F.col("text")).alias("content"), F.col("item_id").alias("id"))
    rows = pages.unionByName(docs).unionByName(items)
    return rows.select("name", "id", validation.upload_status(F.col("name"), F.col("content")).alias("status"))


def log_hash(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.log_key(F.col("url")).alias("key"))


def log_json(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.to_json(F.struct("event_id", "user_id", F.col("event_type").alias("evento"))).alias("line"))


def collections_listing(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("source").alias("collection"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("document"), "doc_id")
    indexed = docs.join(_t(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_semi")
    return catalog.listing(docs, indexed)


def lru_residents(spark, sf_dir):
    rows = catalog.residents(_events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts"))
    return rows.select("key", sessions.seconds(F.col("last_used")).alias("last_used"))


def rerank_merge(spark, sf_dir):
    """A scorer that prefers short texts and names one unknown document first."""
    docs = _docs(spark, sf_dir)
    candidates = lexical.bm25(_questions(spark), docs, retrieval.CANDIDATES).select("query_id", "doc_id", "rank")
    size = F.length("text").cast("double")
    order = Window.partitionBy("query_id").orderBy(size, "doc_id")
    scored = candidates.join(docs, "doc_id").select("query_id", "doc_id", F.row_number().over(order).alias("position"), size.alias("score_rerank"))
    strange = _questions(spark).select("query_id", F.lit(-1).cast("bigint").alias("doc_id"), F.lit(0).alias("position"), F.lit(0.0).alias("score_rerank"))
    return fusion.merge_rerank(candidates, scored.unionByName(strange), retrieval.TOP)


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_search, tokens, term_freq, bm25_terms, corpus_stats, bm25_topk, dense_topk, ann_topk, ann_recall, l2_norm, rrf_fusion, threshold_adaptive, threshold_fixed,
        normalize_eval, relevance, eval_recall_mrr, eval_judge_metrics, sweep, chunk_sweep, refusals, section_titles, asof_section, units, fixed_chunks, chunks, chunks_per_doc, chunk_order,
        doc_fingerprint, index_diff, index_reusable, html_text, history_last_n, rewrite_context, turns_per_session, session_count, session_activity, session_gate, expired_sessions,
        user_sessions, capped_messages, sliding_counts, rate_limit, prompt_context, source_legend, first_line, llm_json, event_props, valid_names, upload_validation,
        log_hash, log_json, collections_listing, lru_residents, rerank_merge,
    )
}
