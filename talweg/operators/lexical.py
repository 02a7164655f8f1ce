"""Lexical search: term statistics and BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.text import tokens

K1, B = 1.5, 0.75
#: Tokens of all queries that are broadcast at most; the tokens of documents meet more of them in a shuffle.
BROADCAST_TOKENS = 1_000_000
#: No token is empty: this one marks a document as such.
DOCUMENT = ""


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, token, tf)."""
    return docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """(n_docs, n_tokens, avgdl)."""
    sized = docs.select(F.size(tokens(F.col("text"))).cast("bigint").alias("dl"))
    return sized.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"), F.avg("dl").alias("avgdl"))


def _idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def terms(docs: DataFrame) -> DataFrame:
    """(token, df, idf) of the whole vocabulary."""
    n = docs.agg(F.count("*").alias("n_docs"))
    df = term_frequencies(docs).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", _idf(F.col("n_docs"), F.col("df")).alias("idf"))  # one row


def bm25(queries: DataFrame, docs: DataFrame, top: int | None = None) -> DataFrame:
    """(query_id, text), (doc_id, text) -> (query_id, doc_id, score[, rank]).

    The texts are tokenized once: their tokens meet the queries' distinct tokens before anything is shuffled, and one row a
    document, marked by the empty token, carries its length. Corpus statistics, document frequencies and scores
    all read that one shuffle, so none of them filters on its columns. A token that a query repeats counts
    repeatedly; unknown tokens vanish. Ties are broken by doc_id on scores of six decimals.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    few = asked.count() <= BROADCAST_TOKENS
    wanted = asked.select(F.coalesce("token", F.lit(DOCUMENT)).alias("token")).distinct()
    wanted = wanted.unionByName(queries.sparkSession.range(1).select(F.lit(DOCUMENT).alias("token")))
    sized = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    words = sized.select("doc_id", F.size("words").alias("dl"), F.explode(F.concat(F.array(F.lit(DOCUMENT)), "words")).alias("token"))
    words = words.withColumn("token", F.coalesce("token", F.lit(DOCUMENT)))
    tf = words.join(F.broadcast(wanted) if few else wanted, "token", "left_semi").groupBy("doc_id", "dl", "token").agg(F.count("*").alias("tf"))
    whole = F.when(F.col("token") == DOCUMENT, F.col("tf"))
    stats = tf.agg(F.sum(whole).alias("n_docs"), (F.sum(whole * F.col("dl")) / F.sum(whole)).alias("avgdl"))
    df = tf.groupBy("token").agg(F.count_if(F.col("tf") > 0).alias("df")).crossJoin(F.broadcast(stats)).withColumn("idf", _idf(F.col("n_docs"), F.col("df")))  # one row
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = df.join(asked, "token")
    weighed = F.broadcast(weighed) if few else weighed  # a row for each token of each query
    scored = tf.join(weighed, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    return scored if top is None else ranked(scored, top)


def ranked(scored: DataFrame, top: int, score: str = "score") -> DataFrame:
    """The best rows of each query, numbered from 1."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
