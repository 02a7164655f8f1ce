"""Vector arithmetic on array columns, and the offline embedder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.text import tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalized(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n)))[0]


def bucket(token: Column, dimensions: int) -> Column:
    """Where the offline embedder counts a token."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 4), 16, 10).cast("int") % dimensions


def hashed(docs: DataFrame, key: str, dimensions: int) -> DataFrame:
    """(key, text) -> (key, bucket, value): sparse unit vectors of hashed token counts.

    The offline stand-in of an embedding model: same text, same vector, and texts that share words are close.
    """
    counts = docs.select(key, F.explode(tokens(F.col("text"))).alias("token")).groupBy(key, bucket(F.col("token"), dimensions).alias("bucket")).agg(F.count("*").alias("tf"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("length"))
    return counts.join(norms, key).select(key, "bucket", (F.col("tf") / F.col("length")).alias("value"))
