"""Sharding by extendible hashing: only what is too large splits on another bit. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.llm.common import materialize

#: Bytes of text that a shard may hold.
SHARD_BYTES = 16 << 20
#: Bits that one pass over the rows looks at; hashes have BITS in all.
STRIDE = 12
BITS = 60


def _hash_bits(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text, as '0' and '1' from the highest bit on."""
    digest = F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))), 1, BITS // 4)
    return F.lpad(F.conv(digest, 16, 2), BITS, "0")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """rows (bits, size) -> (prefix, depth, shard_bytes, shard_docs): the leaves of the directory.

    A leaf is the shortest prefix whose rows fit the limit, or whose rows all have one hash. One pass sums the
    rows by their next STRIDE bits; all depths follow from these sums. Only prefixes that are still too large
    are looked at again, with the next bits.
    """
    leaves = None
    open_rows, done = rows, 0
    while True:
        upto = min(done + STRIDE, BITS)
        sums = open_rows.groupBy(F.substring("bits", 1, upto).alias("cell")).agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("bits").alias("low"), F.max("bits").alias("high"))
        depths = F.explode(F.sequence(F.lit(done), F.lit(upto))).alias("depth")
        nodes = sums.select("*", depths).groupBy(F.substring("cell", F.lit(1), F.col("depth")).alias("prefix"), "depth").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        nodes = nodes.withColumn("fits", (F.col("b") <= limit) | (F.col("low") == F.col("high")) | (F.col("depth") == BITS))
        nodes = materialize(nodes)
        parents = nodes.filter(~F.col("fits")).select(F.col("prefix").alias("parent"), F.col("depth").alias("above"))
        top = nodes.filter("fits").join(parents, (F.substring("prefix", F.lit(1), F.col("depth") - 1) == F.col("parent")) & (F.col("depth") - 1 == F.col("above")), "left")
        found = top.filter(F.col("parent").isNotNull() | (F.col("depth") == 0)).select("prefix", "depth", F.col("b").alias("shard_bytes"), F.col("n").alias("shard_docs"))
        leaves = found if leaves is None else leaves.unionByName(found)
        large = nodes.filter(~F.col("fits") & (F.col("depth") == upto)).select(F.col("prefix").alias("too_large"))
        if upto == BITS or large.isEmpty():
            return leaves
        open_rows = materialize(open_rows.join(large, F.substring("bits", 1, upto) == F.col("too_large"), "left_semi"))
        done = upto


def shard(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_bytes, shard, depth, shard_bytes, shard_docs), a row per row.

    The shard is named by its prefix bits, '' if everything fits in one. A null text has no bytes. Rows with the same id
    and text share a hash and so a shard; such a shard, or a single text above the limit, can't be split and is
    larger. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = materialize(docs.select("doc_id", F.octet_length(text).cast("bigint").alias("size"), _hash_bits(F.col("doc_id"), F.col("text")).alias("bits")))
    leaves = materialize(directory(rows, limit))
    depths = sorted(r.depth for r in leaves.select("depth").distinct().collect())  # at most BITS + 1 numbers
    if not depths:
        return rows.select("doc_id", F.col("size").alias("n_bytes"), F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("shard_bytes"), F.lit(0).cast("bigint").alias("shard_docs"))
    # each row meets exactly one leaf: of the prefixes at the depths in use, one is a leaf
    tried = rows.select("doc_id", "size", F.explode(F.array(*[F.substring("bits", 1, d) for d in depths])).alias("prefix")) if len(depths) > 1 else rows.select("doc_id", "size", F.substring("bits", 1, depths[0]).alias("prefix"))
    return tried.join(leaves, "prefix").select("doc_id", F.col("size").alias("n_bytes"), F.col("prefix").alias("shard"), "depth", "shard_bytes", "shard_docs")


ORACLE_SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         right(repeat('0', 60) || bin(CAST('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 15) AS BIGINT)), 60) AS bits
  FROM documents
), s AS (
  SELECT doc_id, n_bytes, bits, 0 AS depth, '' AS shard, false AS leaf, CAST(NULL AS BIGINT) AS shard_bytes, CAST(NULL AS BIGINT) AS shard_docs FROM r
  UNION ALL
  SELECT doc_id, n_bytes, bits, CASE WHEN ok THEN depth ELSE depth + 1 END, CASE WHEN ok THEN shard ELSE substr(bits, 1, depth + 1) END, ok, b, n
  FROM (SELECT *, CAST(sum(n_bytes) OVER p AS BIGINT) AS b, CAST(count(*) OVER p AS BIGINT) AS n,
               sum(n_bytes) OVER p <= {SHARD_BYTES} OR min(bits) OVER p = max(bits) OVER p OR depth = 60 AS ok
        FROM s WHERE NOT leaf WINDOW p AS (PARTITION BY shard))
)
SELECT doc_id, n_bytes, shard, depth, shard_bytes, shard_docs FROM s WHERE leaf
"""
