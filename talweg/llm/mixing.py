"""Mixing sources to target weights: hash histograms find nested budget thresholds; nothing is sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.llm.common import materialize

#: Weights of the sources in code-point order, repeating; null is last.
WEIGHTS = (3, 1, 2)
#: Words that all sources share, as a part of all words there are.
SHARE = 1.5
#: No target is above so many times its source.
MOST = 2
#: Sources whose thresholds are broadcast at most. The rows of more sources are dealt by source and salt.
BROADCAST_SOURCES = 100_000
SALTS = 64
#: A hash has HASH_BITS bits; a histogram looks at STRIDE of them.
HASH_BITS = 60
STRIDE = 10


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("bigint")


def place(doc_id: Column, text: Column) -> Column:
    """Where a document stands in its source's order, in 0 .. 2^60 - 1: the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text, F.lit(6)), 64 - HASH_BITS)


def with_sources(rows: DataFrame, sources: DataFrame, row_place: Column, how: str = "inner") -> DataFrame:
    """rows (source, ...) joined with a few columns by source (__s), so that no source's rows meet in one task.

    A broadcast behind a count; beyond it each source's row is repeated for every salt, and rows are salted by their place.
    """
    same = rows["source"].eqNullSafe(F.col("__s"))
    if sources.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), same, how)
    salted = sources.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, same & (F.pmod(row_place, F.lit(SALTS)).cast("int") == F.col("__salt")), how).drop("__salt")


def targets(sized: DataFrame) -> DataFrame:
    """rows (source, size) -> (source, source_size, target), a row per source.

    Sources share by weight; those above their cap get the cap and the others share again, until none is above.
    What the driver sees is one row of sums each time.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # the distinct sources only
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    sources = materialize(sums.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size")))
    budget = SHARE * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        seen = sources.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("cap"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if seen.n == capped or not seen.weight:
            return sources.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))
        capped, level = seen.n, max(level, (budget - seen.cap) / seen.weight)


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, place, size), (source, source_size, target) -> wanted with copies and below.

    A source's documents are all taken ``copies`` times, and those with a place under ``below`` once more. The
    budgets are nested: what a smaller one takes, a larger one takes too. Each pass sums the sizes by the next
    STRIDE bits of the place, within the bucket that the budget ends in only, until that bucket holds one place.
    """
    state = wanted.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    state = state.withColumn("need", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("acc", F.lit(0).cast("bigint")).withColumn("prefix", F.lit(0).cast("bigint")).withColumn("below", F.when(F.col("need") <= 0, F.lit(0).cast("bigint")))
    state = materialize(state)
    inside, used = rows, 0
    while used < HASH_BITS:
        used += STRIDE
        rest = HASH_BITS - used
        sums = inside.groupBy("source", F.shiftright("place", rest).alias("bucket")).agg(F.sum("size").alias("b"), F.count_distinct("place").alias("n") if rest == 0 else F.when(F.min("place") == F.max("place"), 1).otherwise(2).alias("n"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("before", F.sum("b").over(run) - F.col("b"))
        open_ = state.filter("below IS NULL")
        met = sums.join(open_.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        # the bucket in which the need is reached; one per source
        met = met.filter((F.col("acc") + F.col("before") <= F.col("need")) & (F.col("acc") + F.col("before") + F.col("b") > F.col("need")))
        at = F.col("acc") + F.col("before")
        nearer = at + F.col("b") - F.col("need") < F.col("need") - at
        found = met.select("s", "bucket", at.alias("at"), F.when((F.col("n") == 1) | F.lit(rest == 0), F.shiftleft(F.col("bucket") + nearer.cast("bigint"), rest)).alias("cut"))
        joined = state.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
        # sums that never exceed the need: everything is within it
        last = F.when(F.col("s").isNull() & F.col("bucket").isNull() & F.col("below").isNull(), F.lit(1 << HASH_BITS))
        state = materialize(joined.select("source", "source_size", "target", "copies", "need", F.coalesce("at", "acc").alias("acc"), F.coalesce("bucket", "prefix").alias("prefix"), F.coalesce("below", "cut", last).alias("below")))
        undecided = state.filter("below IS NULL").select(F.col("source").alias("__s"), F.col("prefix").alias("__prefix"))
        if undecided.isEmpty():
            break
        inside = with_sources(inside, undecided, F.col("place")).filter(F.shiftright("place", rest) == F.col("__prefix")).drop("__s", "__prefix")
    return state.select("source", "source_size", "target", "copies", "below")


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' (doc_id, source, place, size), and what thresholds() says of their sources."""
    rows = materialize(docs.select("doc_id", "source", place(F.col("doc_id"), F.col("text")).alias("place"), words(F.col("text")).alias("size")))
    return rows, thresholds(rows, targets(rows))


def _copies() -> Column:
    return F.col("copies") + (F.col("place") < F.col("below")).cast("int")


def mix(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source, ...) -> (doc_id, size, source_size, target, copies, taken), a row per row.

    A null text has no words; null is a source of its own. Rows with equal id and text have one place and are
    taken together. A source without words has target 0. An empty table gives no rows; other columns are ignored.
    """
    rows, found = plan(docs)
    met = with_sources(rows, found.withColumnRenamed("source", "__s"), F.col("place")).withColumn("copies", _copies())
    return met.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: rows that are taken twice come twice, others once or not at all.

    All columns stay. A null text has no words and comes as often as its place says; null is a source of its own; rows with
    equal id and text share a place and a fate; an empty table gives no rows. Texts aren't shuffled.
    """
    _, found = plan(docs)
    found = found.select(F.col("source").alias("__s"), F.col("copies").alias("__copies"), F.col("below").alias("__below"))
    own = place(docs["doc_id"], docs["text"])
    met = with_sources(docs, found, own)
    times = F.col("__copies") + (own < F.col("__below")).cast("int")
    return met.withColumn("__time", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).select(*[docs[c] for c in docs.columns])
