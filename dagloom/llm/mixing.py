"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document gets a 60-bit hash. Sizes are summed by source and hash bucket; a running sum over
a source's buckets finds the bucket in which its budget is reached; only that boundary bucket is
split again by the next bits, until the hash is used up. A document is taken if its hash lies
below its source's threshold, so nothing is sorted, and a larger budget takes a superset.

Defined results: a null text has size 0; a null source is a source of its own, the last; a source
of size 0 has target 0 and nothing is taken of it; rows that share doc_id and text share a hash
and are taken or left together, ties of the hash likewise; a very long text is one document of
its size; an empty table gives an empty result. Input columns beyond
doc_id, text and source are ignored by `mix` and kept by `sample_mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dagloom.session import cut

HASH_BITS = 60
STEP = 12
#: the table of sources is broadcast up to this number of rows, else joined by a shuffle
BROADCAST_SOURCES = 20_000
WEIGHTS = (5, 2, 1)
REPEAT_CAP = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(seed: int) -> Column:
    """Non-negative, of HASH_BITS bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", F.col("__crc")), 64 - HASH_BITS)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = REPEAT_CAP) -> DataFrame:
    """sizes (source, source_size) to (source, source_size, target).

    Sources in code-point order (null last) weigh weights[0], weights[1], ... again and again, and
    share the whole size. A target stops at cap times its source's size; the excess is shared
    among the others by weight until none is above. With v = cap * size / weight, exactly the
    sources of smallest v stop: going up by v, one stops if it is above its share of what is left.
    """
    # ranks over the distinct sources: one row a source, not a document
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("__w", w).withColumn("__v", cap * F.col("source_size") / F.col("__w"))
    up = Window.orderBy("__v", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap * F.col("source_size")).over(up), F.lit(0))
    left_w = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(up), F.lit(0.0))
    rate = ranked.withColumn("__rate", left / left_w).withColumn("__stops", F.col("__v") < F.col("__rate"))
    # the rate of the first that does not stop holds for all after it
    free = F.min(F.when(~F.col("__stops"), F.struct("__v", "__rate"))).over(everything)["__rate"]
    return rate.withColumn("__free", free).select(
        "source",
        "source_size",
        F.when(F.col("__stops"), F.col("source_size") * F.lit(float(cap))).otherwise(F.col("__w") * F.col("__free")).alias("target"),
    )


def _per_source(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """rows with the columns of their source; a null source meets the null source."""
    small = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    rows, small = rows.withColumn("__s", F.struct("source")), small.withColumn("__s", F.struct("source")).drop("source")
    return rows.join(small, "__s").drop("__s")


def thresholds(rows: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """(source, below): documents of source with __h < below sum to about `budget`.

    rows: source, __h, size. budgets: source, budget. Each level sums sizes by source and bucket
    of the rows still in a boundary bucket; map-side sums make a hot source as cheap as any.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("__from"))
    shift = HASH_BITS
    while shift > 0:
        high, shift = shift, max(0, shift - STEP)
        inside = _per_source(rows, state, n_sources).where(
            F.shiftright("__h", high) == F.shiftright("__from", high) if high < HASH_BITS else F.lit(True)
        )
        sums = inside.groupBy("source", F.shiftright("__h", shift).alias("__b")).agg(F.sum("size").alias("__n"))
        sums = _per_source(sums, state, n_sources)
        run = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("__upto", F.sum("__n").over(run))
        # all buckets that fit as a whole stay below; the next one is the boundary
        fits = F.col("__upto") <= F.col("budget")
        found = sums.groupBy("source").agg(
            F.min(F.when(~fits, F.struct("__b", "__n"))).alias("__edge"),
            F.max(F.when(fits, F.col("__upto"))).alias("__used"),
        )
        joined = _per_source(state, found, n_sources)
        # where all fits, the threshold is the end of the range and stays there
        end = F.shiftleft(F.shiftright("__from", high) + 1, high) if high < HASH_BITS else F.lit(1 << HASH_BITS)
        left = F.col("budget") - F.coalesce("__used", F.lit(0))
        # rows of one full hash can't be split: they are in if that comes nearer to the budget
        nearer = ((F.col("__edge.__n") - left) < left).cast("long") if shift == 0 else F.lit(0)
        edge = F.when(F.col("__edge").isNotNull(), F.shiftleft("__edge.__b", shift) + nearer).otherwise(end)
        state = cut(
            joined.select(
                "source",
                left.alias("budget"),
                edge.cast("long").alias("__from"),
            ).unionByName(
                state.join(found.select(F.struct("source").alias("__s")), F.struct(state["source"]) == F.col("__s"), "left_anti")
            )
        )
    return state.select("source", F.col("__from").alias("below"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = REPEAT_CAP, seed: int = 8) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document: `taken` is its size times the
    whole repeats of its source's target, plus once more below the source's threshold."""
    rows, plan, n_sources = _plan(docs, weights, cap, seed)
    taken = F.col("size") * _times(F.col("size"), F.col("whole"), F.col("__h"), F.col("below"), cap)
    return _per_source(rows, plan, n_sources).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def sample_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = REPEAT_CAP, seed: int = 8) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as the mix takes it."""
    _, plan, n_sources = _plan(docs, weights, cap, seed)
    # names of the plan's columns can't clash with those of docs
    slim = plan.select("source", F.col("whole").alias("__whole"), F.col("below").alias("__below"))
    rows = docs.withColumns({"__size": n_words(F.col("text")), "__crc": _crc()}).withColumn("__h", _hash(seed))
    times = _times(F.col("__size"), F.col("__whole"), F.col("__h"), F.col("__below"), cap)
    taken = _per_source(rows, slim, n_sources).withColumn("__times", times).where(F.col("__times") > 0)
    return taken.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def _crc() -> Column:
    return F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _times(size: Column, whole: Column, h: Column, below: Column, cap: int) -> Column:
    return F.when(size > 0, F.least(whole + (h < below).cast("int"), F.lit(cap))).otherwise(0).cast("int")


def _plan(docs: DataFrame, weights: Sequence[float], cap: int, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, source, size, __h) of every row; (source, source_size, target, whole, below) of
    every source; the number of sources."""
    hashed = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _crc().alias("__crc"))
    rows = cut(hashed.select("doc_id", "source", "size", _hash(seed).alias("__h")))
    sources = cut(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    n_sources = sources.count()
    ratio = F.col("target") / F.col("source_size")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(ratio), F.lit(cap))).otherwise(0).cast("int")
    sources = sources.withColumn("whole", whole)
    budgets = sources.select("source", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long").alias("budget"))
    below = thresholds(rows, budgets, n_sources)
    return rows, sources.withColumn("__s", F.struct("source")).join(below.select(F.struct("source").alias("__s"), "below"), "__s").drop("__s"), n_sources


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
