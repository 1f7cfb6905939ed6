"""Uniform sharding by a hypergeometric communication matrix.

Rows are dealt to partitions by a hash of doc_id and text, and counted; a row that is repeated more often than a
partition should hold is dealt to several. The matrix of how many rows of each
partition go to each shard is drawn from the exact (multivariate hypergeometric) law of a uniform
shuffle, with shard sizes at most one apart. A partition permutes its rows by a random key and
cuts them by its row of the matrix; after the exchange each shard permutes again, in cells of a
second key's top bits, so that no shard is ever sorted in one task.

Defined results: a null text counts as empty (size 8, crc 0); a null doc_id is an id like any
other; repeated rows are dealt like any others, and as they are equal their order does not matter (how many
of a row repeated very often go to which partition depends on the input's files);
ties of random keys go by id and crc; a very long text counts by its size and does not travel; an empty table gives an empty result; columns
beyond doc_id and text are ignored by `shard_rows` and kept by `assign`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dagloom.session import cut

SHARDS = 24
#: rows for each partition and each cell, and the most partitions (which bounds the matrix)
ROWS_PER_PARTITION = 4096
MOST_PARTITIONS = 4096
#: a partition of so many times its rows is looked into
HOT = 4


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows: partitions; columns: shards. Row sums are `counts`; column sums at most one apart."""
    rng = np.random.Generator(np.random.PCG64(seed))
    total = sum(counts)
    free = np.full(shards, total // shards, np.int64)
    free[: total % shards] += 1
    out = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        # colour by colour: of the free places of the shards from s on, n are drawn
        left, places = n, int(free.sum())
        for s in range(shards):
            mine = int(free[s])
            out[p, s] = _hypergeometric(rng, mine, places - mine, left)
            left -= out[p, s]
            places -= mine
        free -= out[p]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    # beyond the generator's range: invert the law around its mode, from the ratios of
    # neighbouring probabilities; 40 standard deviations each way leave out nothing that a double sees
    total = good + bad
    mode = min(good, n, (n + 1) * (good + 1) // (total + 2))
    reach = int(40 * np.sqrt(n * (good / total) * (bad / total)) + 40)
    k = np.arange(max(0, n - bad, mode - reach), min(good, n, mode + reach) + 1, dtype=np.float64)
    ratio = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    weight = np.concatenate([[0.0], np.cumsum(ratio)])
    weight = np.exp(weight - weight.max())
    return int(k[min(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), "right"), len(k) - 1)])


def _key(seed: int, *more: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.col("__id"), F.col("__crc"), *more)


def _deal(rows: DataFrame, n: int, parts: int, seed: int, rows_per_partition: int) -> tuple[DataFrame, dict[int, int]]:
    """rows (of n) with their partition, and each partition's number of rows. A hash keeps equal rows
    together; of a row that alone fills a partition twice over, occurrences are dealt in turn."""
    rows = rows.withColumn("__part", F.pmod(_key(seed), F.lit(parts)).cast("int"))
    counts = dict(rows.groupBy("__part").count().collect())  # at most MOST_PARTITIONS rows
    full = max(2 * n // parts, HOT * rows_per_partition)
    crowded = [p for p, c in counts.items() if c > full]
    if not crowded:
        return rows, counts
    often = rows.where(F.col("__part").isin(crowded)).groupBy(F.col("__id").alias("__i"), F.col("__crc").alias("__c")).agg(F.count(F.lit(1)).alias("__often"))
    # proven bound: fewer than half as many such rows as partitions
    often = F.broadcast(often.where(F.col("__often") > full))
    turn = F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("__often") / rows_per_partition))
    part = F.when(F.col("__often").isNull(), F.col("__part")).otherwise(F.pmod(_key(seed, turn), F.lit(parts)).cast("int"))
    turned = rows.join(often, rows["__id"].eqNullSafe(F.col("__i")) & (rows["__crc"] == F.col("__c")), "left")
    # turns go by the place in the input, so they are written before they are counted
    rows = cut(turned.withColumn("__part", part).drop("__i", "__c", "__often"))
    return rows, dict(rows.groupBy("__part").count().collect())


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = 10, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """docs with columns shard (int) and slot (long, gapless from 0 in each shard); columns of
    these names are replaced."""
    docs = docs.drop("shard", "slot")
    return _assign(docs, shards, seed, rows_per_partition).select(*docs.columns, "shard", F.col("slot").cast("long").alias("slot"))


def _assign(docs: DataFrame, shards: int, seed: int, rows_per_partition: int) -> DataFrame:
    n = docs.count()
    parts = max(1, min(MOST_PARTITIONS, -(-n // rows_per_partition)))
    cells = max(1, -(-n // (shards * rows_per_partition)))
    bytes_of = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.withColumns({"__id": F.col("doc_id"), "__crc": F.crc32(bytes_of)})
    rows, counts = _deal(rows, n, parts, seed, rows_per_partition)
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    upto = np.cumsum(matrix, axis=1)
    spark = docs.sparkSession
    # proven bound: MOST_PARTITIONS rows of `shards` longs
    table = F.broadcast(spark.createDataFrame([(p, upto[p].tolist()) for p in range(parts)], "__part int, __upto array<long>"))
    # equal rows are told apart by a number, or they would stay side by side; one exchange by
    # partition serves both windows
    equal = Window.partitionBy("__part", "__id", "__crc").orderBy("__crc")
    numbered = rows.repartition("__part").withColumn("__o", F.row_number().over(equal))
    local = Window.partitionBy("__part").orderBy(_key(seed + 1, F.col("__o")), "__id", "__crc", "__o")
    dealt = numbered.withColumn("__r", F.row_number().over(local).cast("long")).join(table, "__part")
    dealt = dealt.withColumn("shard", F.size(F.filter("__upto", lambda x: x < F.col("__r"))).cast("int"))
    again = F.shiftrightunsigned(_key(seed + 2, F.col("__r")), 1)
    # uniform in [0, cells): the top bits of the second key
    dealt = dealt.withColumn("__key", again).withColumn("__cell", F.floor(F.shiftrightunsigned("__key", 32) * F.lit(cells) / F.lit(float(1 << 31))).cast("int"))
    dealt = dealt.drop("__upto", "__part", "__o")
    sizes = dealt.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy("shard", "__cell").orderBy("__key", "__id", "__crc", "__r")
    return dealt.withColumn("__slot", F.row_number().over(inside) - 1).join(starts, ["shard", "__cell"]).withColumn("slot", F.col("__start") + F.col("__slot"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = 10, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; the text itself
    does not travel."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    slim = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    slim = cut(slim)
    keyed = slim.withColumn("text", F.col("text_crc32").cast("string"))
    return _assign(keyed, shards, seed, rows_per_partition).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
