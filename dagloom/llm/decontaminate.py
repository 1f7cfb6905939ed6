"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on the hashes of all their k-word shingles (the seeds).
Seeds of a document and an item that follow each other on one diagonal are one maximal match.
Tiling marks the longest match, cuts what is left of the others around the marked words, and goes
on until no match of k words is left: the running Karp-Rabin search finds nothing else, since any
match of k words consists of seeds. An item whose words are covered by tiles to a share of
`coverage` is in the document, in whatever order its passages stand there.

Words are runs of letters and digits with A-Z lower-cased, so case and punctuation do not matter.

Defined results: null or empty texts and items of fewer than k words share nothing; very long texts
are searched whole; of matches that tie in length the one first in the item, then in the document, is
marked first; rows that share a doc_id (or item_id) are compared each by its own text, equal rows
once; extra columns are ignored. Seeds are 64-bit hashes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.llm.tokens import ALNUM, U64, batches_of, free_memory, list_array, windows, word_hashes

K = 4
COVERAGE = 0.5
#: seeds of the benchmark are broadcast up to this number, and other shingles of documents never become
#: rows; beyond it both sides are shuffled
BROADCAST_SEEDS = 200_000
#: bits of a hash that a table of the known seeds is indexed by
LOW = U64((1 << 22) - 1)


def _seeds(rows: DataFrame, k: int, only: np.ndarray | None = None) -> DataFrame:
    """(id, text_hash, n_words, at, seed): the k-word shingles of all rows, one a row; if `only` (ascending
    hashes) is given, those among it, so that nothing else leaves the Arrow batches."""

    def run(it):
        known = np.zeros(int(LOW) + 1, bool)
        if only is not None:
            known[(only & LOW).astype(np.int64)] = True
        for batch, texts in batches_of(it):
            starts, ends, counts = texts.words(ALNUM)
            h, at = windows(word_hashes(texts.buf, starts, ends, lower=True), counts, k)
            sizes = np.maximum(counts - k + 1, 0)
            doc = np.repeat(np.arange(len(counts)), sizes)
            at = at - (np.cumsum(counts) - counts)[doc]
            if only is not None:
                on = np.flatnonzero(known[(h & LOW).astype(np.int64)])  # a bit table spares most lookups
                on = on[only[np.minimum(np.searchsorted(only, h[on]), len(only) - 1)] == h[on]]
                h, at, doc = h[on], at[on], doc[on]
            some, sizes = np.unique(doc, return_counts=True)
            kept = pa.array(some)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(kept), batch.column(1).take(kept), pa.array(counts[some], pa.int64()), list_array(at.astype(np.int32), sizes, pa.int32()), list_array(h.view(np.int64), sizes, pa.int64())],
                names=["id", "text_hash", "n_words", "places", "seeds"],
            )
        free_memory()

    lists = rows.mapInArrow(run, "id long, text_hash long, n_words long, places array<int>, seeds array<long>")
    return lists.select("id", "text_hash", "n_words", F.inline(F.arrays_zip(F.col("places").alias("at"), F.col("seeds").alias("seed"))))


def _rows(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))


def tile(doc_at: list[int], item_at: list[int], k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of seeds (doc_at[i], item_at[i]): tiles (in the document, in the item,
    words), the longest first; ties go to the place that comes first in the item, then in the document."""
    runs: list[tuple[int, int, int]] = []  # (-words, item, doc)
    before = None
    for diagonal, d in sorted({(d - i, d) for d, i in zip(doc_at, item_at, strict=True)}):
        if before == (diagonal, d - 1):
            length, i0, d0 = runs[-1]
            runs[-1] = (length - 1, i0, d0)
        else:
            runs.append((-k, d - diagonal, d))
        before = (diagonal, d)
    heapq.heapify(runs)
    used_doc: set[int] = set()
    used_item: set[int] = set()
    tiles = []
    while runs:
        length, i0, d0 = heapq.heappop(runs)
        free = [i0 + j not in used_item and d0 + j not in used_doc for j in range(-length)]
        if all(free):
            tiles.append((d0, i0, -length))
            used_item.update(range(i0, i0 - length))
            used_doc.update(range(d0, d0 - length))
            continue
        start = None
        for j, ok in enumerate([*free, False]):
            if ok and start is None:
                start = j
            elif not ok and start is not None:
                if j - start >= k:
                    heapq.heappush(runs, (start - j, i0 + start, d0 + start))
                start = None
    return tiles


FOUND = "doc_id long, text_hash long, item_id long, item_words long, covered long, n_tiles int, doc_starts array<int>, item_starts array<int>, lengths array<int>"


def overlaps(docs: DataFrame, benchmark: DataFrame, k: int = K) -> DataFrame:
    """FOUND rows: the tiles of every document and item that share a seed."""
    items = _seeds(_rows(benchmark, "item_id").dropDuplicates(["id", "text_hash"]), k)
    seeds = items.select(F.col("id").alias("item_id"), F.col("text_hash").alias("item_hash"), F.col("n_words").alias("item_words"), F.col("at").alias("i"), "seed")
    n_seeds = seeds.count()
    few = n_seeds <= BROADCAST_SEEDS
    right = F.broadcast(seeds) if few else seeds
    # at most BROADCAST_SEEDS hashes of the benchmark come to the driver and go out with the function
    only = np.sort(seeds.select("seed").distinct().toArrow()["seed"].to_numpy().view(U64)) if few else None
    left = _seeds(_rows(docs, "doc_id"), k, only).select(F.col("id").alias("doc_id"), "text_hash", F.col("at").alias("d"), "seed")
    # a pair's seeds are bounded by the two texts; equal rows give equal seeds, kept once
    pairs = left.join(right, "seed").groupBy("doc_id", "text_hash", "item_id", "item_hash", "item_words").agg(F.collect_set(F.struct("d", "i")).alias("at"))

    def run(it):
        for batch in it:
            rows = []
            for at in batch.column(4).to_pylist():
                tiles = sorted(tile([x["d"] for x in at], [x["i"] for x in at], k))
                rows.append((sum(t[2] for t in tiles), len(tiles), [t[0] for t in tiles], [t[1] for t in tiles], [t[2] for t in tiles]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), *[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]],
                names=[x.split(" ")[0] for x in FOUND.split(", ")],
            )

    return pairs.select("doc_id", "text_hash", "item_id", "item_words", "at").mapInArrow(run, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, coverage: float = COVERAGE) -> DataFrame:
    """FOUND rows whose tiles cover the item's words to the share `coverage` or more."""
    return overlaps(docs, benchmark, k).where(F.col("covered") >= F.lit(coverage) * F.col("item_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, coverage: float = COVERAGE) -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    # nulls are equal to nulls inside a struct
    leaks = contaminated(docs, benchmark, k, coverage).select(F.struct("doc_id", "text_hash").alias("__row")).distinct()
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    return docs.withColumn("__row", own).join(leaks, "__row", "left_anti").drop("__row")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark).select(
        "doc_id",
        "item_id",
        "item_words",
        F.col("covered").alias("covered_words"),
        (F.col("covered") / F.col("item_words")).alias("coverage"),
        "n_tiles",
        F.array_join(F.transform(F.arrays_zip("doc_starts", "item_starts", "lengths"), lambda t: F.concat_ws(":", t["doc_starts"], t["item_starts"], t["lengths"])), ",").alias("tiles"),
    )
