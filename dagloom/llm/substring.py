"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted across the
corpus; repeated windows merge into maximal removal intervals.

Defined results: a null or empty text has no words and keeps the empty text; a document shorter
than the window loses nothing; rows that share a doc_id are one document and never remove each
other's words; a null doc_id counts as the largest id. Columns other than doc_id and text are
ignored. A very long text is one document, compared whole; texts that
tie in doc_id are put in order of their bytes. Two different windows share a 64-bit hash with
probability 2**-59 at most.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.llm import blocks as B
from dagloom.llm.tokens import Texts, windows, word_hashes

SCHEMA = "doc_id long, n_words long, n_removed long, starts array<int>, ends array<int>, kept_text string"


def _hashed(texts: Texts, size: int):
    starts, ends, counts = texts.words()
    return counts, *windows(word_hashes(texts.buf, starts, ends), counts, size)


def repeated_windows(docs: DataFrame, size: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """For each document the maximal intervals [starts, ends) of words that lie in a window of
    `size` words which also starts in a document with a smaller doc_id, and the text without
    them (kept words joined by one space)."""
    layout = B.plan_layout(docs, block_bytes)
    bits = layout.bits
    packed = B.pack(docs, layout)

    def emit(table: pa.Table) -> pa.Table:
        _, texts = B.unpack(table)
        _, h, _ = _hashed(texts, size)
        return B.key_rows(table["block"][0].as_py(), np.unique(h), bits)

    def reduce(table: pa.Table) -> pa.Table:
        def seen_before(keys, place, _):
            order = np.argsort(keys, kind="stable")  # blocks ascend, so the first of a key is in its first block
            k = keys[order]
            out = np.empty(len(keys), bool)
            out[order] = np.concatenate([[False], k[1:] == k[:-1]])
            return out

        return B.answer_rows(table, seen_before)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = B.unpack(table)
        counts, h, at = _hashed(texts, size)
        total = int(counts.sum())
        end = np.cumsum(counts)
        begin = end - counts
        word_id = np.repeat(ids, counts)
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        gone = B.answers_of(keys, bits, answers, bool)[which] | (word_id[at] > word_id[at[first]][which])
        steps = np.zeros(total + 1, np.int64)
        gone_at = at[gone]
        np.add.at(steps, gone_at, 1)
        np.add.at(steps, gone_at + size, -1)
        covered = np.cumsum(steps)[:-1] > 0
        sums = np.concatenate([[0], np.cumsum(covered)])
        n_removed = sums[end] - sums[begin]
        head = np.zeros(total + 1, bool)
        head[begin] = True
        padded = np.concatenate([[False], covered, [False]])
        starts = np.flatnonzero(padded[1:] & (~padded[:-1] | head))
        ends = np.flatnonzero(padded[:-1] & (~padded[1:] | head))
        per_doc = np.diff(np.searchsorted(starts, np.concatenate([begin, [total]])))
        base = np.repeat(begin, per_doc)
        kept = []
        for i in range(len(ids)):
            words = texts.bytes_of(i).split()
            if n_removed[i]:
                words = itertools.compress(words, (~covered[begin[i] : end[i]]).tolist())
            kept.append(b" ".join(words))
        offsets = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32)
        spans = [pa.ListArray.from_arrays(pa.array(offsets), pa.array((x - base).astype(np.int32))) for x in (starts, ends)]
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=ids == B.NULL_ID),
                "n_words": pa.array(counts, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "starts": spans[0],
                "ends": spans[1],
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    keys = packed.groupBy("block").applyInArrow(emit, B.KEYS)
    answers = keys.groupBy("bucket").applyInArrow(reduce, B.ANSWERS)
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, SCHEMA)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_windows(docs, size=13).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


#: the contract on whole tables; windows of 13 words are compared by value
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS win
  FROM d, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13
), m AS (SELECT win, min(doc_id) AS first_id FROM g GROUP BY win),
c AS (
  SELECT DISTINCT g.doc_id, k FROM g JOIN m ON g.win = m.win AND m.first_id < g.doc_id, unnest(range(g.i, g.i + 13)) AS t(k)
), r AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(coalesce(gone, [])) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(coalesce(gone, []), k)), lambda k: w[k]), ' ')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
