"""License scans by diagonal voting.

All rolling word k-gram hashes of every document are joined to the positions of the same grams in
license templates. A match votes for its template's offset diagonal (document position minus
template position); a vote counts only if a second, independent hash proves the gram's words to be
the template's.
Neighbouring diagonals merge into one span, so inserted or dropped words do not break it. A span's
matches are then chained in the order of both texts, words skipped in either costing a part of a
match, and the span is reported if the best chain holds enough of the template; it reaches from the
chain's first word to its last. So scattered or shuffled grams of a template are no notice. Short
phrases are templates of which every gram must lie on one diagonal.

Defined results: a null or empty text has no words, places or labels and score 0; rows that share
a doc_id are scanned each on its own text, equal rows get equal results; very long texts are scanned
whole, a word of any length being one hash; of equally good chains the first counts, and all labels are reported; the table of templates is
broadcast, its size being fixed by the template list; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dagloom.llm.tokens import ALNUM, Texts, batches_of, rolling, windows, word_hashes

K = 2
#: diagonals at most so far apart belong to one span
BAND = 3
#: share of a template's grams that must be verified in a span, in order
COVERAGE = 0.5
#: what a word skipped in the document or the template costs a chain, in matches
SKIP = 0.1

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public notices, as word sequences; the label is the method's own.
NOTICES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-text": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-text": "this work is licensed under a creative commons attribution 4 0 international license",
    "mpl-text": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
}

GRAMS = "row long, pos int, gram long, proof long"


def _grams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """k-gram hashes, independent second hashes of the same grams, positions, number for each text."""
    starts, ends, counts = texts.words(ALNUM)
    h, at = windows(word_hashes(texts.buf, starts, ends, lower=True), counts, K)
    proof = rolling(word_hashes(texts.buf, starts, ends, lower=True, second=True), K)[at]
    n = np.maximum(counts - K + 1, 0)
    return h.view(np.int64), proof.view(np.int64), at - np.repeat(np.cumsum(counts) - counts, n), n


def template_grams() -> list[tuple[str, str, int, int, int, int]]:
    """(template, label, grams in it, position, hash, second hash) of every gram of every template."""
    out = []
    for name, label, text in [(p, lab, p) for p, lab in PHRASES.items()] + [(n, n, t) for n, t in NOTICES.items()]:
        h, proof, pos, n = _grams(Texts.of_list([text.encode()]))
        out += [(name, label, int(n[0]), p, x, y) for p, x, y in zip(pos.tolist(), h.tolist(), proof.tolist(), strict=True)]
    return out


def document_grams(docs: DataFrame) -> DataFrame:
    """GRAMS rows: every k-gram of every document."""

    def run(it):
        for batch, texts in batches_of(it, 1 << 20):
            h, proof, pos, n = _grams(texts)
            row = np.repeat(batch.column(0).to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(pos.astype(np.int32)), pa.array(h), pa.array(proof)], names=["row", "pos", "gram", "proof"])

    return docs.select("row", F.col("text").cast("string")).mapInArrow(run, GRAMS)


def document_words(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words) of every row."""

    def run(it):
        for batch, texts in batches_of(it):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts.words(ALNUM)[2], pa.int64())], names=["row", "doc_id", "n_words"]
            )

    return docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "row long, doc_id long, n_words long")


def votes(grams: DataFrame) -> DataFrame:
    """One row for each verified match: (row, template, label, total, pos, tpos)."""
    spark = grams.sparkSession
    # bounded: one row for each gram of PHRASES and NOTICES
    table = F.broadcast(spark.createDataFrame(template_grams(), "template string, label string, total int, tpos int, gram long, tproof long"))
    met = grams.join(table, "gram").where(F.col("proof") == F.col("tproof"))
    return met.select("row", "template", "label", "total", F.col("pos").cast("long").alias("pos"), "tpos")


SPANS = "row long, template string, label string, start long, end long, score double"


def best_chain(pos: np.ndarray, tpos: np.ndarray, total: int) -> tuple[int, int, int]:
    """(first position, last position, matches) of the best chain of matches that rise in both
    texts: one for each match, less SKIP for each word skipped between two on either side."""
    order = np.lexsort((-tpos, pos))  # matches of one word come from the template's end, so none follows another
    # of the best chain that ends at each template position: score and what SKIP takes no more of
    # it, so that chains ended at different places compare; its matches; its first position
    reach = np.full(total, -np.inf)
    matches, first = np.zeros(total, np.int64), np.zeros(total, np.int64)
    best, found = 0.0, (0, 0, 0)
    for p, t in zip(pos[order].tolist(), tpos[order].tolist(), strict=True):
        score, n, start = 1.0, 1, p
        if t:
            k = int(np.argmax(reach[:t]))
            joined = 1.0 + reach[k] - SKIP * (p + t - 2)
            if joined > score:
                score, n, start = joined, int(matches[k]) + 1, int(first[k])
        if score + SKIP * (p + t) > reach[t]:
            reach[t], matches[t], first[t] = score + SKIP * (p + t), n, start
        if score > best:
            best, found = score, (start, p, n)
    return found


def _verified(it):
    """SPANS rows of merged spans: a phrase as it is, a notice if its best chain covers enough."""
    for batch in it:
        out = []
        for r in batch.to_pylist():
            if r["template"] in PHRASES:
                out.append((r["row"], r["template"], r["label"], r["start"], r["end"], 1.0))
                continue
            tpos = np.concatenate([np.asarray(c["hits"], np.int64) for c in r["cells"]])
            pos = tpos + np.repeat([c["d"] for c in r["cells"]], [len(c["hits"]) for c in r["cells"]])
            start, last, n = best_chain(pos, tpos, r["total"])
            if n >= COVERAGE * r["total"]:
                out.append((r["row"], r["template"], r["label"], start, last + K, n / r["total"]))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "template", "label", "start", "end", "score"])


def spans(found: DataFrame) -> DataFrame:
    """SPANS rows of what is reported: votes summed by diagonal, neighbouring diagonals merged, and
    of spans with enough of the template's grams those that hold them in order."""
    diagonal = found.groupBy("row", "template", "label", "total", (F.col("pos") - F.col("tpos")).alias("d")).agg(
        F.collect_set("tpos").alias("hits"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    by = Window.partitionBy("row", "template").orderBy("d")
    # a phrase stands on one diagonal; a notice may lose or gain words inside
    is_phrase = F.col("template").isin(*PHRASES)
    new = F.coalesce((F.col("d") - F.lag("d").over(by) > F.when(is_phrase, 0).otherwise(BAND)).cast("int"), F.lit(1))
    merged = diagonal.withColumn("new", new).withColumn("span", F.sum("new").over(by))
    merged = merged.groupBy("row", "template", "label", "total", "span").agg(
        F.min("first").alias("start"), (F.max("last") + K).alias("end"), F.collect_list(F.struct("d", "hits")).alias("cells")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("cells", lambda c: c["hits"]))))
    enough = covered >= F.when(is_phrase, F.col("total")).otherwise(F.col("total") * COVERAGE)
    return merged.where(enough).select("row", "template", "label", "total", "start", "end", "cells").mapInArrow(_verified, SPANS)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the
    reported spans as an array of (template, label, start, end, score)."""
    # equal rows share a key, vote for the same places and get the same result each
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    found = spans(votes(document_grams(rows)))
    is_phrase = F.col("template").isin(*PHRASES)
    per_doc = found.groupBy("row").agg(
        F.count(F.when(is_phrase, 1)).alias("n_base"),
        F.min(F.when(is_phrase, F.col("start"))).alias("first_word"),
        F.max(F.when(is_phrase, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_phrase, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
        F.array_sort(F.collect_set(F.struct("start", "end", "template", "label", "score"))).alias("spans"),
    )
    return document_words(rows).join(per_doc, "row", "left")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_places(text: str | None) -> list[tuple[int, str]]:
    """Brute force for tests: (first word, label) of all places of PHRASES."""
    words = _WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(out)
