"""Toxicity grades by cumulative-link (proportional odds) ordinal regression on sparse text features.

One weight vector is shared by all thresholds: P(grade > k) = sigmoid(w.x - theta_k), theta
ascending. Features are 64-bit hashes of words and of word heads, kept where a bounded sample of
labelled documents shows an association with the label. Labels are binary, so the grade of a
toxic document is derived from how many associated words it holds (`GRADE_HITS`).

Defined results: a null or empty text has no features and gets the model's base rate; label rows
with a null label or without a document are left out; without labels of both classes every
document has severity 0; repeated rows get equal scores; very long texts are scored on all their
words; grades that tie in probability go to the lower one; other columns pass through `score`
unchanged, and a column named like one of the added ones is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.llm.tokens import ALNUM, Texts, batches_of, list_array, mix, word_hashes

#: the bound of the labelled sample that the model is fitted on, in documents
SAMPLE = 6000
FEATURES = 4096
LEAST_DOCUMENTS = 5
HEAD = 4
#: a toxic document with so many associated words has grade 2, 3; with fewer grade 1
GRADE_HITS = (3, 7)
THRESHOLD = 0.5


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and word heads, and their number for each text."""
    starts, ends, counts = texts.words(ALNUM)
    whole = word_hashes(texts.buf, starts, ends, lower=True)
    head = mix(word_hashes(texts.buf, starts, np.minimum(starts + HEAD, ends), lower=True) ^ np.uint64(1))
    return np.stack([whole, head], 1).reshape(-1), counts * 2


@dataclass
class Model:
    keys: np.ndarray  # ascending feature hashes
    weights: np.ndarray
    theta: np.ndarray  # ascending thresholds, one for each step between grades

    def linear(self, texts: Texts) -> np.ndarray:
        h, counts = features(texts)
        out = np.zeros(len(texts))
        if not len(self.keys) or not len(h):
            return out
        doc, which, times = _hits(self.keys, h, counts)
        np.add.at(out, doc, self.weights[which] * np.log1p(times))
        return out

    def above(self, linear: np.ndarray) -> np.ndarray:
        """P(grade > k), a row for each text."""
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - linear[:, None], -60, 60)))


def _hits(keys: np.ndarray, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, times) of the features among keys."""
    # a bit table of the low bits spares most lookups
    table = np.zeros(1 << 20, bool)
    table[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
    on = keys[at] == h[maybe]
    doc = np.searchsorted(np.cumsum(counts), maybe[on], "right")
    pair, times = np.unique(doc * len(keys) + at[on], return_counts=True)
    return pair // len(keys), pair % len(keys), times


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "toxic") -> Model:
    """Fit on at most about `sample` labelled documents, chosen by a hash of doc_id."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("__y"))
    n = marked.count()
    share = min(1.0, sample / max(1, n))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    # bounded by `sample` rows of two numbers
    joined = docs.select(F.col("doc_id").alias("__d"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("__d") == F.col("doc_id")).select("__y", "text")

    def run(it):
        for batch, texts in batches_of(it):
            h, counts = features(texts)
            end = np.cumsum(counts)
            found = [np.unique(h[e - c : e], return_counts=True) for e, c in zip(end, counts, strict=True)]
            sizes = np.array([len(u) for u, _ in found], np.int64)
            keys = np.concatenate([u for u, _ in found]) if found else np.empty(0, np.uint64)
            times = np.concatenate([t for _, t in found]) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), list_array(keys.view(np.int64), sizes, pa.int64()), list_array(times.astype(np.int32), sizes, pa.int32())], names=["y", "keys", "times"]
            )

    table = joined.mapInArrow(run, "y int, keys array<long>, times array<int>").toArrow()
    y = table["y"].to_numpy()
    keys, times = (table[c].combine_chunks() for c in ("keys", "times"))
    sizes = np.diff(np.asarray(keys.offsets)) if len(y) else np.empty(0, np.int64)
    return fit_rows(y, sizes, np.asarray(keys.flatten()).view(np.uint64) if len(y) else np.empty(0, np.uint64), np.asarray(times.flatten()) if len(y) else np.empty(0, np.int64))


def fit_rows(y: np.ndarray, sizes: np.ndarray, keys: np.ndarray, times: np.ndarray) -> Model:
    """y: 0 or 1 of each document; keys, times: its distinct features and their counts."""
    grades = len(GRADE_HITS) + 2
    if not len(y) or y.min() == y.max():
        return Model(np.empty(0, np.uint64), np.empty(0), np.full(grades - 1, 60.0) + np.arange(grades - 1))
    # collection order does not matter: documents are put in the order of their features
    doc = np.repeat(np.arange(len(y)), sizes)
    sign = np.zeros(len(y), np.uint64)
    np.add.at(sign, doc, mix(keys))
    rank = np.empty(len(y), np.int64)
    rank[np.lexsort((y, sign))] = np.arange(len(y))
    order = np.argsort(rank[doc], kind="stable")
    doc, keys, times = rank[doc][order], keys[order], times[order]
    y = y[np.argsort(rank)]
    vocabulary, which = np.unique(keys, return_inverse=True)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    with_1 = np.bincount(which, weights=y[doc], minlength=len(vocabulary))
    with_0 = np.bincount(which, minlength=len(vocabulary)) - with_1
    odds = np.log((with_1 + 0.5) / (n1 + 1)) - np.log((with_0 + 0.5) / (n0 + 1))
    gain = with_1 * odds
    usable = (with_1 + with_0 >= LEAST_DOCUMENTS) & (odds > 1)
    picked = np.flatnonzero(usable)
    picked = np.sort(picked[np.argsort(-gain[picked], kind="stable")[:FEATURES]])
    index = np.full(len(vocabulary), -1)
    index[picked] = np.arange(len(picked))
    column = index[which]
    on = column >= 0
    doc, column, value = doc[on], column[on], np.log1p(times[on])
    strong = odds[picked] > 3
    hits = np.bincount(doc, weights=times[on] * strong[column], minlength=len(y))
    grade = np.where(y == 1, 1 + sum((hits >= g).astype(int) for g in GRADE_HITS), 0)
    return Model(vocabulary[picked], *_descend(doc, column, value, grade, len(picked), grades))


def _descend(doc, column, value, grade, n_features: int, grades: int, steps: int = 300, l2: float = 2e-4, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the mean negative log-likelihood; thresholds as a first one and log gaps."""
    n = len(grade)
    share = np.array([np.clip((grade > k).mean(), 1e-4, 1 - 1e-4) for k in range(grades - 1)])
    theta = np.log((1 - share) / share)
    p = np.concatenate([np.zeros(n_features), theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(n)
    for t in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        theta = p[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(doc, weights=w[column] * value, minlength=n)
        cdf = 1 / (1 + np.exp(np.clip(s[:, None] - theta[None, :], -60, 60)))  # P(grade <= k)
        full = np.concatenate([np.zeros((n, 1)), cdf, np.ones((n, 1))], 1)
        density = np.concatenate([np.zeros((n, 1)), cdf * (1 - cdf), np.zeros((n, 1))], 1)
        prob = np.maximum(full[rows, grade + 1] - full[rows, grade], 1e-12)
        up, low = density[rows, grade + 1] / prob, density[rows, grade] / prob
        d_theta = np.zeros(grades - 1)
        np.add.at(d_theta, np.minimum(grade, grades - 2), np.where(grade < grades - 1, -up, 0))
        np.add.at(d_theta, np.maximum(grade - 1, 0), np.where(grade > 0, low, 0))
        d_theta /= n
        d_w = np.bincount(column, weights=((up - low) / n)[doc] * value, minlength=n_features) + l2 * w
        tail = np.cumsum(d_theta[::-1])[::-1]
        g = np.concatenate([d_w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])


ADDED = "p_toxic double, severity double, grade int, toxic boolean"


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in keep) with ADDED: P(grade > 0), the expected severity, the most
    probable grade, and whether the document is rejected."""
    added = [x.split(" ")[0] for x in ADDED.split(", ")]
    kept = [c for c in (keep or docs.columns) if c not in added]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", " + ADDED

    def run(it):
        for batch, texts in batches_of(it):
            above = model.above(model.linear(texts))
            full = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(batch.schema.get_field_index(c)) for c in kept],
                    pa.array(above[:, 0]),
                    pa.array(above.sum(1)),
                    pa.array(np.argmax(full[:, :-1] - full[:, 1:], 1).astype(np.int32)),
                    pa.array(above[:, 0] >= THRESHOLD),
                ],
                names=[*kept, *added],
            )

    return docs.select(*{c: 0 for c in [*kept, "text"]}).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the documents that the model rejects, with all their own columns."""
    verdict = "__toxicity_verdict"
    schema = docs.withColumn(verdict, F.lit(True)).schema

    def run(it):
        for batch, texts in batches_of(it):
            toxic = model.above(model.linear(texts))[:, 0] >= THRESHOLD
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(toxic)], names=[*batch.schema.names, verdict])

    return docs.mapInArrow(run, schema).where(f"NOT {verdict}").drop(verdict)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels), keep=["doc_id"])
