"""A training-corpus pipeline over `documents`: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.llm import decontaminate, mixing, parity, sharding, toxicity
from dagloom.session import delete, ensure_checkpoint_dir

#: a name that no table's own column has
ROW = "__corpus_pipeline_row"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal severity model rejects go; columns named like the model's own are
    the input's and stay as they are. A null, empty or blank text has no features and stays; a very
    long text is scored whole; repeated rows and ties share their verdict."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard 0.8 on five-word shingles stays: the one of
    the smallest doc_id, with all its rows if it has several; of texts that tie for it under one
    doc_id, the one of the smallest set hash. Rows of one doc_id with different shingles are
    different documents. Documents without words are no copies of each other and stay, and so do
    rows without a doc_id. Very long texts are compared whole; other columns play no part."""
    found = parity.near_duplicates(docs, n=5, p=80, q=100)
    row = docs.select(docs["*"], F.struct(docs["doc_id"].cast("long").alias("doc_id"), *parity.text_hash(docs["text"])).alias(ROW))
    # nulls are equal to nulls inside a struct
    gone = found.where("doc_id IS NOT NULL AND NOT first").select(F.struct("doc_id", "t1", "t2").alias(ROW)).distinct()
    return row.join(gone, ROW, "left_anti").drop(ROW)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever their doc_id; a null or empty text holds none."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a document without words is never taken."""
    return mixing.sample_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot; columns of the input named so are replaced."""
    return sharding.assign(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: the first stage's model can't be expressed in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written to the shared folder and read as the next one's docs."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)  # what the stage has read is not needed again
        last = path
    return docs
