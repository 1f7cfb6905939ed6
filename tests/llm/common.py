"""Small documents with every odd case: nulls, blanks, long texts, ties, repeated rows, and extra
columns whose names clash with those that operators add."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, target double, shard int, slot long, toxic boolean, severity double, "
    "h long, row string, key long, block int, kinds string, spans string"
)
VOCABULARY = [f"w{i}" for i in range(400)]


def words(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def odd_rows(seed=1):
    """(doc_id, text, source)"""
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randrange(1, 80)), f"s{i % 4}" if i % 9 else None) for i in range(60)]
    rows += [(100, None, "s0"), (101, "", "s1"), (102, " \t\n", None), (None, words(rng, 20), "s1"), (103, "É ñ Ünï ß K", "s2"), (104, words(rng, 9000), "s0")]
    rows += [(105, "x" * 300_000, "s3")]
    rows += [rows[3], rows[3], (7, rows[8][1], "s1"), (110, rows[5][1], "s2"), (111, rows[5][1].upper(), "s2")]
    return rows


def frame(spark, rows):
    full = [(i, t, None, s, 1, -5, 0.5, 77, 88, True, 9.0, 1, "r", 2, 3, "k", "sp") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)
