"""The pipeline's stages on a small corpus."""

import random

import corpus_pipeline as C

from .common import words


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    bad = ["zorg", "blarg"]
    item = words(rng, 30)
    rows, labels = [], []
    for i in range(200):
        w = words(rng, 60).split()
        if i % 5 == 0:
            w[3:5] = bad
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(500, rows[1][1], "en", "s1", 1), (501, rows[2][1] + " more", "en", "s1", 1), (502, words(rng, 9) + " " + item, "en", "s0", 1), (503, None, None, None, None), (504, "", "en", "s2", 0), (None, rows[3][1], "en", "s0", 1)]
    tables = {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(0, item)], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs, ids = tables["documents"], {}
    for name, stage in C.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "sharding":
            assert docs.columns == tables["documents"].columns
    every = {r[0] for r in rows}
    toxic = {i for i in range(0, 200, 5)}
    assert ids["toxicity"] == every - toxic
    assert ids["ngram_jaccard_join"] == every - toxic - {500, 501}
    assert ids["decontamination"] == every - toxic - {500, 501, 502}
    assert ids["source_mixing"] <= ids["decontamination"] and ids["sharding"] == ids["source_mixing"]
    assert C.run(spark, str(tmp_path)).count() == docs.count()


def test_near_duplicates_tell_rows_of_one_id_apart(spark):
    rng = random.Random(13)
    a, b, c = (words(rng, 60) for _ in range(3))
    # one text of id 30 is near document 7, the other is clean; of two near texts of id 40 one stays
    rows = [(7, a), (30, a + " x"), (30, b), (30, b.upper()), (40, c), (40, c + " x"), (40, None), (50, " "), (50, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in C.drop_near_duplicates(spark, docs, "").collect()]
    assert len([r for r in got if r[1] in (c, c + " x")]) == 1
    assert sorted((r for r in got if r[1] not in (c, c + " x")), key=repr) == sorted([(7, a), (30, b), (30, b.upper()), (40, None), (50, " "), (50, " ")], key=repr)
