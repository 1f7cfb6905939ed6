"""Every opN_ query, as registered, against plain Python on a folder of small tables; and the pipeline on
columns that clash and on empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as C
from dagloom.llm import licenses as L
from dagloom.llm import parity as P
from dagloom.llm import queries as Q
from dagloom.llm import secrets as S
from dagloom.llm import substring as W
from dagloom.llm import telephony as A
from dagloom.llm import tokens as K

from .common import frame, odd_rows, words
from .test_operators import brute_links, plain_windows, split

ITEM = words(random.Random(30), 24)


def made():
    rng = random.Random(31)
    rows = odd_rows()
    rows += [(300, words(rng, 8) + " " + ITEM, "s0"), (301, "the MIT license and cc by", "s1"), (302, "password = 'abcdefgh1234' AKIA" + "B2" * 8, "s1"), (303, rows[0][1] + " more", "s2")]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    frame(spark, made()).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def rows_of(spark, folder, name):
    return Q.QUERIES[name](spark, folder).collect()


def text_bytes(t):
    return (t or "").encode()


def test_op1(spark, folder):
    want = Counter()
    for i, t, _ in made():
        p = A.padded(text_bytes(t))
        want[i, len(text_bytes(t)), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    got = rows_of(spark, folder, "op1_telephony")
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    same = defaultdict(set)
    for r in got:
        same[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in same.values())


def test_op2(spark, folder):
    assert {(r.doc_id, r.item_id, r.covered_words) for r in rows_of(spark, folder, "op2_decontamination")} == {(300, 1, 24)}


def test_op3(spark, folder):
    want = Counter()
    for i, t, _ in made():
        p = L.plain_places(t)
        want[i, len(p), p[0][0] if p else None, p[-1][0] if p else None, ",".join(sorted({x[1] for x in p}))] += 1
    got = rows_of(spark, folder, "op3_license_scan")
    assert Counter((r.doc_id, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_op4(spark, folder):
    want = Counter()
    for (i, n, gone, kept), k in plain_windows(made(), 13).items():
        want[i, n, gone, hashlib.sha256(kept.encode()).hexdigest()] += k
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows_of(spark, folder, "op4_substring_dedup")) == want


def test_op5(spark, folder):
    want = Counter((i, *S.plain_base(t)) for i, t, _ in made())
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows_of(spark, folder, "op5_secret_scan")) == want


def test_op6(spark, folder):
    assert Counter(map(tuple, rows_of(spark, folder, "op6_jaccard_join"))) == brute_links(made(), 3, 90, 100)


def test_op7(spark, folder):
    got = rows_of(spark, folder, "op7_toxicity")
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in made())
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.grade <= 3 and r.toxic == (r.p_toxic >= 0.5) for r in got)


def test_op8(spark, folder):
    got = rows_of(spark, folder, "op8_mixing")
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(split(t))) for i, t, _ in made())
    by_source = Counter()
    for _, t, s in made():
        by_source[s] += len(split(t))
    assert {r.source_size for r in got} == set(by_source.values()) and all(r.taken <= 3 * r.size for r in got)


def test_op9(spark, folder):
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter()
    for i, t, _ in made():
        if not held(i):
            c.update([*split((t or "").lower()), "end"])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, _ in made():
        tokens = [*split((t or "").lower()), "end"]
        want[i, held(i), len(tokens), sum(c[x] > 0 for x in tokens), n, round(sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens), 6)] += 1
    got = rows_of(spark, folder, "op9_language_model")
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    by_text = defaultdict(set)
    texts = {i: t for i, t, _ in made() if i not in (None, 7)}
    for r in got:
        if r.doc_id in texts:
            by_text[texts[r.doc_id]].add(r.base_score)
    assert all(len(x) == 1 for x in by_text.values())  # equal texts, equal base scores to the last digit


def test_op10(spark, folder):
    got = rows_of(spark, folder, "op10_sharding")
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == Counter((i, len(text_bytes(t)) + 8, zlib.crc32(text_bytes(t)), "rows", None) for i, t, _ in made())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(24)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def morse(n):
    """Thue-Morse words over {a, b} of n bytes, and the complement."""
    word = b"a"
    while len(word) < n:
        word += bytes(195 - x for x in word)
    return word, bytes(195 - x for x in word)


@pytest.mark.parametrize("n", [512, 1024, 8192, 1 << 18])
def test_patterned_words_have_hashes_of_their_own(n):
    a, b = morse(n)
    t = K.Texts.of_list([a, b, a])
    starts, ends, _ = t.words()
    for second in (False, True):
        h = K.word_hashes(t.buf, starts, ends, second=second)
        assert h[0] == h[2] != h[1]


def test_patterned_words_are_told_apart(spark):
    a, b = (x.decode() for x in morse(1024))
    rest = words(random.Random(33), 14)
    rows = [(1, f"{a} {rest}", "s"), (2, f"{b} {rest}", "s"), (3, a, "s"), (4, b, "s")]
    got = {r.doc_id: r.n_removed for r in W.repeated_windows(frame(spark, rows), 13).collect()}
    assert got == {1: 0, 2: 14, 3: 0, 4: 0}
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in P.near_duplicates(frame(spark, rows)).collect()) == brute_links(rows, 3, 90, 100)


def test_large_groups_are_compared_in_tiles_and_portions(spark, monkeypatch):
    """Near copies in several clusters that share a passage: tiles of three members, one pair a portion."""
    for name, value in (("SMALL", 2), ("CHUNK", 3), ("TILE", 4), ("PORTION", 1), ("GROWTH", 2), ("BROADCAST_TEXTS", 3), ("SAMPLE", 4)):
        monkeypatch.setattr(P, name, value)
    rng = random.Random(34)
    passage, rows = words(rng, 60), []
    for g in range(5):
        own = words(rng, 45).split()
        for k in range(7):
            w = list(own)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice("abcdefgh")
            rows.append((100 * g + k, passage + " " + " ".join(w), "s"))
    got = P.near_duplicates(frame(spark, rows), 5, 80, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_links(rows, 5, 80, 100)


def test_pipeline_keeps_columns_that_clash(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = C.drop_toxic(spark, docs, folder)
    assert left.columns == docs.columns
    assert left.where("NOT toxic OR severity <> 9 OR size <> -5 OR shard <> 77").count() == 0 and left.count() > 0
    near = C.drop_near_duplicates(spark, left, folder)
    assert near.columns == docs.columns and near.where("NOT toxic OR h <> 1").count() == 0


def test_pipeline_on_empty_tables(spark, tmp_path):
    documents = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
