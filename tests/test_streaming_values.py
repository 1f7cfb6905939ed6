"""Streams over files, and scalar functions."""

import pytest
from pyspark.sql import functions as F

from dagloom.functions import values as V
from dagloom.kernel import runner as R
from dagloom.kernel import types as T
from dagloom.schema import TABLES, violations
from dagloom.streaming import live

EVENTS = [
    ("w", 1, "workflow_started", 1, None, None, 1000, "{}"),
    ("w", 2, "node_started", 1, "a", None, 2000, "{}"),
    ("v", 1, "workflow_started", 1, None, None, 61_000, "{}"),
    ("w", 3, "workflow_completed", 1, None, None, 62_000, "{}"),
]


@pytest.fixture
def feed(spark, tmp_path):
    folder = str(tmp_path / "events")
    for row in EVENTS:
        spark.createDataFrame([row], TABLES["events"]).write.mode("append").parquet(folder)
    return folder


def run(df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_trace_stream(spark, feed, tmp_path):
    run(live.trace_stream(live.events_source(spark, feed)), "append", "trace", tmp_path)
    assert {(r.workflow_id, r.seq, r.status) for r in spark.table("trace").collect()} == {("w", 1, "started"), ("w", 2, "started"), ("v", 1, "started"), ("w", 3, "completed")}


def test_status_is_kept_over_batches(spark, feed, tmp_path):
    run(live.workflow_status(live.events_source(spark, feed, files_per_trigger=1)), "update", "status", tmp_path)
    last = {}
    for r in spark.table("status").collect():
        if r.last_seq >= last.get(r.workflow_id, ("", 0, 0))[1]:
            last[r.workflow_id] = (r.state, r.last_seq, r.events)
    assert last["w"][0] in ("completed", "running") and last["v"] == ("running", 1, 1)
    assert last["w"][1] == 3


def test_windows(spark, feed, tmp_path):
    run(live.activity(live.events_source(spark, feed)), "complete", "activity", tmp_path)
    assert sum(r.n for r in spark.table("activity").collect()) == 4


def test_fan_out_survives_a_subscriber(spark, feed, tmp_path):
    got = []
    live.fan_out(live.events_source(spark, feed), [lambda b, e: 1 / 0, lambda b, e: got.append(b.count())], str(tmp_path / "fan")).awaitTermination()
    assert sum(got) == 4


def test_commits_as_a_stream(spark, tmp_path):
    k = R.kit(spark, str(tmp_path / "store"))
    k.store.create_workflow("w", T.Definition().add_node("a", "noop"))
    k.runner.call("w")
    run(live.commits_source(spark, str(tmp_path / "store")), "append", "commits", tmp_path)
    assert sorted(r.seq for r in spark.table("commits").collect()) == [1, 2, 3, 4]


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_json(spark):
    texts = ['{"b": [2, 1], "a": null}', "{", '{"a": 1, "a": 2}', '{"a": NaN}']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(V.is_json_safe(F.col("t")).alias("ok"))
    assert [r.ok for r in got.collect()] == [True, False, False, False]
    assert one(spark, V.canonical_json(F.lit(texts[0]))) == ['{"a":null,"b":[2,1]}']
    assert V.json_safe_path({"a": [1, float("inf")]}) == "$root.a[1]"
    assert V.json_safe_path({"a": {1: 2}}) == "$root.a.1"
    assert V.load(V.dump({"b": 1, "a": "é"})) == {"a": "é", "b": 1}


def test_refs_and_codes(spark):
    assert one(spark, V.effect_ref(F.lit("a"), F.lit("k"))) == ["a:k"]
    with pytest.raises(Exception, match="effect ref"):
        one(spark, V.effect_ref(F.lit("a:"), F.lit("k")))
    assert one(spark, *[V.error_code(F.lit(x)) for x in ('"E1"', "7", '{"code": "E2"}', '{"code": [1]}', "[1]", "1.5")]) == ["E1", "7", "E2", None, None, None]
    assert one(spark, V.failure_status(F.lit(True)), V.failure_status(F.lit(False))) == ["failed_retriable", "failed_terminal"]


def test_context_and_results(spark):
    m = F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))
    assert one(spark, V.context_get(m, "a"), V.context_get(m, "z"), V.context_keys(m), V.context_has(m, "b"), V.context_size(m)) == ["2", None, ["a", "b"], True, 2]
    assert one(spark, V.context_dig(F.lit('{"a": {"b": 3}}'), "a", "b")) == ["3"]
    assert one(spark, V.context_dig(F.lit('{"a.b": {"c[0]": 3}}'), "a.b", "c[0]"), V.context_fetch(m, "a"), V.context_empty(m), V.context_equal(m, m)) == ["3", "2", False, True]
    assert [tuple(e) for e in one(spark, V.context_entries(m))[0]] == [("a", "2"), ("b", "1")]
    with pytest.raises(Exception, match="no key: z"):
        one(spark, V.context_fetch(m, "z"))
    with pytest.raises(ValueError):
        V.context_dig(F.lit("{}"), "it's")
    ok = F.struct(F.lit("success").alias("kind"), F.lit("1").alias("value"), F.lit(None).cast("string").alias("error"))
    bad = F.struct(F.lit("failure").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit("e").alias("error"))
    up = lambda c: F.concat(c, F.lit("!"))
    assert one(spark, V.map_value(ok, up)["value"], V.map_value(bad, up)["value"], V.recover(bad, up)["kind"], V.recover(bad, up)["value"], V.unwrap(ok)) == ["1!", None, "success", "e!", "1"]
    assert one(spark, V.on_success(ok, up, up), V.on_success(bad, up, up)) == ["1!", "e!"]
    assert one(spark, V.millis(F.lit(1.9996))) == [1999]


def test_violations(spark):
    rows = spark.createDataFrame([("w", 1, "nonsense", 1, None, None, 1, "{}"), ("w", None, "node_started", 1, None, None, 1, "{}")], TABLES["events"])
    assert {(r.column, r.value, r.n) for r in violations("events", rows).collect()} == {("type", "nonsense", 1), ("seq", None, 1)}


def test_checks():
    fine = [([], "array"), ({}, "mapping"), ("", "string"), (0, "integer"), (False, "boolean"), (ValueError(), ValueError)]
    for value, kind in fine:
        assert V.expect(value, kind, "x") is value and V.expect(None, kind, "x", optional=True) is None
        for other, _ in fine:
            if other is not value:
                with pytest.raises(ValueError, match="x must be a"):
                    V.expect(other, kind, "x")
        with pytest.raises(ValueError, match="own words"):
            V.expect(None, kind, "x", message="own words")
    assert V.one_of(1, (1, 2), "x") == 1 and V.revision_number(3) == 3 and V.node_name("n") == "n"
    assert V.able_to("text", ("upper",), "x") == "text" and V.all_given({"a": 0}, "x") == {"a": 0}
    for bad in (lambda: V.one_of(3, (1, 2), "x"), lambda: V.revision_number(0), lambda: V.node_name(None), lambda: V.able_to("text", ("upper", "fly"), "x"), lambda: V.all_given({"a": None}, "x")):
        with pytest.raises(ValueError):
            bad()
