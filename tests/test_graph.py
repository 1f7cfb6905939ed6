"""Graph operators on small and random graphs, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from dagloom.operators import paths as P
from dagloom.operators import rewrite as M
from dagloom.operators.graph import CycleError, DuplicateNodeError, Graph, GraphError, UnknownNodeError, ValidationError, validated, weight_of


def names(df):
    return {r.node_id for r in df.collect()}


@pytest.fixture(scope="module")
def shared(spark):
    return Graph.literal(spark, ["r", "a", "b", "c", "d"], [("r", "a"), ("a", "b"), ("b", "d"), ("r", "c"), ("c", "d")])


def test_exclusive_and_shared(shared):
    assert names(P.exclusive_descendants(shared, "a")) == {"a", "b"}
    assert names(P.exclusive_descendants(shared, "c")) == {"c"}
    assert names(P.shared_descendants(shared, "a")) == names(P.shared_descendants(shared, "c")) == {"d"}


def test_construction_errors(shared):
    with pytest.raises(CycleError):
        shared.with_edge("d", "r")
    with pytest.raises(CycleError):
        shared.with_edge("a", "a")
    with pytest.raises(UnknownNodeError):
        shared.with_edge("a", "zz")
    with pytest.raises(DuplicateNodeError):
        shared.with_node("a")
    with pytest.raises(GraphError):
        shared.without_edge("a", "r")
    assert shared.with_edge("r", "a", weight=9) is shared


def test_pure_changes(shared):
    more = shared.with_node("e").with_edge("d", "e", weight=3)
    assert names(more.leaves()) == {"e"} and names(shared.leaves()) == {"d"}
    assert not shared.same_as(more)
    assert more.without_node("e").same_as(shared)
    renamed = shared.with_node_replaced("a", "z")
    assert [r.node_id for r in renamed.each_node().collect()] == ["r", "b", "c", "d", "z"]
    assert renamed.has_edge("r", "z") and not renamed.has_node("a")


def test_replace_subtree_golden(spark):
    diamond = Graph.literal(spark, ["a", "b", "c", "d"], [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    plan = M.plan(diamond, "replace_subtree", "b", M.Replacement(Graph.literal(spark, ["b_prime"], []), ("b_prime",), ("b_prime",)))
    assert plan.valid and names(plan.invalidated) == {"d"}
    assert {(e.src, e.dst) for e in plan.graph.edges.collect()} == {("a", "c"), ("c", "d"), ("a", "b_prime"), ("b_prime", "d")}
    assert not M.plan(diamond, "replace_subtree", "b", M.Replacement(Graph.literal(spark, ["c"], []), ("c",), ("c",))).valid
    assert not M.plan(diamond, "invalidate", "zz").valid
    types = {r.node_id: r.step_type for r in M.step_types(diamond.nodes.withColumn("step_type", F.lit("x")), plan.graph).collect()}
    assert types == {"a": "x", "c": "x", "d": "x", "b_prime": "noop"}


def test_validator(spark):
    lonely = Graph.literal(spark, ["a", "b", "c"], [("a", "b")])
    with pytest.raises(ValidationError) as e:
        validated(lonely)
    assert e.value.errors == ["isolated node: c"]
    assert validated(Graph.literal(spark, ["a"], []))


def test_dot(spark):
    g = Graph.literal(spark, ["a", "x y"], [("a", "x y")])
    text = g.to_dot(P.topological_order(g).select("graph_id", "node_id", "pos")).first().dot
    assert text == 'digraph dag {\n  a;\n  "x y";\n  a -> "x y";\n}\n'


def test_weights_fail_early(spark):
    df = spark.createDataFrame([('{"weight": 4}',), (None,), ("{}",)], "m string")
    assert [r.w for r in df.select(weight_of(F.col("m")).alias("w")).collect()] == [4, 1, 1]
    with pytest.raises(Exception, match="not a number"):
        spark.createDataFrame([('{"weight": "much"}',)], "m string").select(weight_of(F.col("m"))).collect()


def random_dag(rng):
    n = rng.randrange(1, 13)
    nodes = [f"n{i}" for i in range(n)]
    rng.shuffle(nodes)
    edges = {}
    for _ in range(rng.randrange(0, 30)):
        i, j = rng.randrange(n), rng.randrange(n)
        if i < j:
            edges.setdefault((nodes[i], nodes[j]), rng.randrange(1, 10) if rng.random() < 0.4 else 1)
    insertion = sorted(nodes)
    return insertion, [(a, b, w) for (a, b), w in edges.items()]


def all_paths(edges, a, b):
    if a == b:
        yield 0, [a]
    for x, y, w in edges:
        if x == a:
            for c, p in all_paths(edges, y, b):
                yield c + w, [a, *p]


def test_many_random_graphs_at_once(spark):
    """All graphs in one pair of tables: layers, order and critical cost against naive search."""
    rng = random.Random(20260407)
    made = {f"g{k}": random_dag(rng) for k in range(60)}
    nodes = spark.createDataFrame([(g, n, i) for g, (ns, _) in made.items() for i, n in enumerate(ns)], "graph_id string, node_id string, ord long")
    edges = spark.createDataFrame([(g, a, b, w) for g, (_, es) in made.items() for a, b, w in es], "graph_id string, src string, dst string, weight long")
    graph = Graph.of(nodes, edges)
    order = {}
    for r in P.topological_order(graph).collect():
        order.setdefault(r.graph_id, {})[r.node_id] = (r.layer, r.pos)
    critical = {r.graph_id: (r.cost, r.path.split(">")) for r in P.path_summary(P.critical_path(graph)).collect()}
    for g, (ns, es) in made.items():
        for a, b, _ in es:
            assert order[g][a][0] < order[g][b][0] and order[g][a][1] < order[g][b][1]
        roots = [n for n in ns if all(b != n for _, b, _ in es)]
        leaves = [n for n in ns if all(a != n for a, _, _ in es)]
        best = max((c for r in roots for x in leaves for c, _ in all_paths(es, r, x)), default=None)
        assert critical[g][0] == best
        path = critical[g][1]
        assert sum(w for a, b, w in es for x, y in zip(path[:-1], path[1:], strict=True) if (a, b) == (x, y)) == best


@pytest.mark.parametrize("seed", [1, 2])
def test_loop_and_group_agree(spark, seed, monkeypatch):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(14)]
    edges = list({(nodes[i], nodes[j]): (nodes[i], nodes[j], rng.randrange(1, 6)) for i, j in ((rng.randrange(14), rng.randrange(14)) for _ in range(30)) if i < j}.values())
    g = Graph.literal(spark, nodes, edges)

    def results():
        rows = lambda df: sorted(map(tuple, df.collect()))
        return [rows(P.layers(g)), rows(P.descendants(g, "n2")), rows(P.ancestors(g, "n12")), rows(P.exclusive_descendants(g, "n2")), rows(P.shared_descendants(g, "n2")), rows(P.critical_path(g)), rows(P.shortest_path(g, "n0", "n13")), rows(P.longest_path(g, "n0", "n13"))]

    one = results()
    monkeypatch.setattr(P, "fits_group", lambda *_: False)
    assert results() == one


def test_cycles(spark, monkeypatch):
    g = Graph.literal(spark, ["a", "b", "c", "d"], [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")])
    assert names(P.cyclic_nodes(g)) == {"b", "c", "d"}
    monkeypatch.setattr(P, "fits_group", lambda *_: False)
    assert names(P.cyclic_nodes(g)) == {"b", "c", "d"}
    with pytest.raises(CycleError):
        P.layers(g)


def test_each_graph_is_changed_within_itself(spark):
    """Two graphs that share node names: A (r-t-c) and B (the same plus r-c)."""
    nodes = spark.createDataFrame([(g, n, i) for g in "AB" for i, n in enumerate("rtc")], "graph_id string, node_id string, ord long")
    edges = spark.createDataFrame([("A", "r", "t", 0), ("A", "t", "c", 1), ("B", "r", "t", 0), ("B", "t", "c", 1), ("B", "r", "c", 2)], "graph_id string, src string, dst string, ord long")
    g = Graph.of(nodes, edges)
    pairs = lambda df, *c: {tuple(r) for r in df.select(*c).collect()}
    assert pairs(M.impacted_by(g, "t"), "graph_id", "node_id") == {("B", "c")}
    assert pairs(M.removed_by(g, "t"), "graph_id", "node_id") == {("A", "t"), ("A", "c"), ("B", "t")}
    plan = M.plan(g, "replace_subtree", "t", M.Replacement(Graph.literal(spark, ["n"], []), ("n",), ("n",)))
    assert pairs(plan.graph.edges, "graph_id", "src", "dst") == {("A", "r", "n"), ("B", "r", "n"), ("B", "n", "c"), ("B", "r", "c")}
    assert pairs(plan.graph.nodes, "graph_id", "node_id") == {("A", "r"), ("A", "n"), ("B", "r"), ("B", "n"), ("B", "c")}
    assert g.with_node("r", "C").has_node("r", "C") and not g.has_edge("r", "c", "A") and g.has_edge("r", "c", "B")
    assert pairs(g.with_edge("r", "c", graph_id="A").edges, "graph_id", "src", "dst") == pairs(edges, "graph_id", "src", "dst") | {("A", "r", "c")}
    assert pairs(g.without_node("c", "A").nodes, "graph_id", "node_id") == pairs(nodes, "graph_id", "node_id") - {("A", "c")}
    assert pairs(g.with_node_replaced("t", "z", "B").edges, "graph_id", "src", "dst") == {("A", "r", "t"), ("A", "t", "c"), ("B", "r", "z"), ("B", "z", "c"), ("B", "r", "c")}
    with pytest.raises(UnknownNodeError):
        g.subgraph(spark.createDataFrame([("A", "q")], "graph_id string, node_id string"))
    with pytest.raises(UnknownNodeError):
        P.exclusive_descendants(g, "q")


def test_weights_may_be_fractions(spark, monkeypatch):
    g = Graph.literal(spark, ["a", "b", "c"], [("a", "b", 0.5), ("b", "c", 0.25), ("a", "c", 1)])
    got = lambda: [tuple(r) for r in P.path_summary(P.shortest_path(g, "a", "c")).collect()]
    assert got() == [("g", 0.75, "a>b>c")]
    monkeypatch.setattr(P, "fits_group", lambda *_: False)
    assert got() == [("g", 0.75, "a>b>c")]
    monkeypatch.undo()
    from_metadata = Graph.of(spark.createDataFrame([("a",), ("b",)], "node_id string"), spark.createDataFrame([("a", "b", '{"weight": 4.5}')], "src string, dst string, metadata string"))
    assert P.critical_path(from_metadata).orderBy("pos").collect()[-1].cost == 4.5
    assert g.with_node("d").with_edge("c", "d", metadata='{"weight": 2.5}').edges.where("dst = 'd'").first().weight == 2.5
