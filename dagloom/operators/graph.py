"""Graphs as pairs of DataFrames: one-hop queries, construction, set operations and rendering.

nodes: graph_id, node_id, ord. edges: graph_id, src, dst, weight, metadata, ord. Many graphs live
in one pair; every operator works on all of them at once. `ord` is insertion order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType
from pyspark.sql.window import Window


class GraphError(ValueError):
    """Base of construction and lookup errors."""


class CycleError(GraphError):
    pass


class DuplicateNodeError(GraphError):
    pass


class UnknownNodeError(GraphError):
    pass


class ValidationError(GraphError):
    def __init__(self, errors: Sequence[str]):
        self.errors = list(errors)
        super().__init__("; ".join(self.errors))


def _complete_nodes(nodes: DataFrame) -> DataFrame:
    if "graph_id" not in nodes.columns:
        nodes = nodes.withColumn("graph_id", F.lit("g"))
    if "ord" not in nodes.columns:
        nodes = nodes.withColumn("ord", F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")).cast("long"))
    return nodes.select("graph_id", F.col("node_id").cast("string").alias("node_id"), F.col("ord").cast("long").alias("ord"))


def _complete_edges(edges: DataFrame) -> DataFrame:
    has = edges.columns
    return edges.select(
        F.col("graph_id") if "graph_id" in has else F.lit("g").alias("graph_id"),
        F.col("src").cast("string").alias("src"),
        F.col("dst").cast("string").alias("dst"),
        _weight(edges).alias("weight"),
        (F.col("metadata") if "metadata" in has else F.lit(None).cast("string")).alias("metadata"),
        (F.col("ord").cast("long") if "ord" in has else F.lit(0).cast("long")).alias("ord"),
    )


def weight_of(metadata: Column) -> Column:
    """The weight in JSON metadata, else 1; a weight that is no number is an error, not a 1."""
    raw = F.get_json_object(metadata, "$.weight")
    number = raw.try_cast("double")
    return F.when(raw.isNull(), F.lit(1.0)).when(number.isNull(), F.raise_error(F.concat(F.lit("weight is not a number: "), raw))).otherwise(number)


def _weight(edges: DataFrame) -> Column:
    """An integer weight column stays one, any other number is a double; without the column the
    weight is that of the metadata."""
    if "weight" not in edges.columns:
        return weight_of(F.col("metadata")) if "metadata" in edges.columns else F.lit(1).cast("long")
    kind = "long" if isinstance(edges.schema["weight"].dataType, IntegralType | NullType) else "double"
    return F.coalesce(F.col("weight").cast(kind), F.lit(1).cast(kind))


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> Graph:
        """Bulk build: set semantics on nodes, the first of repeated edges stays."""
        first = Window.partitionBy("graph_id", "src", "dst").orderBy("ord")
        edges = _complete_edges(edges)
        if edges.columns and "ord" in edges.columns:
            edges = edges.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
        return cls(_complete_nodes(nodes).dropDuplicates(["graph_id", "node_id"]), edges)

    @classmethod
    def trusted(cls, nodes: DataFrame, edges: DataFrame) -> Graph:
        """As `of` for inputs known to be distinct: no shuffle."""
        return cls(_complete_nodes(nodes), _complete_edges(edges))

    @classmethod
    def literal(cls, spark: SparkSession, nodes: Sequence[str], edges: Sequence[tuple], graph_id: str = "g") -> Graph:
        """From Python values: edges are (src, dst) or (src, dst, weight)."""
        kind = "long" if all(isinstance(x[2], int) for x in edges if len(x) > 2) else "double"
        one = 1 if kind == "long" else 1.0
        n = spark.createDataFrame([(graph_id, x, i) for i, x in enumerate(nodes)], "graph_id string, node_id string, ord long")
        e = spark.createDataFrame([(graph_id, x[0], x[1], x[2] * one if len(x) > 2 else one, None, i) for i, x in enumerate(edges)], f"graph_id string, src string, dst string, weight {kind}, metadata string, ord long")
        return cls(n, e)

    # membership and one hop

    def only(self, graph_id: str | None) -> Graph:
        """One graph of many; None: all of them."""
        if graph_id is None:
            return self
        return Graph(self.nodes.where(F.col("graph_id") == graph_id), self.edges.where(F.col("graph_id") == graph_id))

    def has_node(self, node_id: str, graph_id: str | None = None) -> bool:
        return not self.only(graph_id).nodes.where(F.col("node_id") == node_id).isEmpty()

    def has_edge(self, src: str, dst: str, graph_id: str | None = None) -> bool:
        return not self.only(graph_id).edges.where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()

    def known_nodes(self, asked: DataFrame) -> DataFrame:
        """asked (graph_id, node_id) with `known`."""
        mine = self.nodes.select("graph_id", "node_id").distinct().withColumn("known", F.lit(True))
        return asked.join(mine, ["graph_id", "node_id"], "left").na.fill(False, ["known"])

    def known_edges(self, asked: DataFrame) -> DataFrame:
        """asked (graph_id, src, dst) with `known`."""
        mine = self.edges.select("graph_id", "src", "dst").distinct().withColumn("known", F.lit(True))
        return asked.join(mine, ["graph_id", "src", "dst"], "left").na.fill(False, ["known"])

    def require(self, *node_ids: str, graph_id: str | None = None) -> None:
        """Every name is a node of the graph; of some graph, if none is named."""
        known = {r.node_id for r in self.only(graph_id).nodes.where(F.col("node_id").isin(*node_ids)).select("node_id").distinct().collect()}
        missing = [x for x in node_ids if x not in known]
        if missing:
            raise UnknownNodeError(f"unknown node: {missing[0]}")

    def successors(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("src") == node_id).select("graph_id", F.col("dst").alias("node_id"))

    def predecessors(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("dst") == node_id).select("graph_id", F.col("src").alias("node_id"))

    def incoming_edges(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("dst") == node_id)

    def edge_metadata(self, src: str, dst: str) -> DataFrame:
        return self.edges.where((F.col("src") == src) & (F.col("dst") == dst)).select("graph_id", F.coalesce("metadata", F.lit("{}")).alias("metadata"))

    def each_node(self) -> DataFrame:
        return self.nodes.orderBy("graph_id", "ord")

    def each_edge(self) -> DataFrame:
        return self.edges.orderBy("graph_id", "ord", "src", "dst")

    def _without(self, end: str) -> DataFrame:
        ends = self.edges.select("graph_id", F.col(end).alias("node_id"))
        return self.nodes.join(ends, ["graph_id", "node_id"], "left_anti")

    def roots(self) -> DataFrame:
        return self._without("dst")

    def leaves(self) -> DataFrame:
        return self._without("src")

    def isolated(self) -> DataFrame:
        ends = self.edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"))
        return self.nodes.join(ends, ["graph_id", "node_id"], "left_anti")

    def counts(self) -> DataFrame:
        """(graph_id, nodes, edges), zero edges included."""
        n = self.nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))
        e = self.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))
        return n.join(e, "graph_id", "left").select("graph_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))

    def shown(self) -> DataFrame:
        """(graph_id, text): each graph in a line."""
        return self.counts().select("graph_id", F.format_string("Graph(nodes=%d, edges=%d)", "nodes", "edges").alias("text"))

    def edges_shown(self) -> DataFrame:
        """(graph_id, text): each edge as its ends, and its metadata if there is any."""
        bare = F.coalesce(F.col("metadata"), F.lit("{}")) == "{}"
        ends = F.format_string("%s -> %s", "src", "dst")
        return self.edges.select("graph_id", F.concat(F.lit("Edge("), ends, F.when(bare, "").otherwise(F.concat(F.lit(", "), "metadata")), F.lit(")")).alias("text"))

    def degrees(self) -> DataFrame:
        """(graph_id, node_id, indegree, outdegree): one aggregation of both ends of the edges."""
        ends = self.edges.select("graph_id", F.inline(F.array(F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))))
        sums = ends.groupBy("graph_id", "node_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        joined = self.nodes.join(sums, ["graph_id", "node_id"], "left")
        return joined.select("graph_id", "node_id", F.coalesce("i", F.lit(0)).cast("long").alias("indegree"), F.coalesce("o", F.lit(0)).cast("long").alias("outdegree"))

    def subgraph(self, names: DataFrame | Sequence[str]) -> Graph:
        """Induced subgraph; names given as values must be known."""
        if not isinstance(names, DataFrame):
            self.require(*names)
            return Graph(self.nodes.where(F.col("node_id").isin(*names)), self.edges.where(F.col("src").isin(*names) & F.col("dst").isin(*names)))
        keys = ["graph_id", "node_id"] if "graph_id" in names.columns else ["node_id"]
        names = names.select(*keys).distinct()
        unknown = names.join(self.nodes, keys, "left_anti").limit(1).collect()
        if unknown:
            raise UnknownNodeError(f"unknown node: {unknown[0].node_id}")
        kept = self.edges
        for end in ("src", "dst"):
            kept = kept.join(names.withColumnRenamed("node_id", end), [*keys[:-1], end], "left_semi")
        return Graph(self.nodes.join(names, keys, "left_semi"), kept.select(*self.edges.columns))

    # changes: each returns a new graph

    def with_node(self, node_id: str, graph_id: str = "g") -> Graph:
        if self.has_node(node_id, graph_id):
            raise DuplicateNodeError(f"duplicate node: {node_id}")
        row = self._next_ord(self.only(graph_id).nodes).select(F.lit(graph_id).alias("graph_id"), F.lit(node_id).alias("node_id"), "ord")
        return Graph(self.nodes.unionByName(row), self.edges)

    @staticmethod
    def _next_ord(rows: DataFrame) -> DataFrame:
        return rows.agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).alias("ord"))

    def with_edge(self, src: str, dst: str, weight: float | None = None, metadata: str | None = None, graph_id: str = "g") -> Graph:
        """Checks in order: known ends, self-loop, an existing edge (kept as it is), a cycle. The
        weight is the one given, else that of the metadata, else 1."""
        from dagloom.operators.paths import path_exists

        self.require(src, dst, graph_id=graph_id)
        if src == dst:
            raise CycleError(f"self loop: {src}")
        if self.has_edge(src, dst, graph_id):
            return self
        if path_exists(self.only(graph_id), dst, src):
            raise CycleError(f"edge {src} -> {dst} closes a cycle")
        given = json.loads(metadata) if metadata is not None else {}
        weight = given.get("weight", 1) if weight is None else weight
        if isinstance(weight, bool) or not isinstance(weight, (int, float)):
            raise GraphError(f"weight is not a number: {weight!r}")
        whole = isinstance(self.edges.schema["weight"].dataType, IntegralType) and isinstance(weight, int)
        kind = "long" if whole else "double"
        row = self._next_ord(self.only(graph_id).edges).select(
            F.lit(graph_id).alias("graph_id"), F.lit(src).alias("src"), F.lit(dst).alias("dst"), F.lit(weight).cast(kind).alias("weight"), F.lit(metadata).cast("string").alias("metadata"), "ord"
        )
        return Graph(self.nodes, self.edges.withColumn("weight", F.col("weight").cast(kind)).unionByName(row))

    def without_node(self, node_id: str, graph_id: str | None = None) -> Graph:
        """Of the named graph, or of every graph that has the node."""
        self.require(node_id, graph_id=graph_id)
        other = F.lit(False) if graph_id is None else F.col("graph_id") != graph_id
        return Graph(self.nodes.where(other | (F.col("node_id") != node_id)), self.edges.where(other | ((F.col("src") != node_id) & (F.col("dst") != node_id))))

    def without_edge(self, src: str, dst: str, graph_id: str | None = None) -> Graph:
        if not self.has_edge(src, dst, graph_id):
            raise GraphError(f"unknown edge: {src} -> {dst}")
        other = F.lit(False) if graph_id is None else F.col("graph_id") != graph_id
        return Graph(self.nodes, self.edges.where(other | ~((F.col("src") == src) & (F.col("dst") == dst))))

    def with_node_replaced(self, old: str, new: str, graph_id: str | None = None) -> Graph:
        """Rename, keeping edges and metadata; the new node goes last in insertion order. Of the
        named graph, or of every graph that has the node."""
        self.require(old, graph_id=graph_id)
        if old == new:
            return self
        holders = self.only(graph_id).nodes.where(F.col("node_id") == old).select("graph_id")
        if not self.only(graph_id).nodes.where(F.col("node_id") == new).join(holders, "graph_id", "left_semi").isEmpty():
            raise DuplicateNodeError(f"duplicate node: {new}")
        mine = F.lit(True) if graph_id is None else F.col("graph_id") == graph_id

        def named(c: str) -> Column:
            return F.when(mine & (F.col(c) == old), F.lit(new)).otherwise(F.col(c)).alias(c)

        last = self.nodes.groupBy("graph_id").agg((F.max("ord") + 1).alias("__last"))
        nodes = self.nodes.join(last, "graph_id").select("graph_id", named("node_id"), F.when(mine & (F.col("node_id") == old), F.col("__last")).otherwise(F.col("ord")).alias("ord"))
        return Graph(nodes, self.edges.select("graph_id", named("src"), named("dst"), "weight", "metadata", "ord"))

    def frozen(self) -> Graph:
        return Graph(self.nodes.cache(), self.edges.cache())

    def same_as(self, other: Graph) -> bool:
        """Equal node sets, and equal edge sets with weight and metadata."""
        for a, b, columns in ((self.nodes, other.nodes, ["graph_id", "node_id"]), (self.edges, other.edges, ["graph_id", "src", "dst", "weight", "metadata"])):
            a, b = a.select(*columns), b.select(*columns)
            if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
                return False
        return True

    # rendering

    def canonical(self) -> DataFrame:
        """(graph_id, text): nodes by name and edges by ends, metadata left out where empty."""
        n = self.nodes.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("nodes"))
        meta = F.when(F.col("metadata").isNull() | (F.col("metadata") == "{}"), F.lit("")).otherwise(F.concat(F.lit("|"), F.col("metadata")))
        line = F.struct("src", "dst", F.concat("src", F.lit(">"), "dst", meta).alias("line"))
        e = self.edges.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), ",").alias("edges"))
        return n.join(e, "graph_id", "left").select("graph_id", F.concat(F.lit("nodes="), "nodes", F.lit(";edges="), F.coalesce("edges", F.lit(""))).alias("text"))

    def fingerprint(self) -> DataFrame:
        return self.canonical().select("graph_id", F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"))

    def dot_lines(self, order: DataFrame) -> DataFrame:
        """(graph_id, kind, pos, line) of Graphviz text: nodes in topological order, then edges by
        the order of their ends. order: graph_id, node_id, pos."""
        nodes = order.select("graph_id", F.lit("node").alias("kind"), "pos", F.concat(F.lit("  "), dot_id(F.col("node_id")), F.lit(";")).alias("line"))
        placed = self.edges.join(order.select("graph_id", F.col("node_id").alias("src"), F.col("pos").alias("a")), ["graph_id", "src"]).join(order.select("graph_id", F.col("node_id").alias("dst"), F.col("pos").alias("b")), ["graph_id", "dst"])
        pos = F.row_number().over(Window.partitionBy("graph_id").orderBy("a", "b")) - 1
        label = F.when(F.col("metadata").isNull() | (F.col("metadata") == "{}"), F.lit("")).otherwise(F.concat(F.lit(" [label="), _quoted(dot_label(F.col("metadata"))), F.lit("]")))
        edges = placed.select("graph_id", F.lit("edge").alias("kind"), pos.cast("long").alias("pos"), F.concat(F.lit("  "), dot_id(F.col("src")), F.lit(" -> "), dot_id(F.col("dst")), label, F.lit(";")).alias("line"))
        return nodes.unionByName(edges)

    def to_dot(self, order: DataFrame, name: str = "dag") -> DataFrame:
        """(graph_id, dot): one text for each graph."""
        lines = self.dot_lines(order).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct((F.col("kind") == "edge").alias("k"), "pos", "line"))).alias("l"))
        return lines.select("graph_id", F.concat(F.lit("digraph "), dot_id(F.lit(name)), F.lit(" {\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n}\n")).alias("dot"))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_id(name: Column) -> Column:
    return F.when(name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z"), name).otherwise(_quoted(name))


def dot_label(metadata: Column) -> Column:
    """k=v, ... of JSON metadata by key."""
    pairs = F.map_entries(F.from_json(metadata, "map<string,string>"))
    return F.array_join(F.transform(F.array_sort(pairs), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


Rule = Callable[[Graph], DataFrame]


def no_isolated(graph: Graph) -> DataFrame:
    """Nodes without edges are errors, in graphs of more than one node."""
    several = graph.nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("graph_id")
    return graph.isolated().join(several, "graph_id", "left_semi").select("graph_id", F.lit("no_isolated").alias("rule"), F.concat(F.lit("isolated node: "), "node_id").alias("message"))


def unknown_ends(graph: Graph) -> DataFrame:
    """Edges to or from nodes that are not there."""
    ends = graph.edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return ends.join(graph.nodes, ["graph_id", "node_id"], "left_anti").select("graph_id", F.lit("unknown_ends").alias("rule"), F.concat(F.lit("unknown node: "), "node_id").alias("message"))


def self_loops(graph: Graph) -> DataFrame:
    return graph.edges.where("src = dst").select("graph_id", F.lit("self_loop").alias("rule"), F.concat(F.lit("self loop: "), "src").alias("message"))


def validate(graph: Graph, rules: Sequence[Rule] = (no_isolated,)) -> DataFrame:
    """(graph_id, rule, message): all errors of all rules; none means valid."""
    found = [rule(graph) for rule in rules]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def validated(graph: Graph, rules: Sequence[Rule] = (no_isolated,)) -> Graph:
    errors = [r.message for r in validate(graph, rules).orderBy("rule", "message").limit(100).collect()]
    if errors:
        raise ValidationError(errors)
    return graph
