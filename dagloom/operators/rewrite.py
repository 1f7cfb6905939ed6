"""Structural mutation of definitions' graphs, planned as set queries. Every graph that has the target
is changed, each within itself; the others stay as they are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dagloom.operators.graph import DuplicateNodeError, Graph, GraphError
from dagloom.operators.paths import descendants_of, exclusive_descendants, shared_descendants, split_descendants
from dagloom.session import cut

#: type of the steps that a replacement graph brings
REPLACEMENT_STEP = "noop"


@dataclass(frozen=True)
class Replacement:
    """A graph to put in a subtree's place, with the nodes that its neighbours join."""

    graph: Graph
    entries: tuple[str, ...]
    exits: tuple[str, ...]

    def check(self) -> None:
        if not self.entries or not self.exits:
            raise GraphError("a replacement needs entry and exit nodes")
        self.graph.require(*self.entries, *self.exits)


@dataclass(frozen=True)
class Plan:
    valid: bool
    graph: Graph | None = None
    invalidated: DataFrame | None = None
    removed: DataFrame | None = None
    reason: str | None = None


def plan_invalidate(graph: Graph, target: str) -> Plan:
    """The same graph; the target and all behind it are to run again."""
    return Plan(True, graph, descendants_of(graph, target).select("graph_id", "node_id"))


def removed_by(graph: Graph, target: str) -> DataFrame:
    return exclusive_descendants(graph, target).select("graph_id", "node_id")


def impacted_by(graph: Graph, target: str) -> DataFrame:
    """What lies behind the target and stays."""
    return shared_descendants(graph, target).select("graph_id", "node_id")


def plan_replace_subtree(graph: Graph, target: str, replacement: Replacement) -> Plan:
    graph.require(target)
    replacement.check()
    split = cut(split_descendants(graph, target))
    removed, impacted = (split.where(x).select("graph_id", "node_id") for x in ("NOT shared", "shared"))
    brought = _in_every_graph(replacement.graph.nodes.select("node_id"), graph, target)
    clash = graph.nodes.join(removed, ["graph_id", "node_id"], "left_anti").join(brought, ["graph_id", "node_id"], "left_semi").limit(1).collect()
    if clash:
        raise DuplicateNodeError(f"duplicate node: {clash[0].node_id}")
    return Plan(True, replaced_graph(graph, target, removed, replacement), impacted, removed)


def _in_every_graph(rows: DataFrame, graph: Graph, target: str) -> DataFrame:
    """rows of a replacement (a mutation's own few) once for each graph that has the target."""
    holders = graph.nodes.where(F.col("node_id") == target).select("graph_id").distinct().withColumn("__one", F.lit(1))
    return rows.withColumn("__one", F.lit(1)).join(holders, "__one").drop("__one")


def plan(graph: Graph, kind: str, target: str, replacement: Replacement | None = None) -> Plan:
    """Dispatch; what is wrong with a mutation makes the plan invalid instead of raising."""
    try:
        if kind == "invalidate":
            if replacement is not None:
                raise GraphError("invalidate takes no replacement")
            return plan_invalidate(graph, target) if graph.require(target) is None else None
        if kind == "replace_subtree":
            if replacement is None:
                raise GraphError("replace_subtree needs a replacement")
            return plan_replace_subtree(graph, target, replacement)
        raise GraphError(f"unknown mutation kind: {kind}")
    except GraphError as e:
        return Plan(False, reason=str(e))


def rewired_edges(graph: Graph, target: str, removed: DataFrame, replacement: Replacement) -> DataFrame:
    """Edges of four kinds, the first of repeated ones kept: between kept nodes; inside the
    replacement; from the target's predecessors to its entries with the old metadata; from its
    exits to kept successors of removed nodes. Entries and exits are lists of the mutation itself,
    so attaching them multiplies rows by their fixed number."""
    edges = graph.edges
    marked = edges
    for c in ("src", "dst"):
        gone = removed.select("graph_id", F.col("node_id").alias(c)).distinct().withColumn(f"__{c}", F.lit(True))
        marked = marked.join(gone, ["graph_id", c], "left").na.fill(False, [f"__{c}"])
    columns = ["graph_id", "src", "dst", "weight", "metadata", "ord"]
    inside = _in_every_graph(replacement.graph.edges.drop("graph_id"), graph, target)
    kinds = [
        marked.where("NOT __src AND NOT __dst"),
        inside,
        marked.where(F.col("dst") == target).where("NOT __src").withColumn("dst", F.explode(F.array(*[F.lit(x) for x in sorted(replacement.entries)]))),
        marked.where("__src AND NOT __dst").withColumn("src", F.explode(F.array(*[F.lit(x) for x in sorted(replacement.exits)]))),
    ]
    every = None
    for k, rows in enumerate(kinds):
        rows = rows.select(*columns, F.lit(k).alias("__kind"))
        every = rows if every is None else every.unionByName(rows)
    first = Window.partitionBy("graph_id", "src", "dst").orderBy("__kind", "ord", "weight", "metadata")
    return every.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*columns)


def replaced_graph(graph: Graph, target: str, removed: DataFrame, replacement: Replacement) -> Graph:
    kept = graph.nodes.join(removed.select("graph_id", "node_id").distinct(), ["graph_id", "node_id"], "left_anti").select("graph_id", "node_id", "ord")
    order = F.row_number().over(Window.partitionBy("graph_id").orderBy("__new", "node_id")) - 1
    brought = _in_every_graph(replacement.graph.nodes.select("node_id", "ord"), graph, target)
    nodes = kept.withColumn("__new", F.lit(0)).unionByName(brought.withColumn("__new", F.lit(1)))
    return Graph(nodes.withColumn("ord", order.cast("long")).drop("__new"), rewired_edges(graph, target, removed, replacement))


def step_types(old: DataFrame, new: Graph) -> DataFrame:
    """(node_id, step_type), by graph_id if `old` has it: kept types, and REPLACEMENT_STEP for new nodes."""
    keys = ["graph_id", "node_id"] if "graph_id" in old.columns else ["node_id"]
    return new.nodes.select(*keys).join(old.select(*keys, "step_type"), keys, "left").select(*keys, F.coalesce("step_type", F.lit(REPLACEMENT_STEP)).alias("step_type"))
