"""Reachability, layering and weighted paths.

Two strategies give the same results. Graphs of up to GROUP_EDGES edges each are solved one graph
a group in numpy, all graphs in parallel, with one shuffle and no driver loop. Larger graphs go
through frontier loops of joins, whose state is checkpointed in every round. The choice is made
from the counted size of the largest graph.

Topological order is by layer (longest hop distance from a root), then by node name, byte-wise.
Path ties keep the topologically earliest predecessor; the critical path ends at the first best
leaf in insertion order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dagloom.operators.graph import CycleError, Graph
from dagloom.session import cut

#: edges and nodes of one graph that a single task may hold (some 100 MB)
GROUP_EDGES = 1_000_000


def fits_group(graph: Graph, most: int = GROUP_EDGES) -> bool:
    """True if no graph has more than `most` edges or nodes."""
    both = graph.edges.select("graph_id").withColumn("k", F.lit(0)).unionByName(graph.nodes.select("graph_id").withColumn("k", F.lit(1)))
    largest = both.groupBy("graph_id", "k").count().agg(F.max("count")).first()[0]
    return (largest or 0) <= most


class _Local:
    """One graph in numpy: nodes numbered by insertion order, edges in both directions."""

    def __init__(self, nodes: pd.DataFrame, edges: pd.DataFrame):
        nodes = nodes.sort_values(["ord", "node_id"], kind="stable")
        self.names = nodes["node_id"].to_numpy(object)
        self.index = {x: i for i, x in enumerate(self.names)}
        n = len(self.names)
        src = edges["src"].map(self.index).to_numpy(np.int64)
        dst = edges["dst"].map(self.index).to_numpy(np.int64)
        order = np.argsort(src, kind="stable")
        self.dst, self.weight = dst[order], edges["weight"].to_numpy()[order]
        self.off = np.searchsorted(src[order], np.arange(n + 1))
        back = np.argsort(dst, kind="stable")
        self.src_of, self.back_off = src[back], np.searchsorted(dst[back], np.arange(n + 1))
        self.degree = np.bincount(dst, minlength=n)

    def out(self, i: int) -> slice:
        return slice(self.off[i], self.off[i + 1])

    def layers(self) -> np.ndarray:
        """Layer of each node, -1 on or behind a cycle."""
        layer = np.full(len(self.names), -1)
        left = self.degree.copy()
        front = np.flatnonzero(left == 0)
        depth = 0
        while len(front):
            layer[front] = depth
            hit = np.concatenate([self.dst[self.out(i)] for i in front]) if len(front) else front
            np.subtract.at(left, hit, 1)
            front = np.unique(hit[left[hit] == 0])
            depth += 1
        return layer

    def order(self) -> np.ndarray:
        layer = self.layers()
        if (layer < 0).any():
            raise CycleError("the graph has a cycle")
        return np.array(sorted(range(len(self.names)), key=lambda i: (layer[i], self.names[i].encode())), np.int64)

    def reach(self, starts: list[int], back: bool = False, closed: int | None = None) -> np.ndarray:
        """Nodes reachable from starts, starts included; `closed` is never entered."""
        off, to = (self.back_off, self.src_of) if back else (self.off, self.dst)
        seen = np.zeros(len(self.names), bool)
        front = [i for i in starts if i != closed]
        seen[front] = True
        while len(front):
            hit = np.unique(np.concatenate([to[off[i] : off[i + 1]] for i in front]))
            front = hit[~seen[hit] & (hit != (-1 if closed is None else closed))]
            seen[front] = True
        return seen

    def relax(self, starts: list[int], longest: bool) -> tuple[np.ndarray, np.ndarray]:
        """Best cost from the starts (NaN where unreachable) and predecessor of each node."""
        cost = np.full(len(self.names), np.nan)
        before = np.full(len(self.names), -1)
        cost[starts] = 0
        for i in self.order():
            if np.isnan(cost[i]):
                continue
            edges = self.out(i)
            for j, w in zip(self.dst[edges], self.weight[edges], strict=True):
                new = cost[i] + w
                if np.isnan(cost[j]) or (new > cost[j] if longest else new < cost[j]):
                    cost[j], before[j] = new, i
        return cost, before

    def path(self, before: np.ndarray, end: int) -> list[int]:
        out = [end]
        while before[out[-1]] >= 0:
            out.append(before[out[-1]])
        return out[::-1]


def _per_graph(graph: Graph, solve: Callable[[_Local], pd.DataFrame], schema: str) -> DataFrame:
    """solve() on every graph; nodes without edges come along."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(key, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if nodes.empty:
            return pd.DataFrame(columns=names)
        out = solve(_Local(nodes, edges))
        out.insert(0, "graph_id", key[0])
        out = out[names]
        # plain object columns become one Arrow array each
        return out.astype({c: object for c in ("graph_id", "node_id") if c in out})

    return graph.nodes.groupBy("graph_id").cogroup(graph.edges.select("graph_id", "src", "dst", "weight").groupBy("graph_id")).applyInPandas(run, schema)


# layers and order


def layers(graph: Graph, strategy: str | None = None) -> DataFrame:
    """(graph_id, node_id, layer); a cycle raises CycleError when the result is computed."""
    if (strategy or ("group" if fits_group(graph) else "loop")) == "loop":
        return _layers_loop(graph)

    def solve(g: _Local) -> pd.DataFrame:
        layer = g.layers()
        if (layer < 0).any():
            raise CycleError("the graph has a cycle")
        return pd.DataFrame({"node_id": g.names, "layer": layer})

    return _per_graph(graph, solve, "graph_id string, node_id string, layer long")


def _layers_loop(graph: Graph, raising: bool = True) -> DataFrame:
    """Peel the nodes without remaining predecessors, layer by layer. Only the edges of the
    nodes just peeled are joined in a round; counts of open predecessors carry the rest."""
    edges = cut(graph.edges.select("graph_id", "src", "dst").distinct())
    degree = edges.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("open"))
    left = cut(graph.nodes.select("graph_id", "node_id").join(degree, ["graph_id", "node_id"], "left").na.fill(0, ["open"]))
    done, depth = None, 0
    while True:
        front = left.where("open = 0").select("graph_id", "node_id", F.lit(depth).cast("long").alias("layer"))
        front = cut(front)
        if front.isEmpty():
            break
        done = front if done is None else done.unionByName(front)
        hit = front.select("graph_id", F.col("node_id").alias("src")).join(edges, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("closed"))
        left = cut(left.where("open > 0").join(hit, ["graph_id", "node_id"], "left").select("graph_id", "node_id", (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open")))
        depth += 1
    if raising and not left.isEmpty():
        raise CycleError("the graph has a cycle")
    return done if done is not None else graph.nodes.select("graph_id", "node_id", F.lit(0).cast("long").alias("layer")).limit(0)


def topological_order(graph: Graph, strategy: str | None = None) -> DataFrame:
    """(graph_id, node_id, layer, pos)."""
    pos = F.row_number().over(Window.partitionBy("graph_id").orderBy("layer", "node_id")) - 1
    return layers(graph, strategy).withColumn("pos", pos.cast("long"))


def cyclic_nodes(graph: Graph) -> DataFrame:
    """(graph_id, node_id) of nodes that no layer can take: those on a cycle or behind one."""
    if not fits_group(graph):
        return graph.nodes.select("graph_id", "node_id").join(_layers_loop(graph, raising=False), ["graph_id", "node_id"], "left_anti")
    return _per_graph(graph, lambda g: pd.DataFrame({"node_id": g.names[g.layers() < 0]}), "graph_id string, node_id string")


# reachability


def reachable(graph: Graph, node_ids: list[str], back: bool = False, closed: str | None = None, strategy: str | None = None) -> DataFrame:
    """(graph_id, node_id) reachable from node_ids, themselves included where known; `closed` is
    not entered. back: against the edges."""
    if (strategy or ("group" if fits_group(graph) else "loop")) == "loop":
        return _reach_loop(graph, graph.nodes.where(F.col("node_id").isin(*node_ids)).select("graph_id", "node_id"), back, closed)

    def solve(g: _Local) -> pd.DataFrame:
        starts = [g.index[x] for x in node_ids if x in g.index]
        return pd.DataFrame({"node_id": g.names[g.reach(starts, back, g.index.get(closed))]})

    return _per_graph(graph, solve, "graph_id string, node_id string")


def _reach_loop(graph: Graph, starts: DataFrame, back: bool, closed: str | None) -> DataFrame:
    a, b = ("dst", "src") if back else ("src", "dst")
    edges = graph.edges if closed is None else graph.edges.where(F.col(b) != closed)
    edges = cut(edges.select("graph_id", F.col(a).alias("node_id"), F.col(b).alias("to")))
    seen = front = cut(starts if closed is None else starts.where(F.col("node_id") != closed))
    while not front.isEmpty():
        hit = front.join(edges, ["graph_id", "node_id"]).select("graph_id", F.col("to").alias("node_id")).distinct()
        front = cut(hit.join(seen, ["graph_id", "node_id"], "left_anti"))
        seen = cut(seen.unionByName(front))
    return seen


def descendants(graph: Graph, node_id: str, include_self: bool = False, strategy: str | None = None) -> DataFrame:
    found = reachable(graph, [node_id], strategy=strategy)
    return found if include_self else found.where(F.col("node_id") != node_id)


def ancestors(graph: Graph, node_id: str, strategy: str | None = None) -> DataFrame:
    return reachable(graph, [node_id], back=True, strategy=strategy).where(F.col("node_id") != node_id)


def descendants_of(graph: Graph, node_id: str, include_self: bool = True) -> DataFrame:
    graph.require(node_id)
    return descendants(graph, node_id, include_self)


def split_descendants(graph: Graph, node_id: str, strategy: str | None = None) -> DataFrame:
    """(graph_id, node_id, shared): descendants of a node, itself included, and whether another
    root reaches them when the node is closed."""
    if (strategy or ("group" if fits_group(graph) else "loop")) == "group":

        def solve(g: _Local) -> pd.DataFrame:
            if node_id not in g.index:
                return pd.DataFrame({"node_id": [], "shared": []})
            own = g.reach([g.index[node_id]])
            around = g.reach(np.flatnonzero(g.degree == 0).tolist(), closed=g.index[node_id])
            return pd.DataFrame({"node_id": g.names[own], "shared": around[own]})

        return _per_graph(graph, solve, "graph_id string, node_id string, shared boolean")
    own = _reach_loop(graph, graph.nodes.where(F.col("node_id") == node_id).select("graph_id", "node_id"), False, None)
    around = _reach_loop(graph, graph.roots().select("graph_id", "node_id"), False, node_id)
    return own.join(around.withColumn("shared", F.lit(True)), ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("shared", F.lit(False)).alias("shared"))


def exclusive_descendants(graph: Graph, node_id: str, include_self: bool = True, strategy: str | None = None) -> DataFrame:
    graph.require(node_id)
    found = split_descendants(graph, node_id, strategy).where("NOT shared").select("graph_id", "node_id")
    return found if include_self else found.where(F.col("node_id") != node_id)


def shared_descendants(graph: Graph, node_id: str, strategy: str | None = None) -> DataFrame:
    graph.require(node_id)
    return split_descendants(graph, node_id, strategy).where("shared").select("graph_id", "node_id")


def path_exists(graph: Graph, src: str, dst: str) -> bool:
    """Reflexive for known nodes; false if either is unknown."""
    return not reachable(graph, [src]).where(F.col("node_id") == dst).isEmpty()


# weighted paths



def _path_schema(graph: Graph) -> str:
    """PATH rows: costs are of the weights' type."""
    return f"graph_id string, pos long, node_id string, cost {graph.edges.schema['weight'].dataType.simpleString()}"


def _path(graph: Graph, src: str | None, dst: str | None, longest: bool) -> DataFrame:
    """PATH rows, one for each node of each graph's best path; none where there is no path. src
    None: from all roots; dst None: to the best leaf."""
    kind = graph.edges.schema["weight"].dataType.simpleString()
    whole = np.float64 if kind == "double" else np.int64
    if fits_group(graph):

        def solve(g: _Local) -> pd.DataFrame:
            empty = pd.DataFrame({"pos": [], "node_id": [], "cost": []})
            if (src is not None and src not in g.index) or (dst is not None and dst not in g.index):
                return empty
            starts = np.flatnonzero(g.degree == 0).tolist() if src is None else [g.index[src]]
            cost, before = g.relax(starts, longest)
            if dst is None:
                leaves = np.flatnonzero(np.diff(g.off) == 0)
                end = int(leaves[np.argmax(cost[leaves])])
            else:
                end = g.index[dst]
                if np.isnan(cost[end]):
                    return empty
            path = g.path(before, end)
            return pd.DataFrame({"pos": np.arange(len(path)), "node_id": g.names[path], "cost": cost[path].astype(whole) if len(path) else []})

        return _per_graph(graph, solve, _path_schema(graph))
    costs = relax_loop(graph, src, longest)
    ends = costs.join(graph.nodes, ["graph_id", "node_id"])
    ends = ends.join(graph.leaves().select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi") if dst is None else ends.where(F.col("node_id") == dst)
    best = Window.partitionBy("graph_id").orderBy(F.desc("cost"), "ord")
    step = cut(ends.withColumn("n", F.row_number().over(best)).where("n = 1").select("graph_id", F.lit(0).cast("long").alias("back"), "node_id", "cost", "before"))
    steps = step
    while not step.where("before IS NOT NULL").isEmpty():
        step = cut(step.where("before IS NOT NULL").select("graph_id", (F.col("back") + 1).alias("back"), F.col("before").alias("node_id")).join(costs, ["graph_id", "node_id"]).select("graph_id", "back", "node_id", "cost", "before"))
        steps = steps.unionByName(step)
    pos = F.max("back").over(Window.partitionBy("graph_id")) - F.col("back")
    return steps.select("graph_id", pos.alias("pos"), "node_id", "cost")


def relax_loop(graph: Graph, src: str | None, longest: bool) -> DataFrame:
    """(graph_id, node_id, cost, before): best cost from src (None: all roots), layer by layer;
    equal costs keep the predecessor of the lowest topological rank."""
    order = cut(topological_order(graph, "loop"))
    edges = graph.edges.join(order.select("graph_id", F.col("node_id").alias("src"), F.col("pos").alias("rank")), ["graph_id", "src"])
    edges = cut(edges.join(order.select("graph_id", F.col("node_id").alias("dst"), "layer"), ["graph_id", "dst"]).select("graph_id", "src", "dst", "weight", "rank", "layer"))
    starts = graph.roots() if src is None else graph.nodes.where(F.col("node_id") == src)
    costs = cut(starts.select("graph_id", "node_id", F.lit(0).cast(graph.edges.schema["weight"].dataType).alias("cost"), F.lit(None).cast("string").alias("before")))
    deepest = order.agg(F.max("layer")).first()[0] or 0
    sign = F.lit(1 if longest else -1)
    for depth in range(1, deepest + 1):
        into = edges.where(F.col("layer") == depth).join(costs.select("graph_id", F.col("node_id").alias("src"), "cost"), ["graph_id", "src"])
        pick = F.max_by(F.struct((F.col("cost") + F.col("weight")).alias("cost"), F.col("src").alias("before")), F.struct(sign * (F.col("cost") + F.col("weight")), -F.col("rank")))
        new = into.groupBy("graph_id", F.col("dst").alias("node_id")).agg(pick.alias("p")).select("graph_id", "node_id", "p.cost", "p.before")
        new = new if src is None else new.where(F.col("node_id") != src)
        costs = cut(costs.unionByName(new))
    return costs


def shortest_path(graph: Graph, src: str, dst: str) -> DataFrame:
    return _path(graph, src, dst, longest=False)


def longest_path(graph: Graph, src: str, dst: str) -> DataFrame:
    return _path(graph, src, dst, longest=True)


def critical_path(graph: Graph) -> DataFrame:
    """From the roots at cost 0 to the best leaf of each graph."""
    return _path(graph, None, None, longest=True)


def path_summary(path: DataFrame) -> DataFrame:
    """(graph_id, cost, path): one row for each graph that has a path."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]), ">")
    return path.groupBy("graph_id").agg(F.max_by("cost", "pos").alias("cost"), joined.alias("path"))
