"""Registered queries of the engine's own operators, each with the DuckDB SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.fixtures import duck, relation
from dagloom.functions import values as V
from dagloom.operators import paths as P
from dagloom.operators import rewrite as M
from dagloom.operators.graph import Graph, no_isolated, validate
from dagloom.plans import workflow as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NOW_MS = 100
#: subjects of the single-node queries
NODE, OTHER, MR_NODE = "1", "191", "7"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def part_graph(spark: SparkSession, sf_dir: str, dag: str = "part_dag") -> Graph:
    return Graph.trusted(relation(spark, sf_dir, "part_nodes"), relation(spark, sf_dir, dag))


def conv_graphs(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of(relation(spark, sf_dir, "conv_nodes"), relation(spark, sf_dir, "conv_dag"))


def wf_graph(spark: SparkSession) -> Graph:
    return Graph.literal(spark, ["n0", "n1", "n2", "n3"], [("n0", "n1"), ("n0", "n2"), ("n1", "n3"), ("n2", "n3")])


EV, AT, EF, LK, PD, PM, PN, IN = (duck(x) for x in ("ev_log", "attempts", "effects", "attempt_effects", "part_dag", "part_dag_mr", "part_nodes", "intents"))
WE, WN, CD, CN, WF = (duck(x) for x in ("wf_edges", "wf_nodes", "conv_dag", "conv_nodes", "workflows"))
STATUS_SQL = """CASE type WHEN 'workflow_started' THEN 'started' WHEN 'node_started' THEN 'started' WHEN 'node_committed' THEN 'success'
  WHEN 'node_waiting' THEN 'waiting' WHEN 'node_failed' THEN 'failed' WHEN 'workflow_paused' THEN 'paused' WHEN 'workflow_waiting' THEN 'waiting'
  WHEN 'workflow_completed' THEN 'completed' WHEN 'workflow_failed' THEN 'failed' ELSE type END AS status"""

# event log


@query(f"SELECT workflow_id, seq, type, revision, node_id, at_ms, payload, {STATUS_SQL} FROM {EV} ORDER BY workflow_id, seq")
def trace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.read_events(W.trace_records(relation(spark, sf_dir, "ev_log")))


@query(f"SELECT workflow_id, seq, type, {STATUS_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY seq) AS n FROM {EV} WHERE seq > 2) WHERE n <= 3")
def trace_after_seq_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.trace_records(W.first_events(relation(spark, sf_dir, "ev_log"), after_seq=2, limit=3)).select("workflow_id", "seq", "type", "status")


@query(f"SELECT workflow_id, seq, type FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY seq DESC) AS n FROM {EV}) WHERE n <= 4")
def event_ring_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.ring_tail(relation(spark, sf_dir, "ev_log"), 4).select("workflow_id", "seq", "type")


@query(f"SELECT workflow_id, max(seq) AS last_event_seq FROM {EV} GROUP BY workflow_id")
def run_result_last_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.last_seq(relation(spark, sf_dir, "ev_log"))


@query(f"SELECT status, count(*) AS n FROM (SELECT {STATUS_SQL} FROM {EV}) GROUP BY status")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.status_histogram(relation(spark, sf_dir, "ev_log"))


@query(f"""SELECT e.workflow_id, e.seq, 'node_id' AS field FROM {EV} e WHERE e.node_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {WN} n WHERE n.node_id = e.node_id)
UNION ALL SELECT e.workflow_id, e.seq, 'revision' FROM {EV} e WHERE e.revision <> 1""")
def event_coordinate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = relation(spark, sf_dir, "ev_log").withColumn("attempt_id", F.lit(None).cast("string"))
    revisions = events.select("workflow_id", F.lit(1).cast("long").alias("revision")).distinct()
    nodes = revisions.withColumn("node_id", F.explode(F.array(*[F.lit(f"n{i}") for i in range(4)])))
    attempts = events.select("workflow_id", "attempt_id").limit(0)
    return W.coordinate_violations(events, revisions, nodes, attempts)


# attempts


@query(f"SELECT workflow_id, revision, node_id, count(*) FILTER (state <> 'aborted') AS attempts FROM {AT} GROUP BY ALL")
def count_attempts_non_aborted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.count_attempts(relation(spark, sf_dir, "attempts"))


@query(f"""SELECT workflow_id, revision, node_id, attempt_id, attempt_number FROM (SELECT *, row_number() OVER (
  PARTITION BY workflow_id, revision, node_id ORDER BY attempt_number DESC, attempt_id DESC) AS n FROM {AT} WHERE state = 'committed') WHERE n = 1""")
def canonical_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.canonical_committed(relation(spark, sf_dir, "attempts"))


@query(f"SELECT workflow_id, node_id, attempt_id, attempt_number, attempt_number + CASE WHEN state <> 'aborted' THEN 1 ELSE 0 END AS next_number FROM {AT}")
def next_attempt_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = W.number_attempts(relation(spark, sf_dir, "attempts").drop("attempt_number"))
    return numbered.select("workflow_id", "node_id", "attempt_id", "attempt_number", (F.col("attempt_number") + F.when(F.col("state") != "aborted", 1).otherwise(0)).cast("long").alias("next_number"))


@query(f"""SELECT workflow_id, revision, node_id, attempt_id AS last_error_attempt_id, error_code AS last_error_code FROM (SELECT *, row_number() OVER (
  PARTITION BY workflow_id, revision, node_id ORDER BY attempt_number DESC, attempt_id DESC) AS n FROM {AT} WHERE state = 'failed') WHERE n = 1""")
def last_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.last_failure(relation(spark, sf_dir, "attempts"))


@query(f"SELECT workflow_id, attempt_seq, attempt_id, node_id, state FROM {AT} WHERE node_id = 'n1' AND revision = 1 ORDER BY workflow_id, attempt_seq")
def list_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relation(spark, sf_dir, "attempts").where("node_id = 'n1' AND revision = 1")
    return found.select("workflow_id", "attempt_seq", "attempt_id", "node_id", "state").orderBy("workflow_id", "attempt_seq")


STATES_SQL = f"(SELECT workflow_id, revision, node_id, CASE WHEN s = 'aborted' THEN 'pending' ELSE s END AS state FROM (SELECT workflow_id, revision, node_id, arg_max(state, attempt_seq) AS s FROM {AT} GROUP BY ALL))"
TERMINAL_SQL = "status IN ('succeeded', 'failed_terminal')"


@query(f"SELECT * FROM {STATES_SQL}")
def node_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.node_states(relation(spark, sf_dir, "attempts"))


def diagnostics_sql(states: str) -> str:
    """All fields of the diagnostics of `states`, of revision 1."""
    return f"""
WITH a AS (SELECT * FROM {AT}),
t AS (SELECT workflow_id, revision, node_id, count(*) AS attempt_count, arg_max(attempt_id, (attempt_number, attempt_id)) AS last_attempt_id,
  arg_max(error_code, (attempt_number, attempt_id)) FILTER (state = 'failed') AS last_error_code,
  arg_max(attempt_id, (attempt_number, attempt_id)) FILTER (state = 'failed') AS last_error_attempt_id,
  arg_max('r' || attempt_seq, (attempt_number, attempt_id)) FILTER (state = 'waiting') AS reason FROM a GROUP BY ALL),
l AS (SELECT DISTINCT workflow_id, revision, node_id, effect_id FROM {LK}),
e AS (SELECT workflow_id, revision, node_id, string_agg(type || ':' || key, ',' ORDER BY type || ':' || key) AS effect_refs,
  string_agg(type || ':' || key || '=' || status, ',' ORDER BY type || ':' || key) AS effect_statuses, bool_and({TERMINAL_SQL}) AS effects_terminal
  FROM l JOIN {EF} f ON l.effect_id = f.effect_id GROUP BY ALL)
SELECT s.workflow_id, 1::BIGINT AS revision, s.node_id, s.state, s.state IN ('committed', 'failed') AS terminal, coalesce(attempt_count, 0) AS attempt_count, last_attempt_id, last_error_code, last_error_attempt_id,
  CASE WHEN s.state = 'waiting' THEN reason END AS waiting_reason,
  coalesce(effect_refs, '') AS effect_refs, coalesce(effect_statuses, '') AS effect_statuses, CASE WHEN effects_terminal THEN 'yes' WHEN NOT effects_terminal THEN 'no' ELSE 'none' END AS effects_terminal
FROM {states} s LEFT JOIN t ON (s.workflow_id, s.node_id) = (t.workflow_id, t.node_id)
LEFT JOIN e ON (s.workflow_id, s.node_id) = (e.workflow_id, e.node_id)"""


def with_reasons(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("reason", F.concat(F.lit("r"), "attempt_seq"))


def shown(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics in types that compare: whether all effects are terminal as text."""
    return diagnostics.withColumn("effects_terminal", F.when(F.col("effects_terminal"), "yes").when(~F.col("effects_terminal"), "no").otherwise("none"))


@query(diagnostics_sql(STATES_SQL))
def node_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = with_reasons(relation(spark, sf_dir, "attempts"))
    return shown(W.node_diagnostics(W.node_states(attempts), attempts, relation(spark, sf_dir, "attempt_effects"), relation(spark, sf_dir, "effects")))


FINAL_SQL = f"""SELECT workflow_id, CASE WHEN a THEN 'completed' WHEN w THEN 'waiting' ELSE 'failed' END AS state, CASE WHEN NOT a AND NOT w THEN 'no_eligible_but_incomplete' END AS reason
FROM (SELECT workflow_id, bool_and(state = 'committed') AS a, bool_or(state = 'waiting') AS w FROM {STATES_SQL} GROUP BY workflow_id)"""


@query(FINAL_SQL)
def finalize_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.finalize(W.node_states(relation(spark, sf_dir, "attempts")))


@query(f"""SELECT w.id AS workflow_id, coalesce(f.state, 'completed') AS state, f.reason FROM {WF} w
LEFT JOIN ({FINAL_SQL}) f ON f.workflow_id = w.id AND CAST(substr(w.id, 4) AS BIGINT) % 3 > 0""")
def finalize_with_empty_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third workflow has no nodes."""
    states = W.node_states(relation(spark, sf_dir, "attempts")).where("CAST(substr(workflow_id, 4) AS BIGINT) % 3 > 0")
    return W.finalize(states, relation(spark, sf_dir, "workflows").select(F.col("id").alias("workflow_id")))


@query(f"SELECT a.workflow_id, a.attempt_id FROM {AT} a WHERE a.state = 'waiting'")
def abort_running_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = relation(spark, sf_dir, "attempts")
    return W.abort_running(attempts, W.node_states(attempts), running="waiting")[0]


@query(f"SELECT a.workflow_id, a.attempt_id FROM {AT} a JOIN {STATES_SQL} s ON (a.workflow_id, a.revision, a.node_id) = (s.workflow_id, s.revision, s.node_id) WHERE s.state = 'failed' AND a.state = 'failed'")
def retry_reset_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = relation(spark, sf_dir, "attempts")
    return W.retry_reset(attempts, W.node_states(attempts))[0]


# eligibility, context

# every workflow has all four nodes; one without attempts is pending
ALL_STATES_SQL = f"""(SELECT w.workflow_id, n.node_id, coalesce(s.state, 'pending') AS state FROM (SELECT DISTINCT workflow_id FROM {AT}) w CROSS JOIN {WN} n
LEFT JOIN {STATES_SQL} s ON s.workflow_id = w.workflow_id AND s.node_id = n.node_id)"""


def all_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = relation(spark, sf_dir, "attempts")
    every = attempts.select("workflow_id").distinct().withColumn("node_id", F.explode(F.array(*[F.lit(f"n{i}") for i in range(4)])))
    states = W.node_states(attempts).select("workflow_id", "node_id", "state")
    return every.join(states, ["workflow_id", "node_id"], "left").na.fill("pending", ["state"])


@query(f"""SELECT s.workflow_id, s.node_id, s.state, CASE s.node_id WHEN 'n0' THEN 0 WHEN 'n1' THEN 1 WHEN 'n2' THEN 2 ELSE 3 END::BIGINT AS pos FROM {ALL_STATES_SQL} s
WHERE s.state = 'pending' AND NOT EXISTS (SELECT 1 FROM {WE} e JOIN {ALL_STATES_SQL} p ON p.node_id = e.src WHERE e.dst = s.node_id AND p.workflow_id = s.workflow_id AND p.state <> 'committed')""")
def eligible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = wf_graph(spark)
    order = F.broadcast(P.topological_order(graph, "group").select("node_id", "pos"))  # four rows
    return W.eligible_nodes(all_states(spark, sf_dir), F.broadcast(graph.edges.select("src", "dst")), order)


CANON_SQL = f"""(SELECT workflow_id, node_id, attempt_id AS value, attempt_number FROM (SELECT *, row_number() OVER (
  PARTITION BY workflow_id, revision, node_id ORDER BY attempt_number DESC, attempt_id DESC) AS n FROM {AT} WHERE state = 'committed') WHERE n = 1)"""


def committed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.canonical_committed(relation(spark, sf_dir, "attempts")).select("workflow_id", "node_id", F.col("attempt_id").alias("value"), "attempt_number")


@query(f"SELECT c.workflow_id, e.dst AS node_id, e.src AS predecessor, c.value, c.attempt_number FROM {CANON_SQL} c JOIN {WE} e ON e.src = c.node_id")
def committed_predecessor_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.predecessor_results(committed_values(spark, sf_dir), F.broadcast(wf_graph(spark).edges.select("src", "dst")))


@query(f"""
WITH p AS (SELECT c.workflow_id, e.dst AS node_id, e.src AS predecessor, c.value, c.attempt_number FROM {CANON_SQL} c JOIN {WE} e ON e.src = c.node_id),
kv AS (SELECT workflow_id, node_id, predecessor, 'shared' AS k, value AS v FROM p
  UNION ALL SELECT workflow_id, node_id, predecessor, 'k' || CAST(attempt_number AS VARCHAR), predecessor FROM p
  UNION ALL SELECT DISTINCT workflow_id, node_id, '', 'start', 'yes' FROM p UNION ALL SELECT DISTINCT workflow_id, node_id, '', 'shared', 'initial' FROM p),
last AS (SELECT workflow_id, node_id, k, arg_max(v, predecessor) AS v FROM kv GROUP BY ALL)
SELECT workflow_id, node_id, string_agg(k || '=' || v, ',' ORDER BY k) AS context FROM last GROUP BY workflow_id, node_id""")
def effective_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = committed_predecessor_results(spark, sf_dir)
    patch = F.create_map(F.lit("shared"), F.col("value"), F.concat(F.lit("k"), F.col("attempt_number")), F.col("predecessor"))
    initial = F.create_map(F.lit("start"), F.lit("yes"), F.lit("shared"), F.lit("initial"))
    context = W.effective_context(got.withColumn("patch", patch), initial)
    return context.select("workflow_id", "node_id", W.map_text(F.col("context")).alias("context"))


# effects

CLAIM_SQL = f"(status = 'reserved' OR (status = 'failed_retriable' AND (not_before_ms IS NULL OR not_before_ms <= {NOW_MS})) OR (status = 'dispatching' AND (lease_until_ms IS NULL OR lease_until_ms < {NOW_MS})))"


@query(f"SELECT effect_id, effect_seq, status FROM {EF} WHERE {CLAIM_SQL} ORDER BY effect_seq LIMIT 50")
def claim_ready_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.claim_ready(relation(spark, sf_dir, "effects"), NOW_MS, 50).select("effect_id", "effect_seq", "status")


@query(f"SELECT effect_id, effect_seq, status FROM {EF} e WHERE {CLAIM_SQL} AND EXISTS (SELECT 1 FROM {LK} l WHERE l.effect_id = e.effect_id AND l.workflow_id = 'wf-1') ORDER BY effect_seq LIMIT 50")
def claim_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.claim_ready(relation(spark, sf_dir, "effects"), NOW_MS, 50, relation(spark, sf_dir, "attempt_effects"), "wf-1").select("effect_id", "effect_seq", "status")


@query(f"SELECT effect_id, coalesce(status = 'dispatching' AND lease_owner = 'w1' AND lease_until_ms >= {NOW_MS}, false) AS valid FROM {EF}")
def lease_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "effects").select("effect_id", W.lease_valid("w1", NOW_MS).alias("valid"))


@query(f"SELECT effect_id, type || ':' || key AS ref, type, key, status, {TERMINAL_SQL} AS terminal FROM {EF}")
def effect_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.effect_snapshot(relation(spark, sf_dir, "effects"))


@query(f"""SELECT l.workflow_id, l.revision, l.node_id, l.effect_id, f.type || ':' || f.key AS ref, f.status, l.attempt_id, l.blocking, l.position FROM (
  SELECT workflow_id, revision, node_id, effect_id, arg_max(attempt_id, link_seq) AS attempt_id, arg_max(blocking, link_seq) AS blocking, min(link_seq) AS position
  FROM {LK} GROUP BY workflow_id, revision, node_id, effect_id) l JOIN {EF} f ON f.effect_id = l.effect_id""")
def effects_for_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.effects_of_nodes(relation(spark, sf_dir, "attempt_effects"), relation(spark, sf_dir, "effects"))


BLOCK_SQL = f"(SELECT attempt_id, bool_and(NOT blocking OR {TERMINAL_SQL}) AS all_terminal FROM {LK} l JOIN {EF} f ON f.effect_id = l.effect_id GROUP BY attempt_id)"


@query(f"SELECT * FROM {BLOCK_SQL}")
def blocking_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.blocking_terminal(relation(spark, sf_dir, "attempt_effects"), relation(spark, sf_dir, "effects"))


@query(f"""SELECT DISTINCT l.workflow_id, l.revision, l.node_id, l.attempt_id FROM {LK} l JOIN {BLOCK_SQL} b ON b.attempt_id = l.attempt_id AND b.all_terminal
JOIN {STATES_SQL} s ON (s.workflow_id, s.revision, s.node_id) = (l.workflow_id, l.revision, l.node_id) WHERE l.blocking AND s.state = 'waiting'""")
def release_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.release_set(relation(spark, sf_dir, "attempt_effects"), relation(spark, sf_dir, "effects"), W.node_states(relation(spark, sf_dir, "attempts")))


@query(f"SELECT type, key, min(ord) AS ord, arg_min(payload_fingerprint, ord) AS payload_fingerprint FROM {IN} GROUP BY type, key")
def reservation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.reserve(relation(spark, sf_dir, "intents"))


@query(f"SELECT * FROM (SELECT *, first_value(payload_fingerprint) OVER (PARTITION BY type, key ORDER BY ord) AS reserved FROM {IN}) WHERE reserved <> payload_fingerprint")
def idempotency_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.idempotency_conflicts(relation(spark, sf_dir, "intents"))


@query(f"SELECT effect_id, type || ':' || key AS ref FROM {EF}")
def effect_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "effects").select("effect_id", V.effect_ref(F.col("type"), F.col("key")).alias("ref"))


# one-hop graph queries


@query(f"SELECT node_id FROM {PN} WHERE node_id NOT IN (SELECT dst FROM {PM})")
def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir, "part_dag_mr").roots().select("node_id")


@query(f"SELECT node_id FROM {PN} WHERE node_id NOT IN (SELECT src FROM {PD})")
def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).leaves().select("node_id")


@query(f"""SELECT n.node_id, coalesce(i.c, 0) AS indegree, coalesce(o.c, 0) AS outdegree FROM {PN} n LEFT JOIN (SELECT dst, count(*) AS c FROM {PD} GROUP BY dst) i ON i.dst = n.node_id
LEFT JOIN (SELECT src, count(*) AS c FROM {PD} GROUP BY src) o ON o.src = n.node_id""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).degrees().drop("graph_id")


@query(f"SELECT dst AS node_id FROM {PD} WHERE src = '{NODE}'")
def successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).successors(NODE).select("node_id")


@query(f"SELECT src AS node_id FROM {PD} WHERE dst = '{OTHER}'")
def predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).predecessors(OTHER).select("node_id")


@query(f"SELECT src, dst, weight FROM {PD} WHERE dst = '{OTHER}'")
def incoming_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).incoming_edges(OTHER).select("src", "dst", "weight")


@query(f"SELECT src, dst FROM {PD} WHERE CAST(src AS BIGINT) % 2 = 1 AND CAST(dst AS BIGINT) % 2 = 1")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = part_graph(spark, sf_dir)
    return graph.subgraph(graph.nodes.where(F.col("ord") % 2 == 1)).edges.select("src", "dst")


@query(f"SELECT src, dst, weight FROM {PD}")
def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).edges.select("src", "dst", "weight")


@query(f"SELECT node_id FROM {PN} WHERE node_id NOT IN (SELECT src FROM {PM}) AND node_id NOT IN (SELECT dst FROM {PM})")
def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir, "part_dag_mr").isolated().select("node_id")


@query(f"SELECT 'no_isolated' AS rule, 'isolated node: ' || node_id AS message FROM {PN} WHERE node_id NOT IN (SELECT src FROM {PM}) AND node_id NOT IN (SELECT dst FROM {PM})")
def validator_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(part_graph(spark, sf_dir, "part_dag_mr"), [no_isolated]).select("rule", "message")


@query(f"SELECT (SELECT count(*) FROM {PN}) AS nodes, (SELECT count(*) FROM {PD}) AS edges")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).counts().drop("graph_id")


@query(f"SELECT src, dst, weight FROM {PD} WHERE src <> '{NODE}' AND dst <> '{NODE}'")
def without_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).without_node(NODE).edges.select("src", "dst", "weight")


@query(f"SELECT src, dst, weight FROM {PD} WHERE NOT (src = '{NODE}' AND dst = '3')")
def without_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).without_edge(NODE, "3").edges.select("src", "dst", "weight")


@query(f"SELECT CASE WHEN src = '{NODE}' THEN 'renamed' ELSE src END AS src, CASE WHEN dst = '{NODE}' THEN 'renamed' ELSE dst END AS dst, weight FROM {PD}")
def rename_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).with_node_replaced(NODE, "renamed").edges.select("src", "dst", "weight")


# layering and reachability: closures as recursive distinct unions


def _hops(dag: str) -> str:
    return f"h(node_id, d) AS (SELECT node_id, 0 FROM {PN} WHERE node_id NOT IN (SELECT dst FROM {dag}) UNION SELECT e.dst, h.d + 1 FROM h JOIN {dag} e ON e.src = h.node_id), lay AS (SELECT node_id, max(d)::BIGINT AS layer FROM h GROUP BY node_id)"


def _reach(start: str, dag: str, back: bool = False, closed: str | None = None, name: str = "r") -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    skip = f" WHERE e.{b} <> '{closed}'" if closed else ""
    return f"{name}(node_id) AS ({start} UNION SELECT e.{b} FROM {name} JOIN {dag} e ON e.{a} = {name}.node_id{skip})"


ORDER_SQL = "ranked AS (SELECT node_id, layer, (row_number() OVER (ORDER BY layer, node_id) - 1)::BIGINT AS pos FROM lay)"


@query(f"WITH RECURSIVE {_hops(PD)} SELECT node_id, layer FROM lay")
def topological_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.layers(part_graph(spark, sf_dir)).drop("graph_id")


@query(f"WITH RECURSIVE {_hops(PM)}, {ORDER_SQL} SELECT * FROM ranked")
def topological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.topological_order(part_graph(spark, sf_dir, "part_dag_mr")).drop("graph_id")


@query(f"WITH RECURSIVE {_reach(f"SELECT '{OTHER}'", PD, back=True)} SELECT node_id FROM r WHERE node_id <> '{OTHER}'")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ancestors(part_graph(spark, sf_dir), OTHER).select("node_id")


@query(f"WITH RECURSIVE {_reach(f"SELECT '{NODE}'", PD)} SELECT node_id FROM r WHERE node_id <> '{NODE}'")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.descendants(part_graph(spark, sf_dir), NODE).select("node_id")


_MR_ROOTS = f"SELECT node_id FROM {PN} WHERE node_id NOT IN (SELECT dst FROM {PM}) AND node_id <> '{MR_NODE}'"
_BOTH = f"WITH RECURSIVE {_reach(f"SELECT '{MR_NODE}'", PM)}, {_reach(_MR_ROOTS, PM, closed=MR_NODE, name='o')}"


@query(f"{_BOTH} SELECT node_id FROM r WHERE node_id NOT IN (SELECT node_id FROM o)")
def exclusive_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.exclusive_descendants(part_graph(spark, sf_dir, "part_dag_mr"), MR_NODE).select("node_id")


@query(f"{_BOTH} SELECT node_id FROM r WHERE node_id IN (SELECT node_id FROM o)")
def shared_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.shared_descendants(part_graph(spark, sf_dir, "part_dag_mr"), MR_NODE).select("node_id")


@query(f"WITH RECURSIVE {_reach(f"SELECT '{NODE}'", PD)} SELECT '{NODE}' AS src, '63' AS dst, EXISTS (SELECT 1 FROM r WHERE node_id = '63') AS found")
def path_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = P.reachable(part_graph(spark, sf_dir), [NODE]).agg(F.coalesce(F.bool_or(F.col("node_id") == "63"), F.lit(False)).alias("found"))
    return hit.select(F.lit(NODE).alias("src"), F.lit("63").alias("dst"), "found")


def _costs(start: str) -> str:
    return f"c(node_id, d) AS ({start} UNION SELECT e.dst, (c.d + e.weight)::BIGINT FROM c JOIN {PD} e ON e.src = c.node_id)"


@query(f"WITH RECURSIVE {_costs(f"SELECT '{NODE}', 0::BIGINT")} SELECT min(d) AS cost FROM c WHERE node_id = '63' HAVING count(*) > 0")
def shortest_path_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.path_summary(P.shortest_path(part_graph(spark, sf_dir), NODE, "63")).select("cost")


@query(f"WITH RECURSIVE {_costs(f"SELECT '{NODE}', 0::BIGINT")} SELECT max(d) AS cost FROM c WHERE node_id = '63' HAVING count(*) > 0")
def longest_path_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.path_summary(P.longest_path(part_graph(spark, sf_dir), NODE, "63")).select("cost")


@query(f"""WITH RECURSIVE {_hops(PD)}, {ORDER_SQL}, {_costs(f"SELECT node_id, 0::BIGINT FROM {PN} WHERE node_id NOT IN (SELECT dst FROM {PD})")},
best AS (SELECT node_id, max(d) AS cost FROM c GROUP BY node_id),
pred AS (SELECT e.dst AS node_id, arg_min(e.src, ranked.pos) AS before FROM {PD} e JOIN best a ON a.node_id = e.src JOIN best b ON b.node_id = e.dst JOIN ranked ON ranked.node_id = e.src WHERE a.cost + e.weight = b.cost GROUP BY e.dst),
last AS (SELECT best.node_id FROM best JOIN {PN} n ON n.node_id = best.node_id WHERE best.node_id NOT IN (SELECT src FROM {PD}) ORDER BY cost DESC, n.ord LIMIT 1),
way(node_id, back) AS (SELECT node_id, 0 FROM last UNION ALL SELECT pred.before, back + 1 FROM way JOIN pred ON pred.node_id = way.node_id)
SELECT (max(back) OVER () - back)::BIGINT AS pos, way.node_id, best.cost FROM way JOIN best ON best.node_id = way.node_id""")
def critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.critical_path(part_graph(spark, sf_dir)).drop("graph_id")


@query("SELECT node_id FROM (VALUES ('a'), ('b'), ('c'), ('d')) AS t(node_id)")
def cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle a-b-c with a node behind it, next to the acyclic graph of parts."""
    graph = part_graph(spark, sf_dir)
    extra = Graph.literal(spark, ["a", "b", "c", "d"], [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], graph_id="x")
    return P.cyclic_nodes(Graph(graph.nodes.unionByName(extra.nodes), graph.edges.unionByName(extra.edges))).select("node_id")


@query(f"""WITH RECURSIVE n AS (SELECT DISTINCT graph_id, node_id FROM {CN}), e AS (SELECT DISTINCT graph_id, src, dst FROM {CD}),
h(graph_id, node_id, d) AS (SELECT graph_id, node_id, 0 FROM n WHERE (graph_id, node_id) NOT IN (SELECT (graph_id, dst) FROM e) UNION SELECT e.graph_id, e.dst, h.d + 1 FROM h JOIN e ON e.graph_id = h.graph_id AND e.src = h.node_id)
SELECT graph_id, node_id, max(d)::BIGINT AS layer FROM h GROUP BY graph_id, node_id""")
def conversation_chains_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.layers(conv_graphs(spark, sf_dir))


@query(f"""WITH RECURSIVE n AS (SELECT DISTINCT graph_id, node_id FROM {CN}), e AS (SELECT * FROM {CD}),
c(graph_id, node_id, d) AS (SELECT graph_id, node_id, 0::BIGINT FROM n WHERE (graph_id, node_id) NOT IN (SELECT (graph_id, dst) FROM e) UNION SELECT e.graph_id, e.dst, (c.d + e.weight)::BIGINT FROM c JOIN e ON e.graph_id = c.graph_id AND e.src = c.node_id)
SELECT graph_id, max(d) AS cost FROM c GROUP BY graph_id""")
def per_graph_critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.path_summary(P.critical_path(conv_graphs(spark, sf_dir))).select("graph_id", "cost")


# mutation


@query(f"WITH RECURSIVE {_reach(f"SELECT '{NODE}'", PD)} SELECT node_id FROM r")
def plan_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.plan_invalidate(part_graph(spark, sf_dir), NODE).invalidated.select("node_id")


@query(f"{_BOTH} SELECT node_id FROM r WHERE node_id NOT IN (SELECT node_id FROM o)")
def plan_replace_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.removed_by(part_graph(spark, sf_dir, "part_dag_mr"), MR_NODE).select("node_id")


@query(f"{_BOTH} SELECT node_id FROM r WHERE node_id IN (SELECT node_id FROM o)")
def plan_replace_impacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.impacted_by(part_graph(spark, sf_dir, "part_dag_mr"), MR_NODE).select("node_id")


def _replacement(spark: SparkSession) -> M.Replacement:
    return M.Replacement(Graph.literal(spark, ["x1", "x2", "x3"], [("x1", "x2", 2), ("x1", "x3", 3)]), ("x1",), ("x2", "x3"))


@query(f"""{_BOTH}, gone AS (SELECT node_id FROM r WHERE node_id NOT IN (SELECT node_id FROM o)), e AS (SELECT * FROM {PM})
SELECT src, dst, weight FROM e WHERE src NOT IN (SELECT node_id FROM gone) AND dst NOT IN (SELECT node_id FROM gone)
UNION ALL SELECT * FROM (VALUES ('x1', 'x2', 2::BIGINT), ('x1', 'x3', 3::BIGINT)) v(src, dst, weight)
UNION ALL SELECT src, 'x1', weight FROM e WHERE dst = '{MR_NODE}' AND src NOT IN (SELECT node_id FROM gone)
UNION ALL SELECT x, dst, weight FROM (SELECT dst, min(weight) AS weight FROM e WHERE src IN (SELECT node_id FROM gone) AND dst NOT IN (SELECT node_id FROM gone) GROUP BY dst) s CROSS JOIN (VALUES ('x2'), ('x3')) t(x)""")
def replace_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.plan_replace_subtree(part_graph(spark, sf_dir, "part_dag_mr"), MR_NODE, _replacement(spark)).graph.edges.select("src", "dst", "weight")


CARRY_SQL = f"""(SELECT s.workflow_id, n.node_id, CASE WHEN n.node_id IN ('n1', 'n3') THEN 'invalidated' WHEN s.state IS NULL THEN 'pending' ELSE s.state END AS state
FROM (VALUES ('n0'), ('n1'), ('n2'), ('n3')) n(node_id) JOIN {ALL_STATES_SQL} s ON s.node_id = n.node_id
UNION ALL SELECT DISTINCT workflow_id, 'n4', 'pending' FROM {AT})"""


def _carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node n1 and those behind it are invalidated, n4 is new, in every workflow: the workflow is
    part of the node's name for this bulk form."""
    states = all_states(spark, sf_dir)
    named = F.concat_ws("|", "workflow_id", "node_id")
    old = states.select(named.alias("node_id"), "state")
    every = states.select("workflow_id").distinct().withColumn("node_id", F.explode(F.array(*[F.lit(f"n{i}") for i in range(5)]))).select(named.alias("node_id"))
    invalidated = states.where(F.col("node_id").isin("n1", "n3")).select(named.alias("node_id"))
    got = W.carry_forward(every, old, invalidated)
    parts = F.split("node_id", r"\|")
    return got.select(parts[0].alias("workflow_id"), parts[1].alias("node_id"), "state", "projected")


@query(f"SELECT * FROM {CARRY_SQL}")
def carry_forward_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _carried(spark, sf_dir).drop("projected")


@query(f"SELECT workflow_id, node_id FROM {CARRY_SQL} WHERE state = 'committed'")
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _carried(spark, sf_dir).where("projected").select("workflow_id", "node_id")


# values and rendering


@query("SELECT event_id, json_valid(props) AS safe FROM events")
def json_safe_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", V.is_json_safe(F.col("props")).alias("safe"))


@query("SELECT event_id, sha256(CAST(CAST(props AS JSON) AS VARCHAR)) AS fingerprint FROM (SELECT event_id, json_object('k', json_extract(props, '$.k')) AS props FROM events)")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", V.fingerprint(F.col("props")).alias("fingerprint"))


@query(f"SELECT 'nodes=' || (SELECT string_agg(node_id, ',' ORDER BY node_id) FROM {PN}) || ';edges=' || (SELECT string_agg(src || '>' || dst, ',' ORDER BY src, dst) FROM {PD}) AS text")
def canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).canonical().select("text")


@query(f"SELECT sha256('nodes=' || (SELECT string_agg(node_id, ',' ORDER BY node_id) FROM {PN}) || ';edges=' || (SELECT string_agg(src || '>' || dst, ',' ORDER BY src, dst) FROM {PD})) AS fingerprint")
def graph_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).fingerprint().select("fingerprint")


@query(f"""WITH RECURSIVE {_hops(PD)}, {ORDER_SQL}
SELECT 'node' AS kind, pos, '  "' || node_id || '";' AS line FROM ranked
UNION ALL SELECT 'edge', row_number() OVER (ORDER BY a.pos, b.pos) - 1, '  "' || src || '" -> "' || dst || '";' FROM {PD} e JOIN ranked a ON a.node_id = e.src JOIN ranked b ON b.node_id = e.dst""")
def dot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = part_graph(spark, sf_dir)
    return graph.dot_lines(P.topological_order(graph).select("graph_id", "node_id", "pos")).drop("graph_id")


@query(f"SELECT workflow_id, node_id, count(*) AS n, max(at_ms) - min(at_ms) AS span_ms FROM {EV} WHERE node_id IS NOT NULL GROUP BY ALL")
def node_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = relation(spark, sf_dir, "ev_log").where(F.col("node_id").isNotNull())
    return events.groupBy("workflow_id", "node_id").agg(F.count(F.lit(1)).alias("n"), (F.max("at_ms") - F.min("at_ms")).alias("span_ms"))


@query(f"SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src, dst ORDER BY weight) AS n FROM (SELECT * FROM {PD} UNION ALL SELECT src, dst, weight + 1 FROM {PD})) WHERE n = 1")
def build_first_edge_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = relation(spark, sf_dir, "part_dag")
    twice = edges.withColumn("ord", F.col("weight")).unionByName(edges.withColumn("weight", F.col("weight") + 1).withColumn("ord", F.col("weight")))
    return Graph.of(relation(spark, sf_dir, "part_nodes"), twice).edges.select("src", "dst")

