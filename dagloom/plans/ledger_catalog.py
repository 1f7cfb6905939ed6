"""Registered queries of the store's bulk forms, of changes to many graphs at once, of scalar functions
and of the scheduler, each with the DuckDB SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.fixtures import duck, relation
from dagloom.functions import values as V
from dagloom.kernel import runner as R
from dagloom.kernel import types as T
from dagloom.operators import paths as P
from dagloom.operators import rewrite as M
from dagloom.operators.graph import Graph
from dagloom.plans import ledger as L
from dagloom.plans import workflow as W
from dagloom.plans.catalog import (
    ALL_STATES_SQL,
    AT,
    CANON_SQL,
    CD,
    CLAIM_SQL,
    CN,
    EF,
    EV,
    LK,
    NODE,
    NOW_MS,
    ORDER_SQL,
    PD,
    PN,
    STATES_SQL,
    TERMINAL_SQL,
    WE,
    WF,
    WN,
    _hops,
    _reach,
    all_states,
    committed_values,
    conv_graphs,
    diagnostics_sql,
    part_graph,
    query,
    shown,
    wf_graph,
    with_reasons,
)

RV = duck("revisions")
KEYS = ["workflow_id", "revision", "node_id"]


def _same(a: str, b: str) -> str:
    return f"({a}.workflow_id, {a}.revision, {a}.node_id) = ({b}.workflow_id, {b}.revision, {b}.node_id)"


def _times(df: DataFrame, rows: list[tuple], *names: str) -> DataFrame:
    """df once for each of a few literal rows."""
    return df.withColumn("__r", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows]))).select("*", "__r.*").drop("__r")


# workflows and revisions


@query(f"""SELECT id, ord, CASE WHEN n = 1 AND NOT known THEN 'created' ELSE 'duplicate' END AS outcome FROM (
  SELECT r.id, r.ord, row_number() OVER (PARTITION BY r.id ORDER BY r.ord) AS n, w.id IS NOT NULL AS known
  FROM (SELECT workflow_id || '0' AS id, attempt_seq AS ord FROM {AT}) r LEFT JOIN {WF} w ON w.id = r.id)""")
def create_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = relation(spark, sf_dir, "attempts").select(F.concat("workflow_id", F.lit("0")).alias("id"), F.col("attempt_seq").alias("ord"))
    return L.create_workflows(relation(spark, sf_dir, "workflows"), requests)


@query(f"SELECT id, state, current_revision, workflow_retry_count FROM {WF} WHERE id IN ('wf-3', 'wf-11')")
def load_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "workflows").where(F.col("id").isin("wf-3", "wf-11")).select("id", "state", "current_revision", "workflow_retry_count")


@query(f"SELECT workflow_id, revision, definition FROM {RV} WHERE revision = 2")
def load_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "revisions").where("revision = 2")


@query(f"SELECT w.id, w.state, w.current_revision, r.definition FROM {WF} w JOIN {RV} r ON r.workflow_id = w.id AND r.revision = w.current_revision")
def current_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.current_definitions(relation(spark, sf_dir, "workflows"), relation(spark, sf_dir, "revisions")).select("id", "state", "current_revision", "definition")


@query(f"SELECT s.workflow_id, s.revision, s.node_id, s.state FROM {STATES_SQL} s JOIN {WF} w ON w.id = s.workflow_id AND w.current_revision = s.revision")
def current_node_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.current_states(relation(spark, sf_dir, "workflows"), W.node_states(relation(spark, sf_dir, "attempts")))


@query(f"""SELECT w.id, r.ord::BIGINT AS ord, r."from", r."to", CASE WHEN state = 'running' AND r.ord < 3 THEN 'done' WHEN state = 'failed' AND r.ord = 3 THEN 'done' ELSE 'stale' END AS outcome
FROM {WF} w CROSS JOIN (VALUES (1, 'running', 'waiting'), (2, 'waiting', 'completed'), (3, 'failed', 'pending')) r(ord, "from", "to")
UNION ALL SELECT 'none', 1, 'running', 'waiting', 'unknown'""")
def transition_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    workflows = relation(spark, sf_dir, "workflows")
    requests = _times(workflows.select("id"), [(1, "running", "waiting"), (2, "waiting", "completed"), (3, "failed", "pending")], "ord", "from", "to")
    unknown = spark.createDataFrame([("none", 1, "running", "waiting")], requests.schema)
    return L.transition_workflows(workflows, requests.unionByName(unknown))


@query(f"""SELECT s.workflow_id, s.revision, s.node_id, r.ord::BIGINT AS ord, r."from", r."to", CASE WHEN state = 'committed' OR (state = 'pending' AND r.ord = 3) THEN 'done' ELSE 'stale' END AS outcome
FROM {STATES_SQL} s CROSS JOIN (VALUES (1, 'committed', 'invalidated'), (2, 'invalidated', 'pending'), (3, 'pending', 'running')) r(ord, "from", "to")""")
def transition_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = W.node_states(relation(spark, sf_dir, "attempts"))
    return L.transition_nodes(states, _times(states.select(*KEYS), [(1, "committed", "invalidated"), (2, "invalidated", "pending"), (3, "pending", "running")], "ord", "from", "to"))


def _append_sql(guarded: bool) -> str:
    guard = "WHEN state = 'running' THEN 'concurrent' WHEN state = 'failed' THEN 'stale_state'" if guarded else ""
    return f"""SELECT id, parent_revision, ord, outcome, CASE WHEN outcome = 'appended' THEN parent_revision + 1 END AS revision FROM (
  SELECT id, 2::BIGINT AS parent_revision, r.ord, CASE {guard} WHEN current_revision <> 2 OR r.ord > 1 THEN 'stale_revision' ELSE 'appended' END AS outcome
  FROM {WF} CROSS JOIN (VALUES (1), (2)) r(ord))"""


def _appended(spark: SparkSession, sf_dir: str, allowed: tuple[str, ...] | None) -> DataFrame:
    workflows = relation(spark, sf_dir, "workflows")
    requests = _times(workflows.select("id", F.lit(2).cast("long").alias("parent_revision")), [(1,), (2,)], "ord")
    return L.append_revisions(workflows, requests, allowed)


@query(_append_sql(False))
def append_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(spark, sf_dir, None)


@query(_append_sql(True))
def append_revisions_if_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(spark, sf_dir, ("paused", "waiting"))


# attempts

BEGIN_SQL = f"""SELECT q.workflow_id, 1::BIGINT AS revision, q.node_id, CASE WHEN s.state = 'pending' THEN 'begun' WHEN s.state IS NULL THEN 'unknown' ELSE 'stale' END AS outcome,
  CASE WHEN s.state = 'pending' THEN (l.last + count(*) FILTER (s.state = 'pending') OVER (PARTITION BY q.workflow_id ORDER BY q.node_id ROWS UNBOUNDED PRECEDING))::BIGINT END AS attempt_seq,
  CASE WHEN s.state = 'pending' THEN (1 + coalesce(t.n, 0))::BIGINT END AS attempt_number
FROM (SELECT DISTINCT a.workflow_id, n.node_id FROM {AT} a CROSS JOIN {WN} n) q JOIN (SELECT workflow_id, max(attempt_seq) AS last FROM {AT} GROUP BY workflow_id) l ON l.workflow_id = q.workflow_id
LEFT JOIN {STATES_SQL} s ON s.workflow_id = q.workflow_id AND s.node_id = q.node_id
LEFT JOIN (SELECT workflow_id, node_id, count(*) FILTER (state <> 'aborted') AS n FROM {AT} GROUP BY ALL) t ON t.workflow_id = q.workflow_id AND t.node_id = q.node_id"""


@query(f"SELECT *, CASE WHEN outcome = 'begun' THEN workflow_id || '/' || attempt_seq ELSE '' END AS attempt_id FROM ({BEGIN_SQL})")
def begin_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = relation(spark, sf_dir, "attempts")
    requests = attempts.select("workflow_id", F.lit(1).cast("long").alias("revision")).distinct().withColumn("node_id", F.explode(F.array(*[F.lit(f"n{i}") for i in range(4)]))).withColumn("expected", F.lit("pending"))
    return L.begin_attempts(W.node_states(attempts), attempts, requests)


COMMIT_SQL = f"""SELECT attempt_id, workflow_id, revision, node_id, CASE WHEN ok THEN 'done' ELSE 'stale' END AS outcome, CASE WHEN ok THEN st END AS attempt_state,
  CASE WHEN ok THEN CASE WHEN kind = 'failure' AND retriable AND attempt_number < 2 THEN 'pending' ELSE st END END AS node_state, CASE WHEN ok THEN 'node_' || st END AS event_type
FROM (SELECT *, state = 'waiting' AS ok, CASE attempt_seq % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'waiting' ELSE 'failure' END AS kind, attempt_seq % 2 = 0 AS retriable,
  CASE attempt_seq % 3 WHEN 0 THEN 'committed' WHEN 1 THEN 'waiting' ELSE 'failed' END AS st FROM {AT})"""


def _running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts whose waiting ones are still running."""
    return relation(spark, sf_dir, "attempts").withColumn("state", F.when(F.col("state") == "waiting", "running").otherwise(F.col("state")))


@query(COMMIT_SQL)
def commit_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = _running(spark, sf_dir)
    part = F.col("attempt_seq") % 3
    kind = F.when(part == 0, "success").when(part == 1, "waiting").otherwise("failure")
    return L.commit_attempts(attempts, attempts.select("attempt_id", kind.alias("kind"), (F.col("attempt_seq") % 2 == 0).alias("retriable")), 2)


@query(f"""SELECT 'attempt' AS kind, workflow_id, attempt_id AS name FROM {AT} WHERE state = 'waiting'
UNION ALL SELECT 'node', workflow_id, node_id FROM {STATES_SQL} WHERE state = 'waiting'""")
def abort_running_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = _running(spark, sf_dir)
    aborted, nodes = W.abort_running(attempts, W.node_states(attempts))
    return aborted.select(F.lit("attempt").alias("kind"), "workflow_id", F.col("attempt_id").alias("name")).unionByName(nodes.select(F.lit("node").alias("kind"), "workflow_id", F.col("node_id").alias("name")))


@query(f"SELECT workflow_id, revision, node_id FROM {STATES_SQL} WHERE state = 'failed'")
def retry_reset_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = relation(spark, sf_dir, "attempts")
    return W.retry_reset(attempts, W.node_states(attempts))[1]


@query(f"""SELECT id, outcome, CASE WHEN outcome = 'reset' THEN workflow_retry_count + 1 ELSE workflow_retry_count END AS workflow_retry_count, CASE WHEN outcome = 'reset' THEN coalesce(f, '') END AS reset
FROM (SELECT *, CASE WHEN state <> 'failed' THEN 'stale' WHEN workflow_retry_count >= max_workflow_retries THEN 'exhausted' ELSE 'reset' END AS outcome FROM {WF}) w
LEFT JOIN (SELECT workflow_id, string_agg(node_id, ',' ORDER BY node_id) AS f FROM {STATES_SQL} WHERE state = 'failed' GROUP BY workflow_id) s ON s.workflow_id = w.id""")
def prepare_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.prepare_retries(relation(spark, sf_dir, "workflows"), W.node_states(relation(spark, sf_dir, "attempts")))


# events


@query(f"""SELECT e.workflow_id, e.type, (coalesce(l.last, 0) + row_number() OVER (PARTITION BY e.workflow_id ORDER BY e.seq))::BIGINT AS seq
FROM {EV} e LEFT JOIN (SELECT workflow_id, max(seq) AS last FROM {EV} WHERE seq <= 4 GROUP BY workflow_id) l ON l.workflow_id = e.workflow_id WHERE e.seq > 4 AND e.seq % 2 = 0""")
def append_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = relation(spark, sf_dir, "ev_log")
    new = log.where("seq > 4 AND seq % 2 = 0").select("workflow_id", "type", F.col("seq").alias("ord"))
    return L.append_events(log.where("seq <= 4"), new).select("workflow_id", "type", "seq")


@query(f"""SELECT workflow_id, seq, 'attempt_id' AS field FROM {EV} e WHERE NOT EXISTS (SELECT 1 FROM {AT} a WHERE a.workflow_id = e.workflow_id AND a.attempt_seq = e.seq % 9)
UNION ALL SELECT workflow_id, seq, 'node_id' FROM {EV} WHERE node_id = 'n4'""")
def event_attempt_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = relation(spark, sf_dir, "ev_log").withColumn("attempt_id", F.concat_ws("/", "workflow_id", (F.col("seq") % 9).cast("string")))
    revisions = events.select("workflow_id", "revision").distinct()
    nodes = revisions.withColumn("node_id", F.explode(F.array(*[F.lit(f"n{i}") for i in range(4)])))
    return W.coordinate_violations(events, revisions, nodes, relation(spark, sf_dir, "attempts"))


# effects


@query(f"""SELECT l.attempt_id, l.effect_id, f.type || ':' || f.key AS ref, f.status, l.blocking, row_number() OVER (PARTITION BY l.attempt_id ORDER BY l.link_seq, l.effect_id) AS place
FROM {LK} l JOIN {EF} f ON f.effect_id = l.effect_id""")
def effects_for_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.effects_of_attempts(relation(spark, sf_dir, "attempt_effects"), relation(spark, sf_dir, "effects"))
    return found.select("attempt_id", "effect_id", F.concat_ws(":", "type", "key").alias("ref"), "status", "blocking", F.col("place").cast("long").alias("place"))


@query(f"""SELECT workflow_id, revision, node_id, string_agg(ref || '=' || status, ',' ORDER BY ref || '=' || status) AS snapshot FROM (
  SELECT DISTINCT l.workflow_id, l.revision, l.node_id, f.type || ':' || f.key AS ref, f.status FROM {LK} l JOIN {EF} f ON f.effect_id = l.effect_id) GROUP BY ALL""")
def effect_snapshots_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.snapshots(relation(spark, sf_dir, "attempt_effects"), relation(spark, sf_dir, "effects"))
    pairs = F.array_sort(F.transform(F.map_entries("snapshot"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select(*KEYS, F.array_join(pairs, ",").alias("snapshot"))


@query(f"""SELECT effect_id, 'dispatching' AS status, 'w9' AS lease_owner, {NOW_MS + 30}::BIGINT AS lease_until_ms, {NOW_MS}::BIGINT AS updated_at_ms FROM (
  SELECT effect_id FROM {EF} WHERE {CLAIM_SQL} ORDER BY effect_seq LIMIT 50)""")
def claim_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = W.claim_ready(relation(spark, sf_dir, "effects"), NOW_MS, 50)
    return L.claim(ready, "w9", 30, NOW_MS).select("effect_id", "status", "lease_owner", "lease_until_ms", "updated_at_ms")


@query(f"""SELECT workflow_id, effect_id, place FROM (SELECT l.workflow_id, e.effect_id, row_number() OVER (PARTITION BY l.workflow_id ORDER BY e.effect_seq) AS place
  FROM (SELECT DISTINCT workflow_id, effect_id FROM {LK}) l JOIN {EF} e ON e.effect_id = l.effect_id WHERE {CLAIM_SQL}) WHERE place <= 2""")
def claim_scoped_to_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.claim_by_workflow(relation(spark, sf_dir, "effects"), relation(spark, sf_dir, "attempt_effects"), NOW_MS, 2)
    return found.select("workflow_id", "effect_id", F.col("place").cast("long").alias("place"))


LEASED = f"(status = 'dispatching' AND lease_owner = 'w1' AND lease_until_ms >= {NOW_MS})"
DONE_SQL = f"""(SELECT effect_id, CASE WHEN ok THEN 'done' ELSE 'stale_lease' END AS outcome, CASE WHEN ok THEN st END AS status,
  CASE WHEN ok AND st = 'failed_retriable' THEN 500 + effect_seq END AS not_before_ms FROM (
  SELECT effect_id, effect_seq, coalesce({LEASED}, false) AS ok, CASE WHEN effect_seq % 3 = 0 THEN 'succeeded' WHEN effect_seq % 5 < 2 THEN 'failed_retriable' ELSE 'failed_terminal' END AS st FROM {EF})
  UNION ALL SELECT 'effect/none', 'unknown', NULL, NULL)"""


def _completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = relation(spark, sf_dir, "effects")
    seq = F.col("effect_seq")
    outcomes = effects.select("effect_id", (seq % 3 == 0).alias("succeeded"), (seq % 5 < 2).alias("retriable"), (seq + 500).alias("retry_at_ms"))
    unknown = spark.createDataFrame([("effect/none", True, False, 1)], outcomes.schema)
    return L.complete_effects(effects, outcomes.unionByName(unknown), "w1", NOW_MS)


@query(f"SELECT * FROM {DONE_SQL}")
def complete_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _completed(spark, sf_dir)


@query(f"SELECT outcome, status, count(*) AS n FROM {DONE_SQL} GROUP BY ALL")
def dispatch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dispatch_report(_completed(spark, sf_dir))


@query(f"""SELECT effect_id, outcome, CASE WHEN outcome = 'renewed' THEN until_ms ELSE lease_until_ms END AS lease_until_ms FROM (
  SELECT effect_id, lease_until_ms, until_ms, CASE WHEN NOT coalesce({LEASED}, false) THEN 'stale_lease' WHEN until_ms <= {NOW_MS} OR until_ms < lease_until_ms THEN 'invalid'
    WHEN until_ms = lease_until_ms THEN 'same' ELSE 'renewed' END AS outcome FROM (SELECT *, lease_until_ms + (effect_seq % 3 - 1) * 10 AS until_ms FROM {EF}))""")
def renew_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = relation(spark, sf_dir, "effects")
    requests = effects.select("effect_id", (F.col("lease_until_ms") + (F.col("effect_seq") % 3 - 1) * 10).alias("until_ms"))
    return L.renew_leases(effects, requests, "w1", NOW_MS)


@query(f"""WITH d AS (SELECT effect_id, status FROM {DONE_SQL} WHERE status IN ('succeeded', 'failed_terminal')),
b AS (SELECT l.*, coalesce(d.status, f.status) AS status, d.effect_id IS NOT NULL AS fresh FROM {LK} l JOIN {EF} f ON f.effect_id = l.effect_id LEFT JOIN d ON d.effect_id = l.effect_id WHERE l.blocking)
SELECT b.workflow_id, b.revision, b.node_id, b.attempt_id FROM b JOIN {STATES_SQL} s ON {_same("s", "b")} WHERE s.state = 'waiting' GROUP BY ALL HAVING bool_and({TERMINAL_SQL}) AND bool_or(fresh)""")
def release_after_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = W.node_states(relation(spark, sf_dir, "attempts"))
    return L.release_after(relation(spark, sf_dir, "attempt_effects"), relation(spark, sf_dir, "effects"), states, _completed(spark, sf_dir))


# diagnostics and inputs of steps


@query(diagnostics_sql(ALL_STATES_SQL))
def full_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = with_reasons(relation(spark, sf_dir, "attempts"))
    nodes = attempts.select("workflow_id", F.lit(1).cast("long").alias("revision")).distinct().withColumn("node_id", F.explode(F.array(*[F.lit(f"n{i}") for i in range(4)])))
    return shown(L.full_diagnostics(nodes, W.node_states(attempts), attempts, relation(spark, sf_dir, "attempt_effects"), relation(spark, sf_dir, "effects")))


@query(f"""SELECT workflow_id, revision, node_id, attempt_id AS last_waiting_attempt_id, 'r' || attempt_seq AS waiting_reason FROM (SELECT *, row_number() OVER (
  PARTITION BY workflow_id, revision, node_id ORDER BY attempt_number DESC, attempt_id DESC) AS n FROM {AT} WHERE state = 'waiting') WHERE n = 1""")
def last_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.waiting_reasons(relation(spark, sf_dir, "attempts").withColumn("reason", F.concat(F.lit("r"), "attempt_seq")))


PROJECTED_SQL = f"""(SELECT workflow_id, node_id, value FROM {CANON_SQL} UNION ALL
  SELECT s.workflow_id, s.node_id, 'p-' || s.node_id FROM {ALL_STATES_SQL} s WHERE s.node_id = 'n1' AND (s.workflow_id, s.node_id) NOT IN (SELECT (workflow_id, node_id) FROM {CANON_SQL}))"""


@query(f"SELECT p.workflow_id, e.dst AS node_id, e.src AS predecessor, p.value FROM {PROJECTED_SQL} p JOIN {WE} e ON e.src = p.node_id")
def predecessor_results_with_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node n1 of every workflow is committed by a projection; an attempt of its own goes first."""
    committed = committed_values(spark, sf_dir).select("workflow_id", "node_id", "value")
    projected = all_states(spark, sf_dir).where("node_id = 'n1'").select("workflow_id", "node_id", F.concat(F.lit("p-"), "node_id").alias("value"))
    states = projected.select("workflow_id", "node_id", F.lit("committed").alias("state"))
    return W.predecessor_results(committed, F.broadcast(wf_graph(spark).edges.select("src", "dst")), projected, states)


@query(f"""SELECT workflow_id, node_id, string_agg(predecessor || '=' || value, ',' ORDER BY predecessor) AS snapshots FROM (
  SELECT c.workflow_id, e.dst AS node_id, e.src AS predecessor, c.value FROM {CANON_SQL} c JOIN {WE} e ON e.src = c.node_id) GROUP BY workflow_id, node_id""")
def predecessor_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = W.predecessor_results(committed_values(spark, sf_dir).select("workflow_id", "node_id", "value"), F.broadcast(wf_graph(spark).edges.select("src", "dst")))
    one = got.groupBy("workflow_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("predecessor", "value"))).alias("p"))
    return one.select("workflow_id", "node_id", F.array_join(F.transform("p", lambda x: F.concat(x["predecessor"], F.lit("="), x["value"])), ",").alias("snapshots"))


# graphs


@query(f"""SELECT graph_id, node_id, EXISTS (SELECT 1 FROM {CN} c WHERE c.graph_id = a.graph_id AND c.node_id = a.node_id) AS known
FROM (SELECT DISTINCT graph_id, CAST(ord + 1 AS VARCHAR) AS node_id FROM {CN}) a""")
def known_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = conv_graphs(spark, sf_dir)
    return graphs.known_nodes(graphs.nodes.select("graph_id", (F.col("ord") + 1).cast("string").alias("node_id")).distinct())


@query(f"""SELECT graph_id, src, dst, EXISTS (SELECT 1 FROM {CD} c WHERE c.graph_id = a.graph_id AND c.src = a.src AND c.dst = a.dst) AS known
FROM (SELECT DISTINCT graph_id, node_id AS src, CAST(ord + 1 AS VARCHAR) AS dst FROM {CN}) a""")
def known_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = conv_graphs(spark, sf_dir)
    return graphs.known_edges(graphs.nodes.select("graph_id", F.col("node_id").alias("src"), (F.col("ord") + 1).cast("string").alias("dst")).distinct())


def _tagged(spark: SparkSession, sf_dir: str) -> Graph:
    """Conversation graphs whose even edges have metadata."""
    edges = relation(spark, sf_dir, "conv_dag").distinct().withColumn("metadata", F.when(F.col("src").cast("long") % 2 == 0, F.concat(F.lit('{"weight":'), (F.col("weight") / 4).cast("string"), F.lit("}"))))
    return Graph.of(relation(spark, sf_dir, "conv_nodes"), edges.drop("weight"))


@query(f"SELECT graph_id, CASE WHEN CAST(src AS BIGINT) % 2 = 0 THEN '{{\"weight\":' || CAST(weight / 4 AS VARCHAR) || '}}' ELSE '{{}}' END AS metadata FROM (SELECT DISTINCT * FROM {CD}) WHERE src = '2' AND dst = '3'")
def edge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).edge_metadata("2", "3")


@query(f"""SELECT graph_id, 'Edge(' || src || ' -> ' || dst || CASE WHEN CAST(src AS BIGINT) % 2 = 0 THEN ', {{"weight":' || CAST(weight / 4 AS VARCHAR) || '}}' ELSE '' END || ')' AS text FROM (SELECT DISTINCT * FROM {CD})
UNION ALL SELECT n.graph_id, 'Graph(nodes=' || n.n || ', edges=' || coalesce(e.n, 0) || ')' FROM (SELECT graph_id, count(DISTINCT node_id) AS n FROM {CN} GROUP BY ALL) n
LEFT JOIN (SELECT graph_id, count(*) AS n FROM (SELECT DISTINCT graph_id, src, dst FROM {CD}) GROUP BY ALL) e ON e.graph_id = n.graph_id""")
def graphs_and_edges_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = _tagged(spark, sf_dir)
    return graphs.edges_shown().unionByName(graphs.shown())


@query(f"""WITH RECURSIVE n AS (SELECT DISTINCT graph_id, node_id FROM {CN}), e AS (SELECT graph_id, src, dst, CASE WHEN CAST(src AS BIGINT) % 2 = 0 THEN weight / 4 ELSE 1.0::DOUBLE END AS weight FROM (SELECT DISTINCT * FROM {CD})),
c(graph_id, node_id, d) AS (SELECT graph_id, node_id, 0::DOUBLE FROM n WHERE (graph_id, node_id) NOT IN (SELECT (graph_id, dst) FROM e) UNION SELECT e.graph_id, e.dst, c.d + e.weight FROM c JOIN e ON e.graph_id = c.graph_id AND e.src = c.node_id)
SELECT graph_id, max(d) AS cost FROM c GROUP BY graph_id""")
def metadata_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.path_summary(P.critical_path(_tagged(spark, sf_dir))).select("graph_id", "cost")


@query(f"SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY ord) AS place FROM (SELECT DISTINCT * FROM {CN})")
def nodes_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = conv_graphs(spark, sf_dir).each_node()
    names = ordered.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("ord", "node_id"))).alias("n"))
    return names.select("graph_id", F.posexplode("n").alias("place", "n")).select("graph_id", "n.node_id", (F.col("place") + 1).cast("long").alias("place"))


@query(f"SELECT graph_id, 'nodes=' || string_agg(node_id, ',' ORDER BY node_id) || ';edges=' || coalesce(any_value(edges), '') AS text, sha256('nodes=' || string_agg(node_id, ',' ORDER BY node_id) || ';edges=' || coalesce(any_value(edges), '')) AS fingerprint FROM (SELECT DISTINCT graph_id, node_id FROM {CN}) n LEFT JOIN (SELECT graph_id, string_agg(src || '>' || dst || CASE WHEN CAST(src AS BIGINT) % 2 = 0 THEN '|{{\"weight\":' || CAST(weight / 4 AS VARCHAR) || '}}' ELSE '' END, ',' ORDER BY src, dst) AS edges FROM (SELECT DISTINCT * FROM {CD}) GROUP BY graph_id) e USING (graph_id) GROUP BY graph_id")
def definition_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = _tagged(spark, sf_dir)
    return graphs.canonical().join(graphs.fingerprint(), "graph_id")


GONE = f"""WITH RECURSIVE n AS (SELECT DISTINCT graph_id, node_id FROM {CN}), e AS (SELECT DISTINCT * FROM {CD}),
gone(graph_id, node_id) AS (SELECT graph_id, node_id FROM n WHERE node_id = '2' UNION SELECT e.graph_id, e.dst FROM gone JOIN e ON e.graph_id = gone.graph_id AND e.src = gone.node_id)"""


@query(f"""{GONE} SELECT graph_id, src, dst, weight FROM e WHERE (graph_id, src) NOT IN (SELECT (graph_id, node_id) FROM gone) AND (graph_id, dst) NOT IN (SELECT (graph_id, node_id) FROM gone)
UNION ALL SELECT graph_id, src, 'x', weight FROM e WHERE dst = '2' UNION ALL SELECT graph_id, 'x', 'y', 5 FROM n WHERE node_id = '2'""")
def replace_in_every_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = M.Replacement(Graph.literal(spark, ["x", "y"], [("x", "y", 5)]), ("x",), ("y",))
    return M.plan_replace_subtree(conv_graphs(spark, sf_dir), "2", new).graph.edges.select("graph_id", "src", "dst", "weight")


@query(f"{GONE} SELECT graph_id, node_id, 'old' AS step_type FROM n WHERE (graph_id, node_id) NOT IN (SELECT (graph_id, node_id) FROM gone) UNION ALL SELECT graph_id, x, 'noop' FROM n, (VALUES ('x'), ('y')) t(x) WHERE node_id = '2'")
def step_types_after_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = conv_graphs(spark, sf_dir)
    new = M.Replacement(Graph.literal(spark, ["x", "y"], [("x", "y", 5)]), ("x",), ("y",))
    old = graphs.nodes.select("graph_id", "node_id", F.lit("old").alias("step_type"))
    return M.step_types(old, M.plan_replace_subtree(graphs, "2", new).graph)


@query(f"SELECT graph_id, CASE WHEN node_id = '2' THEN 'two' ELSE node_id END AS node_id, CASE WHEN node_id = '2' THEN max(ord) OVER (PARTITION BY graph_id) + 1 ELSE ord END AS ord FROM (SELECT DISTINCT * FROM {CN})")
def rename_in_every_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_graphs(spark, sf_dir).with_node_replaced("2", "two").nodes.select("graph_id", "node_id", "ord")


@query(f"SELECT src, dst, weight FROM {PD} UNION ALL SELECT 'new', '{NODE}', 7")
def with_node_and_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).with_node("new").with_edge("new", NODE, weight=7).edges.select("src", "dst", "weight")


@query(f"SELECT src, dst, min(weight) AS weight FROM {PD} GROUP BY src, dst")
def build_keeps_first_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = relation(spark, sf_dir, "part_dag")
    twice = edges.withColumn("ord", F.col("weight")).unionByName(edges.withColumn("weight", F.col("weight") + 1).withColumn("ord", F.col("weight")))
    return Graph.of(relation(spark, sf_dir, "part_nodes"), twice).edges.select("src", "dst", "weight")


@query("SELECT true AS same, false AS other")
def graphs_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = part_graph(spark, sf_dir)
    return spark.createDataFrame([(graph.same_as(graph.frozen()), graph.same_as(graph.without_edge(NODE, "3")))], "same boolean, other boolean")


@query(f"WITH RECURSIVE {_hops(PD)} SELECT node_id, layer FROM lay")
def layers_by_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.layers(part_graph(spark, sf_dir), "loop").drop("graph_id")


@query(f"WITH RECURSIVE {_reach(f"SELECT '{NODE}'", PD)} SELECT node_id FROM r WHERE node_id <> '{NODE}'")
def descendants_by_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.descendants(part_graph(spark, sf_dir), NODE, strategy="loop").select("node_id")


def _best(longest: bool) -> str:
    """Cost and predecessor of every node from NODE, at a quarter of the weights."""
    pick = "max" if longest else "min"
    return f"""{_hops(PD)}, {ORDER_SQL}, q AS (SELECT src, dst, weight / 4 AS weight FROM {PD}),
c(node_id, d) AS (SELECT '{NODE}', 0::DOUBLE UNION SELECT q.dst, c.d + q.weight FROM c JOIN q ON q.src = c.node_id),
best AS (SELECT node_id, {pick}(d) AS cost FROM c GROUP BY node_id),
pred AS (SELECT q.dst AS node_id, arg_min(q.src, ranked.pos) AS before FROM q JOIN best a ON a.node_id = q.src JOIN best b ON b.node_id = q.dst JOIN ranked ON ranked.node_id = q.src WHERE a.cost + q.weight = b.cost GROUP BY q.dst)"""


def _way(longest: bool) -> str:
    return f"""WITH RECURSIVE {_best(longest)}, way(node_id, back) AS (SELECT '63', 0 FROM best WHERE node_id = '63' UNION ALL SELECT pred.before, back + 1 FROM way JOIN pred ON pred.node_id = way.node_id)
SELECT (max(back) OVER () - back)::BIGINT AS pos, way.node_id, best.cost FROM way JOIN best ON best.node_id = way.node_id"""


def _quarters(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.trusted(relation(spark, sf_dir, "part_nodes"), relation(spark, sf_dir, "part_dag").withColumn("weight", F.col("weight") / 4))


@query(_way(False))
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.shortest_path(_quarters(spark, sf_dir), NODE, "63").drop("graph_id")


@query(_way(True))
def longest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.longest_path(_quarters(spark, sf_dir), NODE, "63").drop("graph_id")


@query(f"WITH RECURSIVE {_best(True)} SELECT best.node_id, best.cost, pred.before FROM best LEFT JOIN pred ON pred.node_id = best.node_id")
def costs_by_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.relax_loop(_quarters(spark, sf_dir), NODE, longest=True).drop("graph_id")


# values

SORTED = "'{\"a\":{\"x\":[1,2],\"y\":\"' || event_type || '\"},\"b\":' || event_id || '}'"


def _unsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat(F.lit('{"b": '), "event_id", F.lit(', "a": {"y": "'), "event_type", F.lit('", "x": [1, 2]}}'))
    return events.select("event_id", text.alias("text"))


@query(f"SELECT event_id, {SORTED} AS text, sha256({SORTED}) AS fingerprint FROM events")
def serialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unsorted(spark, sf_dir).select("event_id", V.canonical_json(F.col("text")).alias("text"), V.fingerprint(F.col("text")).alias("fingerprint"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'failed_retriable' ELSE 'failed_terminal' END AS status, event_type AS seen, CASE event_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN event_type END AS code, (event_id * 1500)::BIGINT AS ms FROM events")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    part = F.col("event_id") % 3
    error = F.when(part == 0, F.lit('"plain"')).when(part == 1, F.concat(F.lit('{"code":"'), "event_type", F.lit('"}'))).otherwise(F.lit('{"code":{"no":"scalar"}}'))
    snapshot = F.create_map(F.lit("value"), F.col("event_type"))
    return events.select(
        "event_id",
        V.failure_status(F.col("event_id") % 2 == 0).alias("status"),
        V.snapshot_value(snapshot, "value").alias("seen"),
        V.error_code(error).alias("code"),
        V.millis(F.col("event_id") * F.lit(1.5)).alias("ms"),
    )


@query("""SELECT event_id, event_type AS got, CASE WHEN event_id % 2 = 0 THEN 'a,type' ELSE 'type' END AS keys, event_id % 2 = 0 AS has_a, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS size, event_type AS dug,
event_type AS fetched, CASE WHEN event_id % 2 = 0 THEN 'a=1,' ELSE '' END || 'type=' || event_type AS entries, event_id % 2 <> 0 AS same, false AS empty FROM events""")
def context_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    one = F.create_map(F.lit("type"), F.col("event_type"))
    context = F.when(F.col("event_id") % 2 == 0, W.merge(F.create_map(F.lit("a"), F.lit("1")), one)).otherwise(one)
    nested = F.concat(F.lit('{"x.y":{"type":"'), "event_type", F.lit('"}}'))
    return events.select(
        "event_id",
        V.context_get(context, "type").alias("got"),
        F.array_join(V.context_keys(context), ",").alias("keys"),
        V.context_has(context, "a").alias("has_a"),
        V.context_size(context).alias("size"),
        V.context_dig(nested, "x.y", "type").alias("dug"),
        V.context_fetch(context, "type").alias("fetched"),
        F.array_join(F.transform(V.context_entries(context), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("entries"),
        V.context_equal(context, one).alias("same"),
        V.context_empty(context).alias("empty"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ok ' || event_type ELSE 'err boom' END AS either, CASE WHEN event_id % 2 = 0 THEN event_type || '!' END AS mapped,
  CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'saved boom' END AS recovered FROM events""")
def result_combinators(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    good = F.col("event_id") % 2 == 0
    result = F.struct(F.when(good, "success").otherwise("failure").alias("kind"), F.when(good, F.col("event_type")).alias("value"), F.when(~good, "boom").alias("error"))
    return events.select(
        "event_id",
        V.on_success(result, lambda v: F.concat(F.lit("ok "), v), lambda e: F.concat(F.lit("err "), e)).alias("either"),
        V.map_value(result, lambda v: F.concat(v, F.lit("!")))["value"].alias("mapped"),
        V.unwrap(V.recover(result, lambda e: F.concat(F.lit("saved "), e))).alias("recovered"),
    )


# the scheduler, on workflows of every kind of outcome


class _Ticks(R.Clock):
    """One millisecond a call."""

    def __init__(self) -> None:
        self.at = 0

    def now_ms(self) -> int:
        self.at += 1
        return self.at


def _flaky(retriable: bool):
    left = [1]

    def step(given: T.StepInput, config: dict) -> T.Result:
        if left[0]:
            left[0] = 0
            return T.Failure({"code": "flaky"}, retriable)
        return T.Success("ok")

    return step


def _ran(spark: SparkSession) -> R.Kit:
    """chain: to its end. flaky: a retriable failure. ask: waits for an effect that a dispatcher
    serves. again: fails and is retried as a whole. edit: pauses for a mutation. bad: raises."""
    kit = R.kit(spark, None, _Ticks())
    intent = T.Intent("mail", "k1", {"to": "x"})

    def bad(given: T.StepInput, config: dict) -> T.Result:
        raise ValueError("no")

    kit.registry.register("flaky", _flaky(True))
    kit.registry.register("once", _flaky(False))
    kit.registry.register("ask", lambda s, c: T.await_effect(s, intent, lambda v: T.Success(v)))
    kit.registry.register("edit", lambda s, c: T.Success(mutations=(T.Mutation("invalidate", "b"),)))
    kit.registry.register("bad", bad)

    def chain(a: str, b: str) -> T.Definition:
        return T.Definition().add_node("a", a).add_node("b", b).add_edge("a", "b")

    for name, definition, retries in (
        ("chain", chain("noop", "passthrough"), 0),
        ("flaky", chain("flaky", "noop"), 0),
        ("ask", chain("ask", "noop"), 0),
        ("again", chain("once", "noop"), 1),
        ("edit", chain("edit", "noop"), 0),
        ("bad", chain("bad", "noop"), 0),
    ):
        kit.store.create_workflow(name, definition, {"k": 1}, T.RuntimeProfile(max_workflow_retries=retries))
        kit.runner.call(name)
    R.Dispatcher(kit.store, {"mail": lambda e: T.HandlerResult.succeeded({"sent": True})}, "w1", clock=_Ticks()).tick()
    kit.runner.resume("ask")
    kit.runner.retry_workflow("again")
    kit.mutations.apply("edit", T.Mutation("invalidate", "b"), 1)
    kit.runner.resume("edit")
    return kit


def _values(columns: str, rows: list[tuple]) -> str:
    text = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::BIGINT" for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {text}) t({columns})"


def _log(workflow: str, *events: str) -> list[tuple]:
    """type or type:node, in order."""
    return [(workflow, i, *(e.split(":") if ":" in e else (e, None))) for i, e in enumerate(events, 1)]


_B = ("node_started:b", "node_committed:b", "workflow_completed")
_EVENTS = [
    *_log("chain", "workflow_started", "node_started:a", "node_committed:a", *_B),
    *_log("flaky", "workflow_started", "node_started:a", "node_failed:a", "node_started:a", "node_committed:a", *_B),
    *_log("ask", "workflow_started", "node_started:a", "node_waiting:a", "workflow_waiting", "node_started:a", "node_committed:a", *_B),
    *_log("again", "workflow_started", "node_started:a", "node_failed:a", "workflow_failed", "node_started:a", "node_committed:a", *_B),
    *_log("edit", "workflow_started", "node_started:a", "node_committed:a", "workflow_paused", "mutation_applied", *_B),
    *_log("bad", "workflow_started", "node_started:a", "node_failed:a", "workflow_failed"),
]


@query(_values("workflow_id, seq, type, node_id", _EVENTS))
def scheduler_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ran(spark).store.table("events").select("workflow_id", "seq", "type", "node_id")


_DONE = ("chain", "flaky", "ask", "again", "edit")


@query(_values("workflow_id, attempt_seq, node_id, attempt_number, state", [
    ("chain", 1, "a", 1, "committed"), ("chain", 2, "b", 1, "committed"), ("flaky", 1, "a", 1, "failed"), ("flaky", 2, "a", 2, "committed"), ("flaky", 3, "b", 1, "committed"),
    ("ask", 1, "a", 1, "waiting"), ("ask", 2, "a", 2, "committed"), ("ask", 3, "b", 1, "committed"), ("again", 1, "a", 1, "aborted"), ("again", 2, "a", 1, "committed"), ("again", 3, "b", 1, "committed"),
    ("edit", 1, "a", 1, "committed"), ("edit", 2, "b", 1, "committed"), ("bad", 1, "a", 1, "failed"),
]))
def scheduler_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ran(spark).store.table("attempts").select("workflow_id", "attempt_seq", "node_id", "attempt_number", "state")


@query(_values("id, state, current_revision, workflow_retry_count", [(x, "completed", 2 if x == "edit" else 1, int(x == "again")) for x in _DONE] + [("bad", "failed", 1, 0)]))
def scheduler_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ran(spark).store.table("workflows").select("id", "state", "current_revision", "workflow_retry_count")


@query("SELECT 'mail:k1' AS ref, 'succeeded' AS status, '{\"sent\":true}' AS result, 'ask' AS workflow_id, CAST(NULL AS VARCHAR) AS lease_owner")
def scheduler_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ran(spark).store.table("effects").select("ref", "status", "result", "workflow_id", "lease_owner")


@query(_values("workflow_id, revision, node_id, state", [(x, 1, n, "committed") for x in ("chain", "flaky", "ask", "again") for n in "ab"] + [("edit", 1, "a", "committed"), ("edit", 1, "b", "pending"), ("edit", 2, "a", "committed"), ("edit", 2, "b", "committed"), ("bad", 1, "a", "failed"), ("bad", 1, "b", "pending")]))
def scheduler_node_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ran(spark).store.table("node_states")


@query("SELECT 'a' AS node_id, 'step_raised' AS code, 'ValueError' AS error_class")
def scheduler_step_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _ran(spark).store.table("attempts").where("workflow_id = 'bad'")
    return failed.select("node_id", V.error_code(F.col("result.error")).alias("code"), F.get_json_object("result.error", "$.error_class").alias("error_class"))
