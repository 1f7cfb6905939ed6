"""Relations in the shape of the kernel's tables, derived from the test data by SQL that Spark and
DuckDB both run. Names in braces are the tables read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_ATTEMPTS = """
SELECT workflow_id, attempt_seq, concat(workflow_id, '/', CAST(attempt_seq AS STRING)) AS attempt_id,
       CAST(1 AS BIGINT) AS revision, node_id, state,
       CAST(1 + COALESCE(SUM(CASE WHEN state <> 'aborted' THEN 1 ELSE 0 END) OVER (
         PARTITION BY workflow_id, node_id ORDER BY attempt_seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS attempt_number,
       CASE WHEN state = 'failed' THEN concat('E', CAST(l_linenumber AS STRING)) END AS error_code
FROM (SELECT concat('wf-', CAST(l_orderkey AS STRING)) AS workflow_id,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS attempt_seq,
        concat('n', CAST(l_partkey % 4 AS STRING)) AS node_id, l_linenumber,
        CASE WHEN l_returnflag = 'N' THEN 'committed' WHEN l_returnflag = 'R' THEN 'failed'
             WHEN l_linestatus = 'F' THEN 'aborted' ELSE 'waiting' END AS state
      FROM {lineitem}) x
"""
_PART_DAG = """
SELECT CAST(src AS STRING) AS src, CAST(dst AS STRING) AS dst, MIN(w) AS weight FROM (
  SELECT CAST(p_partkey AS BIGINT) AS src, CAST(2*p_partkey+1 AS BIGINT) AS dst, CAST(p_size AS BIGINT) AS w FROM {part}
  UNION ALL SELECT CAST(p_partkey AS BIGINT), CAST(2*p_partkey+2 AS BIGINT), CAST(1 AS BIGINT) FROM {part}
  UNION ALL SELECT CAST(p_partkey AS BIGINT), CAST(3*p_partkey+p_size AS BIGINT), CAST(p_size % 7 + 1 AS BIGINT) FROM {part}) r
WHERE dst > src AND dst IN (SELECT p_partkey FROM {part}) GROUP BY src, dst
"""
_WORKFLOWS = """
SELECT concat('wf-', CAST(o_orderkey AS STRING)) AS id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'failed' ELSE 'paused' END AS state,
       CAST(1 + o_orderkey % 3 AS BIGINT) AS current_revision, CAST(o_orderkey % 4 AS BIGINT) AS workflow_retry_count, CAST(2 AS BIGINT) AS max_workflow_retries
FROM {orders}
"""
RELATIONS = {
    "workflows": _WORKFLOWS,
    "revisions": f"""
SELECT w.id AS workflow_id, CAST(x.k AS BIGINT) AS revision, concat('d', CAST(x.k AS STRING)) AS definition
FROM ({_WORKFLOWS}) w JOIN (VALUES (1), (2), (3)) AS x(k) ON x.k <= w.current_revision
""",
    "ev_log": """
SELECT concat('wf-', CAST(user_id AS STRING)) AS workflow_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq,
       CASE event_type WHEN 'signup' THEN 'workflow_started' WHEN 'view' THEN 'node_started'
            WHEN 'click' THEN 'node_committed' WHEN 'purchase' THEN 'workflow_completed'
            ELSE 'node_failed' END AS type,
       CAST(1 AS BIGINT) AS revision,
       CASE WHEN event_type IN ('signup','purchase') THEN NULL
            ELSE concat('n', CAST(event_id % 5 AS STRING)) END AS node_id,
       EPOCH_MS AS at_ms, props AS payload
FROM {events}
""",
    "part_nodes": "SELECT CAST(p_partkey AS STRING) AS node_id, CAST(p_partkey AS BIGINT) AS ord FROM {part}",
    "part_dag": _PART_DAG,
    "part_dag_mr": f"SELECT * FROM ({_PART_DAG}) p WHERE CAST(src AS BIGINT) >= 5",
    "conv_dag": """
SELECT CAST(a.conv_id AS STRING) AS graph_id, CAST(a.turn AS STRING) AS src, CAST(b.turn AS STRING) AS dst, CAST(length(a.text) AS BIGINT) AS weight
FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""",
    "conv_nodes": "SELECT CAST(conv_id AS STRING) AS graph_id, CAST(turn AS STRING) AS node_id, CAST(turn AS BIGINT) AS ord FROM {conversations}",
    "wf_edges": "SELECT * FROM (VALUES ('n0','n1'),('n0','n2'),('n1','n3'),('n2','n3')) AS t(src, dst)",
    "wf_nodes": "SELECT * FROM (VALUES ('n0'),('n1'),('n2'),('n3')) AS t(node_id)",
    "attempts": _ATTEMPTS,
    "intents": """
SELECT CAST(o_orderkey AS BIGINT) AS ord, substr(o_orderpriority, 3) AS type,
       concat('k', CAST(o_orderkey % 1000 AS STRING)) AS key, o_orderstatus AS payload_fingerprint
FROM {orders}
""",
    "effects": """
SELECT concat('effect/', CAST(o_orderkey AS STRING)) AS effect_id, CAST(o_orderkey AS BIGINT) AS effect_seq,
       substr(o_orderpriority, 3) AS type, concat('k', CAST(o_orderkey AS STRING)) AS key,
       CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'failed_terminal' ELSE 'succeeded' END
            WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'dispatching' ELSE 'failed_retriable' END
            ELSE 'reserved' END AS status,
       CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 1 AND o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 200 AS BIGINT) END AS not_before_ms,
       CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN concat('w', CAST(o_custkey % 3 AS STRING)) END AS lease_owner,
       CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN CAST(o_orderkey % 200 AS BIGINT) END AS lease_until_ms
FROM {orders}
""",
    "attempt_effects": f"""
SELECT a.attempt_id, concat('effect/', CAST((e.m + a.attempt_seq * 7 + x.k * 13) % 1000 AS STRING)) AS effect_id,
       a.workflow_id, a.revision, a.node_id, (a.attempt_seq + x.k) % 2 = 0 AS blocking,
       CAST(a.attempt_seq * 3 + x.k AS BIGINT) AS link_seq
FROM ({_ATTEMPTS}) a JOIN (SELECT concat('wf-', CAST(o_orderkey AS STRING)) AS workflow_id, o_orderkey % 1000 AS m FROM {{orders}}) e
  ON a.workflow_id = e.workflow_id
  CROSS JOIN (VALUES (0), (1), (2)) AS x(k) WHERE a.state = 'waiting'
""",
}
_SPARK_MS, _DUCK_MS = "unix_micros(CAST(ts AS TIMESTAMP)) div 1000", "epoch_us(ts) // 1000"


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = RELATIONS[name].replace("EPOCH_MS", _SPARK_MS)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables) if tables else spark.sql(sql)


def duck(name: str) -> str:
    """The relation as a DuckDB subquery."""
    return f"({re.sub(r'\{(\w+)\}', r'\1', RELATIONS[name].replace('EPOCH_MS', _DUCK_MS))})"
