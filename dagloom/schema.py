"""Schemas of the kernel tables and the closed sets of their enumerations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORKFLOW_STATES = ("pending", "running", "waiting", "paused", "completed", "failed")
NODE_STATES = ("pending", "running", "waiting", "committed", "failed", "invalidated")
ATTEMPT_STATES = ("running", "committed", "waiting", "failed", "aborted")
EFFECT_STATUSES = ("reserved", "dispatching", "succeeded", "failed_retriable", "failed_terminal")
TERMINAL_EFFECT_STATUSES = ("succeeded", "failed_terminal")
MUTATION_KINDS = ("invalidate", "replace_subtree")
DURABILITIES = ("ephemeral", "durable")

# Event types and the status that a trace shows for each.
TRACE_STATUS = {
    "workflow_started": "started",
    "node_started": "started",
    "node_committed": "success",
    "node_waiting": "waiting",
    "node_failed": "failed",
    "workflow_paused": "paused",
    "workflow_waiting": "waiting",
    "workflow_completed": "completed",
    "workflow_failed": "failed",
    "mutation_applied": "mutation_applied",
    "effect_dispatch_stale_lease": "effect_dispatch_stale_lease",
}
EVENT_TYPES = tuple(TRACE_STATUS)

RESULT = (
    "struct<kind:string,value:string,context_patch:map<string,string>,metadata:string,error:string,"
    "retriable:boolean,reason:string,resume_token:string,not_before_ms:bigint>"
)
TABLES = {
    "workflows": "id string, state string, current_revision long, workflow_retry_count long, initial_context string, runtime_profile string",
    "revisions": "workflow_id string, revision long, definition string, fingerprint string",
    "nodes": "workflow_id string, revision long, node_id string, ord long, step_type string, config string",
    "edges": "graph_id string, src string, dst string, weight double, metadata string, ord long",
    "node_states": "workflow_id string, revision long, node_id string, state string",
    "attempts": f"attempt_id string, workflow_id string, revision long, node_id string, attempt_number long, attempt_seq long, state string, result {RESULT}",
    "effects": (
        "id string, effect_seq long, ref string, workflow_id string, revision long, node_id string, attempt_id string, type string, key string, payload string, "
        "payload_fingerprint string, blocking boolean, status string, result string, error string, external_ref string, not_before_ms long, "
        "lease_owner string, lease_until_ms long, created_at_ms long, updated_at_ms long, metadata string"
    ),
    "attempt_effects": "effect_id string, attempt_id string, workflow_id string, revision long, node_id string, blocking boolean, link_seq long",
    "committed_projections": f"workflow_id string, revision long, node_id string, result {RESULT}",
    "events": "workflow_id string, seq long, type string, revision long, node_id string, attempt_id string, at_ms long, payload string",
}
#: key columns of each table; rows of a key are versions of one another
KEYS = {
    "workflows": ("id",),
    "revisions": ("workflow_id", "revision"),
    "nodes": ("workflow_id", "revision", "node_id"),
    "edges": ("graph_id", "src", "dst"),
    "node_states": ("workflow_id", "revision", "node_id"),
    "attempts": ("attempt_id",),
    "effects": ("id",),
    "attempt_effects": ("attempt_id", "effect_id"),
    "committed_projections": ("workflow_id", "revision", "node_id"),
    "events": ("workflow_id", "seq"),
}
ENUMS = {
    ("workflows", "state"): WORKFLOW_STATES,
    ("node_states", "state"): NODE_STATES,
    ("attempts", "state"): ATTEMPT_STATES,
    ("effects", "status"): EFFECT_STATUSES,
    ("events", "type"): EVENT_TYPES,
}


def member(column: str | Column, allowed: tuple[str, ...]) -> Column:
    return (F.col(column) if isinstance(column, str) else column).isin(*allowed)


def violations(table: str, rows: DataFrame) -> DataFrame:
    """(column, value, n): values of enumerated columns outside their closed sets, and null keys."""
    found = []
    for (t, c), allowed in ENUMS.items():
        if t == table:
            found.append(rows.where(~F.coalesce(member(c, allowed), F.lit(False))).groupBy(F.lit(c).alias("column"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")))
    for c in KEYS[table]:
        found.append(rows.where(F.col(c).isNull()).groupBy(F.lit(c).alias("column"), F.lit(None).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
