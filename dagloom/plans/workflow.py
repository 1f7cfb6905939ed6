"""Bulk queries over the kernel's tables: every one covers all workflows, and a single workflow is a
filter on workflow_id that Catalyst pushes into the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dagloom.schema import TERMINAL_EFFECT_STATUSES, TRACE_STATUS

# event log


def trace_status(event_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in TRACE_STATUS.items() for x in pair])[event_type]


def trace_records(events: DataFrame) -> DataFrame:
    """Events with their normalized status."""
    return events.withColumn("status", trace_status(F.col("type")))


def read_events(events: DataFrame, workflow_id: str | None = None, after_seq: int | None = None, limit: int | None = None) -> DataFrame:
    """Ordered log, strictly after a sequence number; the limit is the feature's own."""
    out = events
    if workflow_id is not None:
        out = out.where(F.col("workflow_id") == workflow_id)
    if after_seq is not None:
        out = out.where(F.col("seq") > after_seq)
    out = out.orderBy("workflow_id", "seq")
    return out if limit is None else out.limit(limit)


def first_events(events: DataFrame, after_seq: int, limit: int) -> DataFrame:
    """read_events for all workflows at once: the first `limit` after a cursor of each."""
    place = F.row_number().over(Window.partitionBy("workflow_id").orderBy("seq"))
    return events.where(F.col("seq") > after_seq).withColumn("__n", place).where(F.col("__n") <= limit).drop("__n")


def ring_tail(events: DataFrame, size: int) -> DataFrame:
    """The last `size` events of each workflow, oldest dropped first."""
    place = F.row_number().over(Window.partitionBy("workflow_id").orderBy(F.desc("seq")))
    return events.withColumn("__n", place).where(F.col("__n") <= size).drop("__n")


def last_seq(events: DataFrame) -> DataFrame:
    return events.groupBy("workflow_id").agg(F.max("seq").alias("last_event_seq"))


def status_histogram(events: DataFrame) -> DataFrame:
    return trace_records(events).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def coordinate_violations(events: DataFrame, revisions: DataFrame, nodes: DataFrame, attempts: DataFrame) -> DataFrame:
    """Events whose revision, node or attempt is unknown for their workflow; a null is a wildcard."""
    checks = (
        ("revision", revisions.select("workflow_id", "revision"), ["workflow_id", "revision"]),
        ("node_id", nodes.select("workflow_id", "revision", "node_id"), ["workflow_id", "revision", "node_id"]),
        ("attempt_id", attempts.select("workflow_id", "attempt_id"), ["workflow_id", "attempt_id"]),
    )
    found = None
    for name, known, keys in checks:
        bad = events.where(F.col(keys[-1]).isNotNull()).join(known.distinct(), keys, "left_anti").select("workflow_id", "seq", F.lit(name).alias("field"))
        found = bad if found is None else found.unionByName(bad)
    return found


# attempts


def count_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts of each node but for aborted ones."""
    return attempts.groupBy("workflow_id", "revision", "node_id").agg(F.count_if(F.col("state") != "aborted").alias("attempts"))


def number_attempts(attempts: DataFrame) -> DataFrame:
    """attempt_number of each attempt: one more than the node's earlier attempts not aborted."""
    before = Window.partitionBy("workflow_id", "node_id").orderBy("attempt_seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.when(F.col("state") != "aborted", 1).otherwise(0)).over(before), F.lit(0))
    return attempts.withColumn("attempt_number", (earlier + 1).cast("long"))


_LATEST = ("attempt_number", "attempt_id")


def canonical_committed(attempts: DataFrame, *values: str) -> DataFrame:
    """The committed attempt of the highest number of each node; ties by the id as a string."""
    pick = F.max_by(F.struct("attempt_id", "attempt_number", *values), F.struct(*_LATEST))
    return attempts.where("state = 'committed'").groupBy("workflow_id", "revision", "node_id").agg(pick.alias("p")).select("workflow_id", "revision", "node_id", "p.*")


def last_failure(attempts: DataFrame) -> DataFrame:
    pick = F.max_by(F.struct("attempt_id", "error_code"), F.struct(*_LATEST))
    return attempts.where("state = 'failed'").groupBy("workflow_id", "revision", "node_id").agg(pick.alias("p")).select("workflow_id", "revision", "node_id", F.col("p.attempt_id").alias("last_error_attempt_id"), F.col("p.error_code").alias("last_error_code"))


def node_states(attempts: DataFrame) -> DataFrame:
    """State of each node by its last attempt in sequence: aborted leaves it pending."""
    last = attempts.groupBy("workflow_id", "revision", "node_id").agg(F.max_by("state", "attempt_seq").alias("state"))
    return last.withColumn("state", F.when(F.col("state") == "aborted", "pending").otherwise(F.col("state")))


def node_diagnostics(states: DataFrame, attempts: DataFrame, links: DataFrame, effects: DataFrame) -> DataFrame:
    """One row a node: state, attempts (all of them), the last attempt, the last failure (even if a
    later attempt succeeded), why it waits if it does (where attempts have a reason), and the effects
    linked to it. One aggregation of attempts and one of effects, joined by node."""
    keys = ["workflow_id", "revision", "node_id"]
    order = F.struct(*_LATEST)
    tries = attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempt_count"),
        F.max_by("attempt_id", order).alias("last_attempt_id"),
        F.max_by(F.when(F.col("state") == "failed", F.struct("attempt_id", "error_code")), F.when(F.col("state") == "failed", order)).alias("f"),
        F.max_by("reason" if "reason" in attempts.columns else F.lit(None).cast("string"), F.when(F.col("state") == "waiting", order)).alias("reason"),
    )
    rows = effects_of_nodes(links, effects).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("ref", "status"))).alias("e"), F.bool_and(F.col("status").isin(*TERMINAL_EFFECT_STATUSES)).alias("effects_terminal")
    )
    joined = states.join(tries, keys, "left").join(rows, keys, "left")
    return joined.select(
        *keys,
        "state",
        F.col("state").isin("committed", "failed").alias("terminal"),
        F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"),
        "last_attempt_id",
        F.col("f.error_code").alias("last_error_code"),
        F.col("f.attempt_id").alias("last_error_attempt_id"),
        F.when(F.col("state") == "waiting", F.col("reason")).alias("waiting_reason"),
        F.coalesce(F.array_join(F.transform("e", lambda x: x["ref"]), ","), F.lit("")).alias("effect_refs"),
        F.coalesce(F.array_join(F.transform("e", lambda x: F.concat(x["ref"], F.lit("="), x["status"])), ","), F.lit("")).alias("effect_statuses"),
        "effects_terminal",
    )


def finalize(states: DataFrame, workflows: DataFrame | None = None) -> DataFrame:
    """Outcome of each workflow that has nothing left to run. Of `workflows` (workflow_id), those
    without any node are completed."""
    got = states.groupBy("workflow_id").agg(F.bool_and(F.col("state") == "committed").alias("all"), F.bool_or(F.col("state") == "waiting").alias("waits"))
    if workflows is not None:
        got = workflows.select("workflow_id").distinct().join(got, "workflow_id", "left").na.fill({"all": True, "waits": False})
    state = F.when(F.col("all"), "completed").when(F.col("waits"), "waiting").otherwise("failed")
    return got.select("workflow_id", state.alias("state"), F.when(state == "failed", F.lit("no_eligible_but_incomplete")).alias("reason"))


def abort_running(attempts: DataFrame, states: DataFrame, running: str = "running") -> tuple[DataFrame, DataFrame]:
    """(attempts to abort, nodes to reset to pending)."""
    hit = attempts.where(F.col("state") == running)
    nodes = states.where(F.col("state") == running).join(hit.select("workflow_id", "revision", "node_id").distinct(), ["workflow_id", "revision", "node_id"], "left_semi")
    return hit.select("workflow_id", "attempt_id"), nodes.select("workflow_id", "revision", "node_id")


def retry_reset(attempts: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(failed attempts of failed nodes to abort, failed nodes to reset)."""
    nodes = states.where("state = 'failed'").select("workflow_id", "revision", "node_id")
    return attempts.where("state = 'failed'").join(nodes, ["workflow_id", "revision", "node_id"], "left_semi").select("workflow_id", "attempt_id"), nodes


# eligibility and input of a step


def eligible_nodes(states: DataFrame, edges: DataFrame, order: DataFrame) -> DataFrame:
    """Nodes pending or invalidated all of whose predecessors are committed, with their rank.
    states: workflow_id, node_id, state. edges: src, dst, one definition for all workflows or one
    for each (workflow_id). order: node_id, pos."""
    keys = ["workflow_id"] if "workflow_id" in edges.columns else []
    open_before = states.where("state <> 'committed'").select("workflow_id", F.col("node_id").alias("src"))
    blocked = open_before.join(edges.select(*keys, "src", "dst"), [*keys, "src"]).select("workflow_id", F.col("dst").alias("node_id")).distinct()
    ready = states.where(F.col("state").isin("pending", "invalidated")).join(blocked, ["workflow_id", "node_id"], "left_anti")
    return ready.join(order, [*[k for k in keys if k in order.columns], "node_id"]).select("workflow_id", "node_id", "state", "pos")


def predecessor_results(committed: DataFrame, edges: DataFrame, projections: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """(workflow_id, node_id, predecessor, value): the committed result of each direct predecessor;
    a projection stands in where there is no attempt and the node is committed."""
    found = committed
    if projections is not None:
        usable = projections
        if states is not None:
            usable = usable.join(states.where("state = 'committed'").select("workflow_id", "node_id"), ["workflow_id", "node_id"], "left_semi")
        found = committed.unionByName(usable.join(committed, ["workflow_id", "node_id"], "left_anti"))
    keys = ["workflow_id"] if "workflow_id" in edges.columns else []
    into = edges.select(*keys, F.col("src").alias("predecessor"), F.col("dst").alias("for_node"))
    return found.withColumnRenamed("node_id", "predecessor").join(into, [*keys, "predecessor"]).select("workflow_id", F.col("for_node").alias("node_id"), "predecessor", *[c for c in committed.columns if c not in ("workflow_id", "node_id")])


def effective_context(patches: DataFrame, initial: Column) -> DataFrame:
    """(workflow_id, node_id, context): the initial context under the patches (maps) of direct
    predecessors, in order; the later one wins key by key.

    patches: workflow_id, node_id, predecessor, patch."""
    # maps have no order, so predecessors are sorted by name and patches looked up
    got = patches.groupBy("workflow_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("predecessor", "patch"))).alias("p"))
    fold = F.aggregate(F.array_sort(F.map_keys("p")), initial, lambda acc, k: merge(acc, F.element_at("p", k)))
    return got.select("workflow_id", "node_id", fold.alias("context"))


def merge(left: Column, right: Column) -> Column:
    """Shallow map merge, right wins; it needs no session setting for duplicate keys."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def map_text(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


# effects


def claimable(now_ms: int) -> Column:
    """Reserved; a retriable failure whose time has come; a lease that has run out."""
    s = F.col("status")
    due = F.col("not_before_ms").isNull() | (F.col("not_before_ms") <= now_ms)
    lapsed = F.col("lease_until_ms").isNull() | (F.col("lease_until_ms") < now_ms)
    return (s == "reserved") | ((s == "failed_retriable") & due) | ((s == "dispatching") & lapsed)


def lease_valid(owner: str, now_ms: int) -> Column:
    """A lease still holds at its very end."""
    return F.coalesce((F.col("status") == "dispatching") & (F.col("lease_owner") == owner) & (F.col("lease_until_ms") >= now_ms), F.lit(False))


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL_EFFECT_STATUSES)


def claim_ready(effects: DataFrame, now_ms: int, limit: int, links: DataFrame | None = None, workflow_id: str | None = None) -> DataFrame:
    """The first `limit` claimable effects in order of creation, of one workflow if it is named."""
    ready = effects.where(claimable(now_ms))
    if workflow_id is not None:
        ready = ready.join(links.where(F.col("workflow_id") == workflow_id).select("effect_id").distinct(), "effect_id", "left_semi")
    return ready.orderBy("effect_seq").limit(limit)


def effects_of_nodes(links: DataFrame, effects: DataFrame) -> DataFrame:
    """One row for each effect of a node, with the coordinates of its latest link and the place of
    its first."""
    by = ["workflow_id", "revision", "node_id", "effect_id"]
    one = links.groupBy(*by).agg(F.max_by(F.struct("attempt_id", "blocking"), "link_seq").alias("l"), F.min("link_seq").alias("position"))
    status = effects.select("effect_id", F.concat_ws(":", "type", "key").alias("ref"), "status")
    return one.join(status, "effect_id").select(*by, "ref", "status", "l.attempt_id", "l.blocking", "position")


def effect_snapshot(effects: DataFrame) -> DataFrame:
    """Effects without lease and times."""
    return effects.select("effect_id", F.concat_ws(":", "type", "key").alias("ref"), "type", "key", "status", is_terminal(F.col("status")).alias("terminal"))


def blocking_terminal(links: DataFrame, effects: DataFrame) -> DataFrame:
    """(attempt_id, all_terminal): whether all blocking effects of an attempt are terminal; true
    where none is blocking."""
    joined = links.join(effects.select("effect_id", "status"), "effect_id")
    return joined.groupBy("attempt_id").agg(F.bool_and(~F.col("blocking") | is_terminal(F.col("status"))).alias("all_terminal"))


def release_set(links: DataFrame, effects: DataFrame, states: DataFrame) -> DataFrame:
    """Waiting nodes, in the revision of a blocking link, whose attempt has only terminal blocking effects."""
    waiting = states.where("state = 'waiting'").select("workflow_id", "revision", "node_id")
    done = blocking_terminal(links, effects).where("all_terminal").select("attempt_id")
    return links.where("blocking").join(done, "attempt_id", "left_semi").join(waiting, ["workflow_id", "revision", "node_id"], "left_semi").select("workflow_id", "revision", "node_id", "attempt_id").distinct()


def reserve(intents: DataFrame) -> DataFrame:
    """The first intent of each (type, key) reserves the effect."""
    return intents.groupBy("type", "key").agg(F.min_by(F.struct("ord", "payload_fingerprint"), "ord").alias("p")).select("type", "key", "p.ord", "p.payload_fingerprint")


def idempotency_conflicts(intents: DataFrame) -> DataFrame:
    """Intents whose fingerprint is not the one reserved for their (type, key)."""
    first = F.first_value("payload_fingerprint").over(Window.partitionBy("type", "key").orderBy("ord"))
    return intents.withColumn("reserved", first).where(F.col("reserved") != F.col("payload_fingerprint"))


# revisions


def carry_forward(new_nodes: DataFrame, old_states: DataFrame, invalidated: DataFrame) -> DataFrame:
    """(node_id, state, projected) in a new revision: invalidated, pending if new, else carried;
    a committed node that is carried gets a projection of its result."""
    marked = new_nodes.select("node_id").join(invalidated.select("node_id").distinct().withColumn("__i", F.lit(True)), "node_id", "left").join(old_states.select("node_id", F.col("state").alias("__s")), "node_id", "left")
    state = F.when(F.col("__i"), "invalidated").when(F.col("__s").isNull(), "pending").otherwise(F.col("__s"))
    return marked.select("node_id", state.alias("state"), (state == "committed").alias("projected"))
