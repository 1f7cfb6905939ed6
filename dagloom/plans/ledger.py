"""Bulk forms of the store's writes and scoped reads: requests for all workflows in, rows to write and
the outcome of each request out. Requests of one key are decided in the order of `ord`: the first
that fits wins, the others find the row changed (compare-and-set). Every operator is joins and
aggregations by key; nothing is ordered across workflows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dagloom.plans.workflow import TERMINAL_EFFECT_STATUSES, claimable, is_terminal, lease_valid, node_diagnostics

NODE = ["workflow_id", "revision", "node_id"]

# workflows and revisions


def create_workflows(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (id, ord) with outcome: created, or duplicate of a workflow or of an earlier request."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    known = existing.select("id").distinct().withColumn("__known", F.lit(True))
    marked = requests.withColumn("__n", place).join(known, "id", "left")
    new = F.col("__known").isNull() & (F.col("__n") == 1)
    return marked.withColumn("outcome", F.when(new, "created").otherwise("duplicate")).drop("__n", "__known")


def current_definitions(workflows: DataFrame, revisions: DataFrame) -> DataFrame:
    """Every workflow with the definition of its current revision."""
    current = revisions.withColumnRenamed("workflow_id", "id").withColumnRenamed("revision", "current_revision")
    return workflows.join(current, ["id", "current_revision"])


def current_states(workflows: DataFrame, states: DataFrame) -> DataFrame:
    """Node states of each workflow's current revision."""
    current = workflows.select(F.col("id").alias("workflow_id"), F.col("current_revision").alias("revision"))
    return states.join(current, ["workflow_id", "revision"], "left_semi")


def _first_that_fits(rows: DataFrame, requests: DataFrame, keys: list[str], column: str) -> DataFrame:
    """requests (keys, ord, from, to) with outcome: unknown, stale, or done. A request that is done
    changes what the next one finds, so requests of a key are folded in order."""
    got = requests.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "from", "to"))).alias("__r"))
    joined = got.join(rows.select(*keys, F.col(column).alias("__s")), keys, "left")
    start = F.struct(F.col("__s").alias("s"), F.array().cast("array<struct<ord:bigint,from:string,to:string,outcome:string>>").alias("out"))

    def fold(acc: Column, r: Column) -> Column:
        outcome = F.when(acc["s"].isNull(), "unknown").when(acc["s"] != r["from"], "stale").otherwise("done")
        row = F.struct(r["ord"].cast("long").alias("ord"), r["from"].alias("from"), r["to"].alias("to"), outcome.alias("outcome"))
        return F.struct(F.when(outcome == "done", r["to"]).otherwise(acc["s"]).alias("s"), F.concat(acc["out"], F.array(row)).alias("out"))

    return joined.select(*keys, F.inline(F.aggregate("__r", start, fold)["out"]))


def transition_workflows(workflows: DataFrame, requests: DataFrame) -> DataFrame:
    return _first_that_fits(workflows, requests, ["id"], "state")


def transition_nodes(states: DataFrame, requests: DataFrame) -> DataFrame:
    return _first_that_fits(states, requests, NODE, "state")


def append_revisions(workflows: DataFrame, requests: DataFrame, allowed_states: tuple[str, ...] | None = None) -> DataFrame:
    """requests (id, parent_revision, ord) with outcome and the new revision: unknown; concurrent (the
    workflow runs); stale_state; stale_revision, also for all but the first of a parent; appended."""
    joined = requests.join(workflows.select("id", "state", "current_revision"), "id", "left")
    first = F.row_number().over(Window.partitionBy("id", "parent_revision").orderBy("ord"))
    bad_state = F.lit(False) if allowed_states is None else ~F.col("state").isin(*allowed_states)
    outcome = (
        F.when(F.col("state").isNull(), "unknown")
        .when(bad_state & (F.col("state") == "running"), "concurrent")
        .when(bad_state, "stale_state")
        .when((F.col("current_revision") != F.col("parent_revision")) | (F.col("__n") > 1), "stale_revision")
        .otherwise("appended")
    )
    done = joined.withColumn("__n", first).withColumn("outcome", outcome)
    return done.select("id", "parent_revision", "ord", "outcome", F.when(F.col("outcome") == "appended", F.col("parent_revision") + 1).alias("revision"))


# attempts


def begin_attempts(states: DataFrame, attempts: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (NODE, expected) with outcome and, where begun, attempt_seq, attempt_id and
    attempt_number: sequences go on from the workflow's last, in order of the nodes' names."""
    last = attempts.groupBy("workflow_id").agg(F.max("attempt_seq").alias("__last"))
    tries = attempts.groupBy(*NODE).agg(F.count_if(F.col("state") != "aborted").alias("__tries"))
    joined = requests.join(states.select(*NODE, "state"), NODE, "left").join(last, "workflow_id", "left").join(tries, NODE, "left")
    begun = F.coalesce(F.col("state") == F.col("expected"), F.lit(False))
    place = F.count_if("__ok").over(Window.partitionBy("workflow_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0))
    seq = F.when(F.col("__ok"), F.coalesce("__last", F.lit(0)) + place)
    return joined.withColumn("__ok", begun).withColumn("attempt_seq", seq).select(
        *NODE,
        F.when(F.col("__ok"), "begun").when(F.col("state").isNull(), "unknown").otherwise("stale").alias("outcome"),
        F.col("attempt_seq").cast("long").alias("attempt_seq"),
        F.concat_ws("/", F.when(F.col("__ok"), F.col("workflow_id")), F.col("attempt_seq").cast("string")).alias("attempt_id"),
        F.when(F.col("__ok"), F.coalesce("__tries", F.lit(0)) + 1).cast("long").alias("attempt_number"),
    )


def commit_attempts(attempts: DataFrame, results: DataFrame, max_attempts: int) -> DataFrame:
    """results (attempt_id, kind, retriable) with the attempt's and the node's new state and the type
    of the event; stale unless the attempt is running. A retriable failure within the budget
    leaves the node pending."""
    joined = results.join(attempts.select("attempt_id", *NODE, "attempt_number", "state"), "attempt_id", "left")
    again = F.coalesce("retriable", F.lit(False)) & (F.col("attempt_number") < max_attempts)
    state = F.when(F.col("kind") == "success", "committed").when(F.col("kind") == "waiting", "waiting").otherwise("failed")
    node = F.when((F.col("kind") == "failure") & again, "pending").otherwise(state)
    running = F.coalesce(F.col("state") == "running", F.lit(False))
    kept = joined.withColumn("__ok", running)
    return kept.select(
        "attempt_id",
        *NODE,
        F.when(F.col("__ok"), "done").otherwise("stale").alias("outcome"),
        F.when(F.col("__ok"), state).alias("attempt_state"),
        F.when(F.col("__ok"), node).alias("node_state"),
        F.when(F.col("__ok"), F.concat(F.lit("node_"), state)).alias("event_type"),
    )


def prepare_retries(workflows: DataFrame, states: DataFrame) -> DataFrame:
    """(id, outcome, workflow_retry_count, reset): failed workflows within their budget go back to
    pending and reset their failed nodes; the others are stale or exhausted."""
    failed = states.where("state = 'failed'").groupBy(F.col("workflow_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("__f"))
    outcome = F.when(F.col("state") != "failed", "stale").when(F.col("workflow_retry_count") >= F.col("max_workflow_retries"), "exhausted").otherwise("reset")
    got = workflows.withColumn("outcome", outcome).join(failed, "id", "left")
    done = F.col("outcome") == "reset"
    return got.select("id", "outcome", (F.col("workflow_retry_count") + done.cast("long")).alias("workflow_retry_count"), F.when(done, F.coalesce("__f", F.lit(""))).alias("reset"))


# events


def append_events(log: DataFrame, new: DataFrame) -> DataFrame:
    """new (workflow_id, ord, ...) with the sequence numbers that go on, without gaps, from each
    workflow's last."""
    last = log.groupBy("workflow_id").agg(F.max("seq").alias("__last"))
    place = F.row_number().over(Window.partitionBy("workflow_id").orderBy("ord"))
    return new.withColumn("__n", place).join(last, "workflow_id", "left").withColumn("seq", (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("long")).drop("__n", "__last")


# effects


def effects_of_attempts(links: DataFrame, effects: DataFrame) -> DataFrame:
    """One row for each effect of an attempt, in the order of its links."""
    place = F.row_number().over(Window.partitionBy("attempt_id").orderBy("link_seq", "effect_id"))
    return links.join(effects.select("effect_id", "type", "key", "status"), "effect_id").withColumn("place", place)


def snapshots(links: DataFrame, effects: DataFrame) -> DataFrame:
    """(NODE, snapshot): what a step sees of its effects, a map from ref to status."""
    one = links.select(*NODE, "effect_id").distinct().join(effects.select("effect_id", F.concat_ws(":", "type", "key").alias("ref"), "status"), "effect_id")
    return one.groupBy(*NODE).agg(F.map_from_entries(F.collect_set(F.struct("ref", "status"))).alias("snapshot"))


def claim(ready: DataFrame, owner: str, lease_ms: int, now_ms: int) -> DataFrame:
    """The rows that a claim writes."""
    return ready.withColumns({"status": F.lit("dispatching"), "lease_owner": F.lit(owner), "lease_until_ms": F.lit(now_ms + lease_ms).cast("long"), "updated_at_ms": F.lit(now_ms).cast("long")})


def claim_by_workflow(effects: DataFrame, links: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """claim_ready scoped to a workflow, for all workflows: the first `limit` of each."""
    mine = links.select("workflow_id", "effect_id").distinct().join(effects.where(claimable(now_ms)), "effect_id")
    place = F.row_number().over(Window.partitionBy("workflow_id").orderBy("effect_seq"))
    return mine.withColumn("place", place).where(F.col("place") <= limit)


def complete_effects(effects: DataFrame, outcomes: DataFrame, owner: str, now_ms: int) -> DataFrame:
    """outcomes (effect_id, succeeded, retriable, retry_at_ms) with the rows they write: unknown, or
    stale without a valid lease of the owner; the lease goes with the claim."""
    leased = effects.select("effect_id", "status", "lease_owner", "lease_until_ms").withColumn("__ok", lease_valid(owner, now_ms))
    joined = outcomes.join(leased.select("effect_id", "__ok"), "effect_id", "left")
    status = F.when(F.col("succeeded"), "succeeded").when(F.col("retriable"), "failed_retriable").otherwise("failed_terminal")
    done = F.coalesce("__ok", F.lit(False))
    return joined.select(
        "effect_id",
        F.when(F.col("__ok").isNull(), "unknown").when(done, "done").otherwise("stale_lease").alias("outcome"),
        F.when(done, status).alias("status"),
        F.when(done & (status == "failed_retriable"), F.col("retry_at_ms")).alias("not_before_ms"),
    )


def renew_leases(effects: DataFrame, requests: DataFrame, owner: str, now_ms: int) -> DataFrame:
    """requests (effect_id, until_ms) with outcome and the lease's new end: stale_lease, invalid (in the
    past or shorter), same, renewed."""
    joined = requests.join(effects.select("effect_id", "status", "lease_owner", "lease_until_ms"), "effect_id", "left")
    outcome = (
        F.when(~lease_valid(owner, now_ms), "stale_lease")
        .when((F.col("until_ms") <= now_ms) | (F.col("until_ms") < F.col("lease_until_ms")), "invalid")
        .when(F.col("until_ms") == F.col("lease_until_ms"), "same")
        .otherwise("renewed")
    )
    return joined.withColumn("outcome", outcome).select("effect_id", "outcome", F.when(F.col("outcome") == "renewed", F.col("until_ms")).otherwise(F.col("lease_until_ms")).alias("lease_until_ms"))


def release_after(links: DataFrame, effects: DataFrame, states: DataFrame, written: DataFrame) -> DataFrame:
    """Nodes that the effects just written release: waiting, in the revision of a blocking link of one of
    them, with all blocking effects of the link's attempt terminal afterwards."""
    new = written.where(F.col("status").isin(*TERMINAL_EFFECT_STATUSES)).select("effect_id", F.col("status").alias("__new"))
    after = effects.select("effect_id", "status").join(new, "effect_id", "left").select("effect_id", F.coalesce("__new", "status").alias("status"), F.col("__new").isNotNull().alias("__now"))
    blocking = links.where("blocking").join(after, "effect_id")
    done = blocking.groupBy("attempt_id", *NODE).agg(F.bool_and(is_terminal(F.col("status"))).alias("all"), F.bool_or("__now").alias("now")).where("all AND now")
    return done.join(states.where("state = 'waiting'").select(*NODE), NODE, "left_semi").select(*NODE, "attempt_id")


def dispatch_report(written: DataFrame) -> DataFrame:
    """(outcome, status, n) of a tick."""
    return written.groupBy("outcome", "status").agg(F.count(F.lit(1)).alias("n"))


# diagnostics


def waiting_reasons(attempts: DataFrame) -> DataFrame:
    """The reason of each node's last waiting attempt."""
    pick = F.max_by(F.struct("attempt_id", "reason"), F.struct("attempt_number", "attempt_id"))
    return attempts.where("state = 'waiting'").groupBy(*NODE).agg(pick.alias("p")).select(*NODE, F.col("p.attempt_id").alias("last_waiting_attempt_id"), F.col("p.reason").alias("waiting_reason"))


def full_diagnostics(nodes: DataFrame, states: DataFrame, attempts: DataFrame, links: DataFrame, effects: DataFrame) -> DataFrame:
    """All fields of node_diagnostics for every node of a revision, also without attempts (pending).
    attempts: with their reason."""
    every = nodes.join(states, NODE, "left").na.fill("pending", ["state"])
    return node_diagnostics(every, attempts, links, effects)
