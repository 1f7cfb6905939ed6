"""The live event feed as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dagloom.plans.workflow import trace_records
from dagloom.schema import TABLES


def events_source(spark: SparkSession, folder: str, format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of event rows from files that arrive in a folder."""
    reader = spark.readStream.format(format).schema(TABLES["events"])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def commits_source(spark: SparkSession, store_folder: str) -> DataFrame:
    """A stream of the events that a store's commits hold."""
    lines = spark.readStream.text(f"{store_folder.rstrip('/')}/commits")
    mine = lines.where(F.col("value").startswith("[")).where(F.get_json_object("value", "$[0]") == "events")
    return mine.select(F.from_json(F.get_json_object("value", "$[1]"), TABLES["events"]).alias("e")).select("e.*")


def trace_stream(events: DataFrame) -> DataFrame:
    """Stateless: the status projection works on a stream as it does on a table."""
    return trace_records(events)


def fan_out(events: DataFrame, subscribers: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Every subscriber gets every micro-batch; a failing one does not stop the others."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for s in subscribers:
                try:
                    s(batch, epoch)
                except Exception:  # a subscriber's error is its own
                    continue
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Events by type in event-time windows, with a watermark for late ones."""
    timed = events.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "type").agg(F.count(F.lit(1)).alias("n"))


STATUS = "workflow_id string, state string, last_seq long, events long"
_TO_STATE = {"workflow_started": "running", "workflow_paused": "paused", "workflow_waiting": "waiting", "workflow_completed": "completed", "workflow_failed": "failed"}


def _status(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    name, last, n = state.get if state.exists else ("pending", 0, 0)
    rows = pd.concat(list(batches)).sort_values("seq")
    rows = rows[rows["seq"] > last].drop_duplicates("seq")  # a replayed event counts once
    for kind, seq in zip(rows["type"], rows["seq"], strict=True):
        name, last, n = _TO_STATE.get(kind, name), int(seq), n + 1
    state.update((name, last, n))
    yield pd.DataFrame({"workflow_id": [key[0]], "state": [name], "last_seq": [last], "events": [n]})


def workflow_status(events: DataFrame) -> DataFrame:
    """The state of each workflow after each micro-batch that touches it."""
    slim = events.select("workflow_id", "seq", "type")
    return slim.groupBy("workflow_id").applyInPandasWithState(_status, STATUS, "state string, last_seq long, events long", "update", GroupStateTimeout.NoTimeout)
