"""The current status of every client, kept as keyed state of a stream.

The state store holds the latest valid change of each client by event time; a batch gives only the
clients whose latest change is a new one. Changes that come late or again give nothing. What each batch gives is
written to a folder of its own, so it may be run again, and the clients themselves are never rewritten:
``current_clients`` joins the latest change of each to them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from saleslens import schemas as S
from saleslens.operators.merge import latest_per_key

# Functions that run inside tasks are sent by value, so that executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGE = "client_id long, new_status string, changed_at timestamp"
_STATE = "changed_at timestamp, new_status string"


def _newest(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best = tuple(state.get) if state.exists else None
    before = best
    for part in parts:
        for at, status in zip(part["changed_at"], part["new_status"]):
            if best is None or (at, status) > best:
                best = (at, status)
    if best != before:
        state.update(best)
        yield pd.DataFrame({"client_id": [key[0]], "new_status": [best[1]], "changed_at": [best[0]]})


def latest_changes(changes: DataFrame, allowed: Sequence[str] = tuple(S.STATUSES)) -> DataFrame:
    """(client_id, new_status, changed_at) of the clients whose latest valid change is new, batch by batch.

    Of changes at one time the status last in the alphabet counts. Changes without a client, a time or a
    status allowed are no state; ``rejected_changes`` gives those.
    """
    valid = F.col("new_status").isin(list(allowed)) & F.col("client_id").isNotNull() & F.col("changed_at").isNotNull()
    return changes.where(valid).select(F.col("client_id").cast("long").alias("client_id"), "new_status", "changed_at").groupBy(
        "client_id").applyInPandasWithState(_newest, CHANGE, _STATE, "update", GroupStateTimeout.NoTimeout)


def keep_status(changes: DataFrame, folder: str, checkpoint: str, allowed: Sequence[str] = tuple(S.STATUSES)) -> StreamingQuery:
    """Write what every batch changes to ``<folder>/batch=n``."""
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (
        latest_changes(changes, allowed).writeStream.foreachBatch(one_batch).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_clients(clients: DataFrame, folder: str) -> DataFrame:
    """The clients with the status and contact date of their latest change so far."""
    written = clients.sparkSession.read.schema(CHANGE).parquet(folder)
    latest = latest_per_key(written, "client_id", ["changed_at", "new_status"])
    return clients.join(latest, F.col("id") == F.col("client_id"), "left").withColumns({
        "status": F.coalesce("new_status", "status"), "last_contact_date": F.coalesce("changed_at", "last_contact_date"),
    }).select(*clients.columns)


def fold_into(spark: SparkSession, store, folder: str, batch_id: int) -> int:
    """Merge what one batch changed into a bucketed client table (``buckets.Store`` by id); other buckets are not touched."""
    def update(old: DataFrame, new: DataFrame) -> DataFrame:
        joined = old.join(new, F.col("id") == F.col("client_id"), "left")
        newer = F.col("last_contact_date").isNull() | (F.col("changed_at") >= F.col("last_contact_date"))
        return joined.withColumns({
            "status": F.when(newer & F.col("new_status").isNotNull(), F.col("new_status")).otherwise(F.col("status")),
            "last_contact_date": F.when(newer & F.col("changed_at").isNotNull(), F.col("changed_at")).otherwise(F.col("last_contact_date")),
        }).select(*old.columns)

    changed = spark.read.schema(CHANGE).parquet(f"{folder}/batch={batch_id}")
    return store.merge(changed, update, f"status {batch_id}", key="client_id")


def rejected_changes(changes: DataFrame, clients: DataFrame, allowed: Sequence[str] = tuple(S.STATUSES)) -> DataFrame:
    """Changes that are no state, with the reason: for the rows of a stream as for those of a table."""
    ids = clients.select(F.col("id").alias("_known_id"))
    joined = changes.join(ids, F.col("client_id") == F.col("_known_id"), "left_outer")
    word = F.coalesce(F.col("new_status").isin(list(allowed)), F.lit(False))
    reason = F.when(~word, "status not allowed").when(F.col("_known_id").isNull(), "client not found").when(F.col("changed_at").isNull(), "no time")
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_known_id")
