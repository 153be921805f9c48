"""Status changes and contact counts kept current as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from saleslens import schemas as S
from saleslens.operators.merge import apply_status_changes


def _outcome() -> Column:
    known = [o for o in S.OUTCOMES if o != "other"]
    return F.when(F.col("outcome").isin(known), F.col("outcome")).otherwise("other")


def contact_counts(contacts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Contacts per day and outcome from a stream; rows later than ``delay`` are left out.

    State is one count per open day and outcome. In ``append`` and ``update`` mode the watermark
    frees it; ``complete`` mode keeps all of it. ``count_contacts`` keeps count of the late rows too.
    """
    return (
        contacts.withWatermark("contacted_at", delay)
        .groupBy(F.window("contacted_at", "1 day").alias("w"), _outcome().alias("outcome"))
        .agg(F.count("*").alias("n"))
        .select(F.to_date(F.col("w")["start"]).alias("date"), "outcome", "n")
    )


def count_contacts(contacts: DataFrame, folder: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Count each batch per day and outcome, with ``late`` for rows older than the batches before allow.

    Batch ``n`` writes its counts to ``<folder>/counts/batch=n`` and the latest time up to it to
    ``<folder>/marks/batch=n``, so it may be run again. A row is late if it is more than ``delay``
    older than the latest time of the batches before; a row without a time counts under no date.
    ``counted`` sums the batches.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = f"{folder}/counts/batch={batch_id}"
        mark = None
        if batch_id > 0:
            mark = spark.read.schema("mark timestamp").parquet(f"{folder}/marks/batch={batch_id - 1}").first()["mark"]
        limit = F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col("contacted_at") < limit, F.lit(False))
        summed = batch.groupBy(F.to_date("contacted_at").alias("date"), _outcome().alias("outcome"), late.alias("late")).agg(
            F.count("*").alias("n"), F.max("contacted_at").alias("_latest"))
        summed.write.mode("overwrite").parquet(counts)
        newest = spark.read.schema(summed.schema).parquet(counts).agg(
            F.greatest(F.max("_latest"), F.lit(mark).cast("timestamp")).alias("mark"))
        newest.write.mode("overwrite").parquet(f"{folder}/marks/batch={batch_id}")

    return (
        contacts.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def counted(spark: SparkSession, folder: str) -> DataFrame:
    """(date, outcome, late, n) over all batches that ``count_contacts`` has written."""
    parts = spark.read.schema("date date, outcome string, late boolean, n bigint").parquet(f"{folder}/counts")
    return parts.groupBy("date", "outcome", "late").agg(F.sum("n").alias("n"))


def apply_status_stream(changes: DataFrame, read_clients: Callable[[int], DataFrame], folder: str,
                        checkpoint: str) -> StreamingQuery:
    """Apply each batch of changes to the client snapshot before it.

    Batch ``n`` reads ``read_clients(n)`` and writes ``<folder>/clients/batch=n``, and its contact
    and rejected rows likewise. A batch that is run again after a failure overwrites its own
    output only, so it may be run any number of times.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        result = apply_status_changes(read_clients(batch_id), batch)
        for name, df in (("clients", result.clients), ("contacts", result.new_contacts),
                         ("rejected", result.rejected)):
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")

    return (
        changes.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
