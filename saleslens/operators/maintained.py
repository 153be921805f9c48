"""Monthly sums and changes kept current from deltas, by changed customers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saleslens import schemas as S
from saleslens.operators.buckets import Store, create
from saleslens.operators.transactions import by_month_and_category, monthly_by_category, per_customer
from saleslens.session import placed

#: Columns of the stored sums, in the names of ``monthly_by_category``.
SUMS = ["user_id", "mes", "merchant_category", "_n", "_priced", "_cents", "_last"]
CHANGES = ["user_id", "mes", "cents", "transacciones_mes", "anterior"]


def create_sums(transactions: DataFrame, folder: str, buckets: int = 64) -> Store:
    """Store counts and cents per customer, month and category, placed by customer."""
    return create(sums_of(transactions), folder, "user_id", buckets)


def sums_of(transactions: DataFrame) -> DataFrame:
    return monthly_by_category(transactions).select(*SUMS)


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored sums and those of new rows as one; other customers of the same buckets stay as they are."""
    both = old.unionByName(new)
    return both.groupBy("user_id", "mes", "merchant_category").agg(
        F.sum("_n").alias("_n"), F.sum("_priced").alias("_priced"), F.sum("_cents").alias("_cents"), F.max("_last").alias("_last")).select(*SUMS)


def add_transactions(store: Store, delta: DataFrame, batch: str) -> int:
    """Merge new transactions into the stored sums; only buckets of customers with new rows are written."""
    return store.merge(sums_of(delta), added, batch)


def months(sums: DataFrame) -> DataFrame:
    """Cents and transactions per customer and month."""
    return sums.where(F.col("mes").isNotNull()).groupBy("user_id", "mes").agg(
        F.coalesce(F.sum("_cents"), F.lit(0)).alias("cents"), F.sum("_n").alias("transacciones_mes"))


def create_changes(sums: DataFrame, folder: str, buckets: int = 64) -> Store:
    """Store spend per customer and month beside that of the previous active month."""
    previous = F.lag("cents").over(Window.partitionBy("user_id").orderBy("mes"))
    return create(months(placed(sums, "user_id")).withColumn("anterior", previous).select(*CHANGES), folder, "user_id", buckets)


def _later(old: DataFrame, new: DataFrame) -> DataFrame:
    """Months before a customer's first changed one stay; the previous month is looked up anew from there on only.

    Old and new rows are placed by customer once, where they are added up and put in order.
    """
    both = old.select(*CHANGES, F.lit(False).alias("_new")).unionByName(
        new.select("user_id", "mes", "cents", "transacciones_mes", F.lit(None).cast("long").alias("anterior"), F.lit(True).alias("_new")))
    months = placed(both, "user_id").groupBy("user_id", "mes").agg(
        F.sum("cents").alias("cents"), F.sum("transacciones_mes").alias("transacciones_mes"), F.max("anterior").alias("_stored"), F.max("_new").alias("_new"))
    by_month = Window.partitionBy("user_id").orderBy("mes")
    # Rows up to this one tell whether the first changed month has come.
    stays = ~F.max("_new").over(by_month)
    return months.withColumn("anterior", F.when(stays, F.col("_stored")).otherwise(F.lag("cents").over(by_month))).select(*CHANGES)


def add_to_changes(store: Store, delta: DataFrame, batch: str) -> int:
    """Merge new transactions into the stored changes."""
    return store.merge(months(monthly_by_category(delta)), _later, batch)


def changes(store: Store, version: int | None = None) -> DataFrame:
    """(user_id, mes, monto_mes, transacciones_mes, variacion_monto, variacion_monto_pct), as ``monthly_changes`` gives them."""
    current, before = F.col("cents") / 100, F.col("anterior") / 100
    return store.read(version).select("user_id", "mes", current.alias("monto_mes"), "transacciones_mes",
                                      (current - before).alias("variacion_monto"), (F.try_divide(current, before) - 1).alias("variacion_monto_pct"))


def customer_sums(store: Store, variant: str = "v12", ties: str = "first", version: int | None = None) -> DataFrame:
    """What ``per_customer`` makes of the raw rows, from the stored sums."""
    return per_customer(by_month_and_category(store.read(version)), S.MERCHANT_CATEGORIES, variant, ties)
