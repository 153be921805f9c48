"""Keyed upserts, loads with defaults and status changes, as whole-table joins.

Tables here are snapshots: every function returns the new content, to be written to a new path
and switched over. Nothing overwrites the path it reads.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleslens import schemas as S


def latest_per_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the largest by ``order``; summed up before the shuffle, not windowed."""
    rest = [c for c in rows.columns if c not in order and c != key]
    newest = rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return newest.select(*[F.col(c) if c == key else F.col("_row")[c].alias(c) for c in rows.columns])


def upsert(base: DataFrame, new: DataFrame, key: str = "user_id", order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` replace those with the same key; the others are added.

    With ``order`` several new rows for one key are settled first, the latest winning. Columns
    that ``new`` does not bring are null in the rows it replaces.
    """
    incoming = latest_per_key(new, key, order) if order else new
    untouched = base.join(incoming.select(key), key, "left_anti")
    return untouched.unionByName(incoming, allowMissingColumns=True)


def not_in(new: DataFrame, base: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows whose key the base does not have yet."""
    return new.join(base.select(key), key, "left_anti")


def already_in(new: DataFrame, base: DataFrame, key: str = "user_id") -> DataFrame:
    return new.join(base.select(key), key, "left_semi")


def upsert_predictions(base: DataFrame, predictions: DataFrame) -> DataFrame:
    """Update the prediction of each customer if there is one, insert it otherwise.

    Only the four written columns change on an update; what else the row holds stays.
    """
    written = ["probability", "is_target", "created_at"]
    incoming = latest_per_key(
        predictions.select("user_id", *written), "user_id", ["created_at", "probability"])
    renamed = incoming.select(
        F.col("user_id").alias("_key"), *[F.col(c).alias(f"_{c}") for c in written])
    both = base.join(renamed, base["user_id"] == renamed["_key"], "full")
    return both.select(*[
        F.coalesce("user_id", "_key").alias(c) if c == "user_id"
        else F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        if c in written else F.col(c)
        for c in base.columns
    ])


def client_rows(demographics: DataFrame, today: str) -> DataFrame:
    """Demographics as client rows with the fixed defaults."""
    occupation = F.col("occupation") if "occupation" in demographics.columns else F.lit("Professional")
    return demographics.select(
        "user_id", "age", "income_range", "risk_profile",
        occupation.alias("occupation"),
        *[F.lit(v).alias(c) for c, v in S.CLIENT_DEFAULTS.items()],
        F.lit(today).cast("date").alias("acquisition_date"),
        F.lit(None).cast("timestamp").alias("last_contact_date"),
    )


def upsert_clients(base: DataFrame, demographics: DataFrame, today: str) -> DataFrame:
    """Insert or reset clients from demographics; columns the defaults do not name are kept."""
    incoming = client_rows(demographics, today)
    given = [c for c in incoming.columns if c != "user_id"]
    renamed = incoming.select(
        F.col("user_id").alias("_key"), *[F.col(c).alias(f"_{c}") for c in given])
    both = base.join(renamed, base["user_id"] == renamed["_key"], "full")
    return both.select(*[
        F.coalesce("user_id", "_key").alias(c) if c == "user_id"
        else F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        if c in given else F.col(c)
        for c in base.columns
    ])


def _key(*parts: Column) -> Column:
    """128 bits of the parts, as hexadecimal digits; null is an empty part."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def load_products(products: DataFrame, as_of: str) -> DataFrame:
    """Product rows for the serving store. The id is made of the contract and its number among equal ones."""
    contract = [F.col("user_id"), F.col("product_type"), F.to_date("contract_date")]
    number = F.row_number().over(Window.partitionBy(*contract).orderBy(F.lit(1)))
    return products.withColumn("_number", number).select(
        _key(*contract, F.col("_number")).alias("id"),
        "user_id", "product_type", F.col("contract_date").cast("timestamp").alias("contract_date"),
        F.lit("active").alias("status"), F.lit(1000.0).alias("product_value"), *_times(as_of),
    )


def load_transactions(transactions: DataFrame, as_of: str) -> DataFrame:
    """Transaction rows for the serving store; the id is made of the natural key."""
    return transactions.select(
        _key(F.col("transaction_id")).alias("id"), "user_id",
        F.to_date("date").alias("transaction_date"), "amount",
        F.lit("payment").alias("transaction_type"), *_times(as_of),
    )


def _times(as_of: str) -> list[Column]:
    return [F.lit(as_of).cast("timestamp").alias(c) for c in ("created_at", "updated_at")]


def upsert_loaded(base: DataFrame, loaded: DataFrame) -> DataFrame:
    """Loaded rows replace those with their id, which keep the time they were created; the others are added."""
    before = base.select("id", F.col("created_at").alias("_created"))
    dated = loaded.join(before, "id", "left").withColumn("created_at", F.coalesce("_created", "created_at"))
    return upsert(base, dated.select(*base.columns), "id")


@dataclass(frozen=True)
class StatusResult:
    clients: DataFrame
    new_contacts: DataFrame
    rejected: DataFrame


def apply_status_changes(clients: DataFrame, changes: DataFrame,
                         allowed: Sequence[str] = tuple(S.STATUSES)) -> StatusResult:
    """Apply (client_id, new_status, changed_at) rows to the client table.

    The latest valid change of a client sets its status and contact date. Every valid change to
    ``contacted`` also gives a contact row. Changes with a status not allowed, or for a client
    there is none of, come back in ``rejected`` with the reason.
    """
    valid_word = F.coalesce(F.col("new_status").isin(list(allowed)), F.lit(False))
    ids = clients.select(F.col("id").alias("client_id"))
    worded = changes.where(valid_word)
    known = worded.join(ids, "client_id", "left_semi")
    latest = latest_per_key(known.select("client_id", "new_status", "changed_at"),
                            "client_id", ["changed_at", "new_status"])
    updated = (
        clients.join(latest, F.col("id") == F.col("client_id"), "left")
        .withColumns({
            "status": F.coalesce("new_status", "status"),
            "last_contact_date": F.coalesce("changed_at", "last_contact_date"),
        }).select(*clients.columns)
    )
    contacts = known.where(F.col("new_status") == "contacted").select(
        "client_id", F.col("changed_at").alias("contacted_at"), F.lit("app").alias("channel"),
        F.lit("Actualización de estado vía API").alias("notes"),
        F.lit(None).cast("string").alias("outcome"),
    )
    rejected = (
        changes.where(~valid_word).withColumn("reason", F.lit("status not allowed"))
        .unionByName(worded.join(ids, "client_id", "left_anti").withColumn("reason", F.lit("client not found")))
    )
    return StatusResult(updated, contacts, rejected)
