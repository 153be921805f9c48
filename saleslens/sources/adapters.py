"""Model tables from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens import schemas as S
from saleslens.session import pieces_for

REFERENCE_DATE = "2002-01-01"
PRODUCT_OF_PRIORITY = {
    "1-URGENT": "checking_account",
    "2-HIGH": "insurance",
    "3-MEDIUM": "savings_account",
    "4-NOT SPECIFIED": "credit_card",
    "5-LOW": "investment_account",
}
OUTCOME_OF_EVENT = {
    "purchase": "success",
    "view": "pending",
    "click": "not_interested",
    "error": "unreachable",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lookup(column: str, mapping: dict) -> Column:
    out = F.lit(None).cast("string")
    for key, value in mapping.items():
        out = F.when(F.col(column) == key, value).otherwise(out)
    return out


def _income(balance: str) -> Column:
    b = F.col(balance)
    low, middle, upper, top = S.INCOME_RANGES
    return F.when(b < 2000, low).when(b < 5000, middle).when(b < 8000, upper).otherwise(top)


def _risk(nation: str) -> Column:
    n = F.col(nation) % 3
    low, middle, high = S.RISK_PROFILES
    return F.when(n == 0, low).when(n == 1, middle).otherwise(high)


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"),
        (18 + F.col("c_custkey") % 53).cast("int").alias("age"),
        _income("c_acctbal").alias("income_range"),
        _risk("c_nationkey").alias("risk_profile"),
        F.col("c_mktsegment").alias("occupation"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("user_id"),
        _lookup("o_orderpriority", PRODUCT_OF_PRIORITY).alias("product_type"),
        F.to_date("o_orderdate").alias("contract_date"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem")
    category = F.element_at(F.array(*[F.lit(c) for c in S.MERCHANT_CATEGORIES]),
                            (F.col("l_suppkey") % 7 + 1).cast("int"))
    if pieces := pieces_for(lines, orders):
        lines, orders = lines.repartition(pieces, "l_orderkey"), orders.repartition(pieces, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_extendedprice").alias("amount"),
        category.alias("merchant_category"),
        F.lit(None).cast("string").alias("description"),
    )


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("c_acctbal") + 1000) / 11000
    status = F.col("c_custkey") % 4
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_custkey").cast("string").alias("user_id"),
        (18 + F.col("c_custkey") % 53).cast("int").alias("age"),
        _income("c_acctbal").alias("income_range"),
        _risk("c_nationkey").alias("risk_profile"),
        F.col("c_mktsegment").alias("occupation"),
        F.lit("standard").alias("profile_category"),
        F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("s"), (F.col("c_custkey") % 5).cast("string"))).alias("segment"),
        F.lit(None).cast("timestamp").alias("acquisition_date"),
        F.lit(None).cast("timestamp").alias("last_contact_date"),
        F.when(status == 0, "pending").when(status == 1, "contacted").when(status == 2, "interested")
        .otherwise("converted").alias("status"),
        F.lit("medium").alias("priority"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("probability"),
        F.lit(1000.0).alias("opportunity_value"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts_from(table(spark, sf_dir, "events"))


def contacts_from(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("client_id"),
        F.col("ts").cast("timestamp").alias("contacted_at"),
        F.lit("app").alias("channel"),
        F.lit(None).cast("string").alias("notes"),
        _lookup("event_type", OUTCOME_OF_EVENT).alias("outcome"),
    )


def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_from(table(spark, sf_dir, "events"))


def changes_from(events: DataFrame) -> DataFrame:
    """One change per event; signups ask for a status that is not allowed."""
    words = {"purchase": "converted", "view": "contacted", "click": "interested",
             "error": "lost", "signup": "archived"}
    return events.select(
        F.col("user_id").alias("client_id"), _lookup("event_type", words).alias("new_status"),
        F.col("ts").cast("timestamp").alias("changed_at"))


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, score, label): client probabilities against ownership of an insurance contract."""
    from saleslens.operators.products import ownership_flags

    owned = ownership_flags(products(spark, sf_dir)).select("user_id", "insurance")
    return clients(spark, sf_dir).select("id", "user_id", F.col("probability").alias("score")).join(
        owned, "user_id", "left").select("id", "score", F.coalesce(F.col("insurance").cast("int"), F.lit(0)).alias("label"))
