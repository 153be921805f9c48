"""Per-customer features of the product table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleslens import schemas as S
from saleslens.functions import combo_label, combo_listed
from saleslens.operators.ranks import BUCKET, running_totals


def recoded(products: DataFrame) -> DataFrame:
    """Products with the investment name recoded and without rows that have no customer."""
    from saleslens.operators.cleaning import recode

    return recode(products.where(F.col("user_id").isNotNull()), "product_type")


def ownership_flags(products: DataFrame) -> DataFrame:
    """One row per customer, one boolean per product; contracts without a date do not count."""
    dated = F.col("contract_date").isNotNull()
    return recoded(products).groupBy("user_id").agg(*[
        F.coalesce(F.max((F.col("product_type") == p) & dated), F.lit(False)).alias(p)
        for p in S.PRODUCT_FLAGS
    ])


def leading(products: DataFrame, upto: int = 2) -> DataFrame:
    """Each customer's first contracts by date, then product name, numbered as ``rank``.

    Spark keeps only that many rows per customer before the shuffle, so a customer with a great
    many contracts costs no more than any other.
    """
    by_date = Window.partitionBy("user_id").orderBy("contract_date", "product_type")
    return (
        recoded(products).where(F.col("contract_date").isNotNull())
        .withColumn("rank", F.row_number().over(by_date)).where(F.col("rank") <= upto)
    )


def running_number(products: DataFrame) -> DataFrame:
    """Number all contracts of each customer by date, then product name, as ``rank``.

    The contracts of one day are numbered together and the days before them are added, so that
    no task holds all rows of one customer.
    """
    dated = recoded(products).where(F.col("contract_date").isNotNull()).withColumns({
        "_one": F.lit(1), BUCKET: F.unix_date("contract_date")})
    return running_totals(dated, {"rank": "_one"}, [F.col("product_type")], ["user_id"]).drop("_one", "rank_all")


def nth_product(products: DataFrame, n: int = 2) -> DataFrame:
    return leading(products, n).where(F.col("rank") == n).drop("rank")


def first_second(products: DataFrame) -> DataFrame:
    """First and second product with their dates; no second one gives nulls."""
    def at(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    return leading(products, 2).groupBy("user_id").agg(
        at(1, "product_type").alias("primer_producto"),
        at(1, "contract_date").alias("fecha_primer_producto"),
        at(2, "product_type").alias("segundo_producto"),
        at(2, "contract_date").alias("fecha_segundo_producto"),
    )


def days_between(variant: str = "v12") -> Column:
    """Days from first to second product.

    Without a second product, ``v12`` counts from the fixed marker date (a large negative
    number), ``zero`` gives 0 and ``null`` gives null.
    """
    second = F.col("fecha_segundo_producto")
    if variant == "v12":
        second = F.coalesce(second, F.lit(S.NO_SECOND_DATE).cast("date"))
    days = F.datediff(second, F.col("fecha_primer_producto"))
    return F.coalesce(days, F.lit(0)) if variant == "zero" else days


def tenure(reference_date: str = S.REFERENCE_DATE) -> Column:
    return F.datediff(F.lit(reference_date).cast("date"), F.col("fecha_primer_producto"))


def number_of_products(flags: Sequence[str] = S.PRODUCT_FLAGS) -> Column:
    """How many kinds of product, not how many contracts."""
    total = F.lit(0)
    for p in flags:
        total = total + F.col(p).cast("int")
    return total


def product_features(
    products: DataFrame,
    reference_date: str = S.REFERENCE_DATE,
    second_variant: str = "v12",
    listed_combos: bool = False,
) -> DataFrame:
    """All product columns, one row per customer with at least one dated contract.

    Both halves come out partitioned by customer, so joining them moves nothing again.
    """
    label = combo_listed if listed_combos else combo_label
    return (
        first_second(products)
        .join(ownership_flags(products), "user_id", "left")
        .withColumns({
            "dias_entre_productos": days_between(second_variant),
            "antiguedad_cliente": tenure(reference_date),
            "numero_productos": number_of_products(),
            "combinacion_productos": label({p: F.col(p) for p in S.PRODUCT_FLAGS}),
        })
    )


def combinations(products: DataFrame) -> DataFrame:
    """Different product names of each customer, sorted and joined; names as they are stored."""
    return (
        products.where(F.col("user_id").isNotNull())
        .groupBy("user_id").agg(F.collect_set("product_type").alias("_types"))
        .select("user_id", F.array_join(F.array_sort("_types"), " + ").alias("combinacion"))
    )


def products_per_user(products: DataFrame) -> DataFrame:
    return products.groupBy("user_id").agg(F.count("*").alias("total_productos"))


def mean_products_per_user(products: DataFrame) -> DataFrame:
    return products_per_user(products).agg(
        F.count("*").alias("usuarios"),
        (F.sum("total_productos") / F.count("*")).alias("media_productos"),
    )


def with_own_count(products: DataFrame) -> DataFrame:
    """Every contract with its customer's number of contracts.

    The counts are taken before the shuffle and joined back, so that a customer with very many
    rows meets a one-row match that adaptive execution can split, not a window in one task.
    """
    return products.join(products_per_user(products), "user_id", "left")


def types_by_own_count(products: DataFrame) -> DataFrame:
    """Contracts per product type and per number of contracts of the customer."""
    per_type = products.groupBy("user_id", "product_type").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("user_id")
    return (
        per_type.withColumn("total_productos", F.sum("_n").over(whole))
        .groupBy("product_type", "total_productos").agg(F.sum("_n").alias("n"))
    )
