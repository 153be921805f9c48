"""Per-customer features of the transaction table.

Raw rows are read once and summed per customer, month and category before they are shuffled; every
other feature is derived from those sums. A customer holding a third of all transactions is
therefore a few hundred rows by the time anything is grouped by customer alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleslens import schemas as S
from saleslens.functions import cents, month_of
from saleslens.session import placed


def _is(category: str) -> Column:
    return F.col("merchant_category") == category


def monthly_by_category(transactions: DataFrame) -> DataFrame:
    """Counts and cents per customer, month and category: the only grouping of raw rows.

    Narrow rows, so that what is left after summing within a task is small to shuffle.
    """
    return (
        transactions.where(F.col("user_id").isNotNull())
        .groupBy("user_id", month_of("date").alias("mes"), "merchant_category")
        .agg(F.count("transaction_id").alias("_n"), F.count("amount").alias("_priced"),
             F.sum(cents("amount")).alias("_cents"), F.max("date").alias("_last"))
    )


def by_month_and_category(monthly: DataFrame, categories_too: bool = True) -> DataFrame:
    """Counts and cents per customer and month and, in rows of their own, per customer and category.

    Both come from one placement by customer: each row is taken once for its month and once for its
    category. Rows of months have ``_by_month`` and no category, rows of categories have no month.
    """
    way = F.explode(F.array(F.lit(True), F.lit(False))) if categories_too else F.lit(True)
    month = F.col("_by_month")
    rows = placed(monthly, "user_id").select("user_id", way.alias("_by_month"), "mes", "merchant_category", "_n", "_priced", "_cents", "_last")
    return rows.groupBy(
        "user_id", "_by_month", F.when(month, F.col("mes")).alias("mes"), F.when(~month, F.col("merchant_category")).alias("merchant_category"),
    ).agg(F.sum("_n").alias("_n"), F.sum("_priced").alias("_priced"), F.sum("_cents").alias("_cents"),
          F.coalesce(F.sum("_cents"), F.lit(0)).alias("_total"), F.max("_last").alias("_last"))


def monthly_rollup(transactions: DataFrame) -> DataFrame:
    """Spend and number of transactions per customer and month."""
    return (
        transactions.where(F.col("user_id").isNotNull() & F.col("date").isNotNull())
        .groupBy("user_id", month_of("date").alias("mes"))
        .agg(F.coalesce(F.sum(cents("amount")), F.lit(0)).alias("_total"),
             F.count("transaction_id").alias("transacciones_mes"))
        .select("user_id", "mes", (F.col("_total") / 100).alias("monto_mes"), "transacciones_mes")
    )


def _previous(column: str, *within: str) -> Column:
    """Value of the previous month that has transactions; months without any are not filled in."""
    by_month = Window.partitionBy("user_id", *within).orderBy("mes")
    return F.lag(F.when(F.col("mes").isNotNull(), F.col(column))).over(by_month)


def monthly_changes(rollup: DataFrame) -> DataFrame:
    """Difference and relative change from the previous active month."""
    previous = _previous("monto_mes")
    return rollup.withColumns({
        "variacion_monto": F.col("monto_mes") - previous,
        "variacion_monto_pct": F.try_divide(F.col("monto_mes"), previous) - 1,
    })


def _relative_change(variant: str) -> Column:
    current, previous = F.col("_total"), F.col("_previous")
    change = F.try_divide(current.cast("double"), previous.cast("double")) - 1
    if variant == "skip_first":
        return change
    # The first month counts as no change, and so does a month without spend after another.
    nothing = F.col("mes").isNotNull() & (previous.isNull() | ((previous == 0) & (current == 0)))
    return F.when(nothing, F.lit(0.0)).otherwise(change)


def per_customer(sums: DataFrame, categories: Sequence[str] = S.MERCHANT_CATEGORIES,
                 variant: str = "v12", ties: str = "first") -> DataFrame:
    """Sum the rows of months and categories to one per customer, still in cents and counts.

    Favourites know every category there is; rows without one are left out. ``first`` takes the
    first name in the alphabet on ties; ``joined`` names all of them and adds up their spend.
    """
    if ties not in ("first", "joined"):
        raise ValueError("ties is 'first' or 'joined'")
    month, category = F.col("_by_month"), F.col("merchant_category")
    dated, named = month & F.col("mes").isNotNull(), ~month & category.isNotNull()
    # Same order as the lag, so one sort and one window serve all three.
    whole = Window.partitionBy("user_id", "_by_month").orderBy("mes").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sums.withColumns({
        "_previous": _previous("_total", "_by_month"),
        "_top_n": F.max(F.when(dated | named, F.col("_n"))).over(whole),
        "_top_total": F.max(F.when(dated | named, F.col("_total"))).over(whole),
    })

    def earliest_best(value: str) -> Column:
        return F.min(F.when(dated & (F.col(value) == F.col(f"_top{value}")), F.col("mes")))

    def winner(value: str) -> Column:
        return F.when(named & (F.col(value) == F.col(f"_top{value}")), category)

    def favourite(value: str) -> Column:
        names = F.col(f"_winner{value}")
        if ties == "first":
            return F.min(names)
        return F.when(F.count(names) > 0, F.array_join(F.array_sort(F.collect_list(names)), " + "))

    def of_months(value: str) -> Column:
        return F.when(month, F.col(value))

    def of_category(c: str, value: str) -> Column:
        return F.when(~month & _is(c), F.col(value))

    spend = F.when(named, F.col("_total").cast("double"))
    relative = F.when(month, _relative_change(variant))
    added = {
        "_n": of_months("_n"), "_priced": of_months("_priced"), "_total": of_months("_total"),
        "_dated_total": F.when(dated, F.col("_total")), "_dated_n": F.when(dated, F.col("_n")),
        "_change": F.when(dated, F.col("_total") - F.col("_previous")), "_relative": relative, "_spend": spend, "_squares": spend * spend,
        **{f"_n_{c}": of_category(c, "_n") for c in categories}, **{f"_c_{c}": of_category(c, "_cents") for c in categories},
    }
    # Winners are keys first: what is summed has a fixed width then, and few rows are left for the names.
    narrow = ranked.groupBy("user_id", winner("_n").alias("_winner_n"), winner("_total").alias("_winner_total")).agg(
        *[F.sum(v).alias(name) for name, v in added.items()],
        F.count("mes").alias("_months"),
        F.count(relative).alias("_relatives"),
        F.max(of_months("_last")).alias("_last"),
        earliest_best("_n").alias("mes_mas_compras"),
        earliest_best("_total").alias("mes_mayor_monto"),
        F.max(F.when(named, F.col("_top_total"))).alias("_top_total"),
    )
    winners = F.lit(1) if ties == "first" else F.count("_winner_total")
    return narrow.groupBy("user_id").agg(
        *[F.sum(c).alias(c) for c in ("_n", "_priced", "_total", "_months", "_dated_total", "_dated_n", "_change")],
        F.max("_last").alias("_last"),
        F.min("mes_mas_compras").alias("mes_mas_compras"),
        F.min("mes_mayor_monto").alias("mes_mayor_monto"),
        F.try_divide(F.sum("_relative"), F.sum("_relatives")).alias("variacion_mensual_promedio_pct"),
        *[F.coalesce(F.sum(f"_n_{c}"), F.lit(0)).alias(f"_n_{c}") for c in categories],
        *[F.sum(f"_c_{c}").alias(f"_c_{c}") for c in categories],
        favourite("_n").alias("categoria_favorita"), favourite("_total").alias("categoria_favorita_monto"),
        (F.max("_top_total") * winners / 100).alias("total_spend_fav"),
        F.try_divide(F.sum("_squares"), F.sum("_spend") * F.sum("_spend")).alias("hhi"),
    )


def transaction_features(
    transactions: DataFrame,
    reference_date: str = S.REFERENCE_DATE,
    change_variant: str = "v12",
    ties: str = "first",
    categories: Sequence[str] = S.MERCHANT_CATEGORIES,
    spend_columns: bool = False,
    by_category: bool = True,
) -> DataFrame:
    """All transaction columns, one row per customer with transactions.

    Without ``by_category`` nothing is summed per category; the columns that tell of categories hold
    no information then and are meant to be left out.

    ``change_variant`` is ``v12`` (the first month counts as a change of 0) or ``skip_first``.
    ``categories`` names the count columns; favourites and concentration know every category.
    """
    sums = per_customer(by_month_and_category(monthly_by_category(transactions), by_category), categories, change_variant, ties)
    changes = F.col("_months") if change_variant == "v12" else F.col("_months") - 1
    change = F.col("_change") if change_variant == "skip_first" else F.coalesce("_change", F.lit(0))
    total = F.col("_total") / 100
    columns = [
        F.col("_n").alias("total_transacciones"),
        F.try_divide(total, F.col("_priced")).alias("monto_promedio_transaccion"),
        total.alias("total_spend"),
        F.col("_months").alias("n_meses_activos"),
        F.datediff(F.lit(reference_date).cast("date"), F.col("_last")).alias("recencia_transaccion"),
        *[F.col(f"_n_{c}").alias(f"{c}_count") for c in categories],
        *([(F.coalesce(F.col(f"_c_{c}"), F.lit(0)) / 100).alias(f"{c}_spend") for c in categories]
          if spend_columns else []),
        F.col("categoria_favorita"),
        F.col("categoria_favorita_monto"),
        F.coalesce("total_spend_fav", F.lit(0.0)).alias("total_spend_fav"),
        F.coalesce("hhi", F.lit(0.0)).alias("hhi"),
        F.try_divide(F.coalesce("total_spend_fav", F.lit(0.0)), total).alias("share_fav"),
        F.col("mes_mas_compras"),
        F.col("mes_mayor_monto"),
        F.try_divide(F.col("_dated_total") / 100, F.col("_months")).alias("monto_promedio_mensual"),
        F.try_divide(F.col("_dated_n").cast("double"), F.col("_months")).alias("transacciones_promedio_mensual"),
        F.try_divide(change / 100, changes).alias("variacion_mensual_promedio"),
        F.col("variacion_mensual_promedio_pct"),
    ]
    return sums.select("user_id", *columns)


def spend_trend(transactions: DataFrame, change_variant: str = "v12") -> DataFrame:
    """Monthly spend trend and peak months of each customer."""
    return transaction_features(transactions, change_variant=change_variant, by_category=False).select(
        "user_id", "n_meses_activos", "mes_mas_compras", "mes_mayor_monto",
        "monto_promedio_mensual", "transacciones_promedio_mensual",
        "variacion_mensual_promedio", "variacion_mensual_promedio_pct",
    )


def by_customer_category(transactions: DataFrame) -> DataFrame:
    """Long form: spend and count per customer and category, whatever the categories are."""
    return (
        transactions.where(F.col("user_id").isNotNull() & F.col("merchant_category").isNotNull())
        .groupBy("user_id", "merchant_category")
        .agg(F.coalesce(F.sum(cents("amount")), F.lit(0)).alias("_total"),
             F.count("transaction_id").alias("n"))
        .select("user_id", "merchant_category", (F.col("_total") / 100).alias("total_spend_cat"), "n")
    )


def category_shares(transactions: DataFrame) -> DataFrame:
    """Each category's part of its customer's spend; the window runs over category sums."""
    whole = Window.partitionBy("user_id")
    return (
        by_customer_category(transactions)
        .withColumn("user_spend", F.sum(cents("total_spend_cat")).over(whole) / 100)
        .withColumn("pcat", F.try_divide(F.col("total_spend_cat"), F.col("user_spend")))
    )


def best_category_rows(transactions: DataFrame) -> DataFrame:
    """The category rows whose spend equals their customer's largest (all of them on ties)."""
    whole = Window.partitionBy("user_id")
    return (
        by_customer_category(transactions)
        .withColumn("max_spend_cat", F.max("total_spend_cat").over(whole))
        .where(F.col("total_spend_cat") == F.col("max_spend_cat"))
    )


def spend_in_named(transactions: DataFrame, named: DataFrame, column: str) -> DataFrame:
    """Spend over the categories a text such as ``food + travel`` names, per customer.

    ``named`` has user_id and ``column``. The text is split to rows and matched with the category
    sums, both sides small per customer.
    """
    wanted = named.select(
        "user_id", F.explode(F.split(F.col(column), r" \+ ")).alias("merchant_category")).distinct()
    return (
        by_customer_category(transactions).join(wanted, ["user_id", "merchant_category"])
        .groupBy("user_id").agg((F.sum(cents("total_spend_cat")) / 100).alias("total_spend_fav"))
    )


def best_month(transactions: DataFrame, by: str = "monto_mes") -> DataFrame:
    """The best month row per customer: largest ``by``, earliest month on ties."""
    order = Window.partitionBy("user_id").orderBy(F.desc(by), "mes")
    return (
        monthly_rollup(transactions).withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") == 1).drop("_rank")
    )
