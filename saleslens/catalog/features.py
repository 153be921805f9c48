"""Product, transaction and assembled features."""

from __future__ import annotations

from pyspark.sql import functions as F

from saleslens import schemas as S
from saleslens.catalog.base import Tables, over, query, rounded
from saleslens.functions import combo_label, combo_listed
from saleslens.operators import maintained as MT
from saleslens.operators import products as P
from saleslens.operators import transactions as X
from saleslens.plans import features as FE
from saleslens.session import scratch
from saleslens.sources.adapters import REFERENCE_DATE

FLAGS = "checking_account, savings_account, credit_card, insurance, investment"
COUNTS = ", ".join(f"{c}_count" for c in S.MERCHANT_CATEGORIES)

# -- products -----------------------------------------------------------------


@query("a01_ownership_flags", over("flags") + "SELECT * FROM flags")
def ownership(spark, sf_dir):
    return P.ownership_flags(Tables(spark, sf_dir).products)


@query("p01_recoded_products", over("recoded") + "SELECT * FROM recoded")
def recoded(spark, sf_dir):
    return P.recoded(Tables(spark, sf_dir).products)


@query("a04_first_second_product", over("pair") + "SELECT * FROM pair")
def first_second(spark, sf_dir):
    return P.first_second(Tables(spark, sf_dir).products)


@query("w01_second_product_rows",
       over("numbered") + "SELECT user_id, product_type, contract_date FROM numbered WHERE rank = 2")
def second_rows(spark, sf_dir):
    return P.nth_product(Tables(spark, sf_dir).products, 2)


@query("j02_first_and_second_joined", over("numbered") + """
SELECT a.user_id, a.product_type AS primer_producto, b.product_type AS segundo_producto,
 a.contract_date AS fecha_primer_producto, b.contract_date AS fecha_segundo_producto
FROM numbered a LEFT JOIN numbered b ON a.user_id = b.user_id AND b.rank = 2 WHERE a.rank = 1""")
def first_and_second(spark, sf_dir):
    return P.first_second(Tables(spark, sf_dir).products)


def _product_features(**options):
    def run(spark, sf_dir):
        return P.product_features(Tables(spark, sf_dir).products, REFERENCE_DATE, **options)
    return run


query("a07_days_between_v12", over("prod_v12") + """
SELECT user_id, CAST(dias_entre_productos AS INTEGER) AS dias_entre_productos FROM prod_v12""")(
    lambda spark, sf_dir: _product_features()(spark, sf_dir).select("user_id", "dias_entre_productos"))
query("a07_days_between_zero", over("prod_v0") + """
SELECT user_id, CAST(coalesce(dias_entre_productos, 0) AS INTEGER) AS dias_entre_productos FROM prod_v0""")(
    lambda spark, sf_dir: _product_features(second_variant="zero")(spark, sf_dir).select("user_id", "dias_entre_productos"))
query("a08_tenure", over("prod_side") + """
SELECT user_id, CAST(antiguedad_cliente AS INTEGER) AS antiguedad_cliente FROM prod_side""")(
    lambda spark, sf_dir: _product_features()(spark, sf_dir).select("user_id", "antiguedad_cliente"))
query("a09_number_of_products", over("prod_side") + """
SELECT user_id, numero_productos FROM prod_side""")(
    lambda spark, sf_dir: _product_features()(spark, sf_dir).select("user_id", "numero_productos"))


@query("f04_combination_label", over("prod_v12") + "SELECT user_id, combinacion_productos FROM prod_v12")
def combos(spark, sf_dir):
    flags = P.ownership_flags(Tables(spark, sf_dir).products)
    return flags.select("user_id", combo_label({p: F.col(p) for p in S.PRODUCT_FLAGS}).alias("combinacion_productos"))


@query("f05_listed_combination", over("prod_v0") + "SELECT user_id, combinacion_productos FROM prod_v0")
def listed(spark, sf_dir):
    flags = P.ownership_flags(Tables(spark, sf_dir).products)
    return flags.select("user_id", combo_listed({p: F.col(p) for p in S.PRODUCT_FLAGS}).alias("combinacion_productos"))


@query("product_features_v12", over("prod_v12") + f"""
SELECT user_id, primer_producto, fecha_primer_producto, segundo_producto, fecha_segundo_producto, {FLAGS},
 numero_productos, combinacion_productos, CAST(dias_entre_productos AS INTEGER) AS dias_entre_productos,
 CAST(antiguedad_cliente AS INTEGER) AS antiguedad_cliente FROM prod_v12""")
def product_features(spark, sf_dir):
    return _product_features()(spark, sf_dir)


@query("a25_products_per_user", over("products") + """
SELECT user_id, count(*) AS total_productos FROM products GROUP BY user_id""")
def per_user(spark, sf_dir):
    return P.products_per_user(Tables(spark, sf_dir).products)


@query("a25_mean_products", over("products") + """
SELECT count(*) AS usuarios, sum(n)::DOUBLE / count(*) AS media_productos
FROM (SELECT count(*) AS n FROM products GROUP BY user_id)""")
def mean_per_user(spark, sf_dir):
    return P.mean_products_per_user(Tables(spark, sf_dir).products)


@query("j06_rows_with_own_count", over("products") + """
SELECT *, count(*) OVER (PARTITION BY user_id) AS total_productos FROM products""")
def own_count(spark, sf_dir):
    return P.with_own_count(Tables(spark, sf_dir).products)


@query("j06_types_by_own_count", over("products") + """
SELECT product_type, total_productos, count(*) AS n
FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS total_productos FROM products) GROUP BY ALL""")
def types_by_count(spark, sf_dir):
    return P.types_by_own_count(Tables(spark, sf_dir).products)


@query("a30_product_combinations", over("products") + """
SELECT combinacion, count(*) AS n FROM (SELECT user_id, string_agg(DISTINCT product_type, ' + ' ORDER BY product_type)
 AS combinacion FROM products GROUP BY user_id) GROUP BY combinacion""")
def combination_counts(spark, sf_dir):
    from saleslens.operators.profile import frequency

    return frequency(P.combinations(Tables(spark, sf_dir).products), "combinacion", ordered=True)


# -- transactions -----------------------------------------------------------------


def _tx(*columns, digits=(), **options):
    def run(spark, sf_dir):
        df = X.transaction_features(Tables(spark, sf_dir).transactions, REFERENCE_DATE, **options)
        df = df.select("user_id", *columns) if columns else df
        return rounded(df, 6, *digits) if digits else df
    return run


query("a02_category_counts", over("cat_counts") + "SELECT * FROM cat_counts")(
    _tx(*[f"{c}_count" for c in S.MERCHANT_CATEGORIES]))
query("a03_basic_stats", over("basic") + """
SELECT user_id, n AS total_transacciones, total / 100.0::DOUBLE / n AS monto_promedio_transaccion,
 total / 100.0::DOUBLE AS total_spend FROM basic""")(
    _tx("total_transacciones", "monto_promedio_transaccion", "total_spend"))
query("a05_active_months", over("basic") + "SELECT user_id, months AS n_meses_activos FROM basic")(_tx("n_meses_activos"))
query("a06_recency", over("basic") + """
SELECT user_id, CAST(date_diff('day', last, DATE '2002-01-01') AS INTEGER) AS recencia_transaccion FROM basic""")(
    _tx("recencia_transaccion"))
query("a10_spend_by_category", over("transactions") + "SELECT user_id, " + ", ".join(
    f"CAST(coalesce(sum(cents) FILTER (merchant_category = '{c}'), 0) AS BIGINT) / 100.0::DOUBLE AS {c}_spend"
    for c in S.MERCHANT_CATEGORIES) + " FROM transactions GROUP BY user_id")(
    _tx(*[f"{c}_spend" for c in S.MERCHANT_CATEGORIES], spend_columns=True))
def _more_categories(transactions):
    """An eighth category and rows without one, by the day of the month."""
    ninth = F.day("date") % 9
    return transactions.withColumn("merchant_category", F.when(ninth == 7, "fuel").when(ninth != 8, F.col("merchant_category")))


query("a11_favourite_by_count", over("favour") + "SELECT user_id, categoria_favorita FROM favour")(_tx("categoria_favorita"))
query("a11_a16_favourites_in_any_category", over("transactions", more="""
named AS (SELECT user_id, cents, CASE WHEN day(date) % 9 = 7 THEN 'fuel' WHEN day(date) % 9 = 8 THEN NULL
 ELSE merchant_category END AS category FROM transactions),
other AS (SELECT user_id, category, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM named WHERE category IS NOT NULL
 GROUP BY user_id, category)""") + """
SELECT user_id, first(category ORDER BY n DESC, category) AS categoria_favorita,
 first(category ORDER BY total DESC, category) AS categoria_favorita_monto, max(total) / 100.0::DOUBLE AS total_spend_fav,
 round(sum(power(total::DOUBLE, 2)) / power(sum(total)::DOUBLE, 2), 6) AS hhi FROM other GROUP BY user_id""")(
    lambda spark, sf_dir: rounded(X.transaction_features(_more_categories(Tables(spark, sf_dir).transactions)).where(
        "categoria_favorita IS NOT NULL").select("user_id", "categoria_favorita", "categoria_favorita_monto", "total_spend_fav", "hhi"), 6, "hhi"))
query("a12_favourite_by_count_tied", over("tied") + "SELECT user_id, categoria_favorita FROM tied")(
    _tx("categoria_favorita", ties="joined"))
query("a13_favourite_by_amount", over("favour") + """
SELECT user_id, categoria_favorita_monto, total_spend_fav FROM favour""")(
    _tx("categoria_favorita_monto", "total_spend_fav"))
query("a14_favourite_by_amount_tied", over("tied") + """
SELECT user_id, categoria_favorita_monto, total_spend_fav FROM tied""")(
    _tx("categoria_favorita_monto", "total_spend_fav", ties="joined"))
query("a15_share_of_favourite", over("favour", "basic") + """
SELECT user_id, total_spend_fav / nullif(total / 100.0::DOUBLE, 0) AS share_fav FROM favour JOIN basic USING (user_id)""")(
    _tx("share_fav"))
query("a16_concentration", over("conc") + "SELECT user_id, round(hhi, 6) AS hhi FROM conc")(_tx("hhi", digits=("hhi",)))


@query("a17_monthly_rollup", over("monthly") + """
SELECT user_id, mes, total / 100.0::DOUBLE AS monto_mes, n AS transacciones_mes FROM monthly""")
def rollup(spark, sf_dir):
    return X.monthly_rollup(Tables(spark, sf_dir).transactions)


query("a18_peak_months", over("peaks") + "SELECT * FROM peaks")(_tx("mes_mas_compras", "mes_mayor_monto"))
query("a19_monthly_averages", over("trend") + """
SELECT user_id, total / 100.0::DOUBLE / months AS monto_promedio_mensual,
 n::DOUBLE / months AS transacciones_promedio_mensual FROM trend""")(
    _tx("monto_promedio_mensual", "transacciones_promedio_mensual"))
query("a20_mean_change_v12", over("trend") + """
SELECT user_id, change / 100.0::DOUBLE / months AS variacion_mensual_promedio,
 round(pct_all, 6) AS variacion_mensual_promedio_pct FROM trend""")(
    _tx("variacion_mensual_promedio", "variacion_mensual_promedio_pct", digits=("variacion_mensual_promedio_pct",)))
query("a20_mean_change_skip_first", over("trend") + """
SELECT user_id, CASE WHEN months > 1 THEN change / 100.0::DOUBLE / (months - 1) END AS variacion_mensual_promedio,
 round(pct_skip, 6) AS variacion_mensual_promedio_pct FROM trend""")(
    _tx("variacion_mensual_promedio", "variacion_mensual_promedio_pct", digits=("variacion_mensual_promedio_pct",),
        change_variant="skip_first"))


@query("w02_monthly_changes", over("lagged") + """
SELECT user_id, mes, total / 100.0::DOUBLE AS monto_mes, n AS transacciones_mes,
 round(total / 100.0::DOUBLE - previous / 100.0::DOUBLE, 2) AS variacion_monto,
 round(total::DOUBLE / previous - 1, 6) AS variacion_monto_pct FROM lagged""")
def changes(spark, sf_dir):
    df = X.monthly_changes(X.monthly_rollup(Tables(spark, sf_dir).transactions))
    return rounded(rounded(df, 2, "variacion_monto"), 6, "variacion_monto_pct")


def _deltas(t):
    """A first load of most transactions and three later ones."""
    tx = t.transactions
    part = F.pmod(F.xxhash64("transaction_id"), F.lit(10))
    return tx.where(part < 7), [tx.where(part == i) for i in (7, 8, 9)]


@query("a17_maintained_rollup", over("monthly") + """
SELECT user_id, mes, total / 100.0::DOUBLE AS monto_mes, n AS transacciones_mes FROM monthly""")
def maintained_rollup(spark, sf_dir):
    """Stored sums of a first load and three deltas, one of them sent twice."""
    first, deltas = _deltas(Tables(spark, sf_dir))
    store = MT.create_sums(first, scratch(spark), 16)
    for name, delta in (("a", deltas[0]), ("b", deltas[1]), ("b", deltas[1]), ("c", deltas[2])):
        MT.add_transactions(store, delta, name)
    return MT.months(store.read()).select("user_id", "mes", (F.col("cents") / 100).alias("monto_mes"), "transacciones_mes")


@query("w02_maintained_changes", over("lagged") + """
SELECT user_id, mes, total / 100.0::DOUBLE AS monto_mes, n AS transacciones_mes,
round(total / 100.0::DOUBLE - previous / 100.0::DOUBLE, 2) AS variacion_monto,
round(total::DOUBLE / previous - 1, 6) AS variacion_monto_pct FROM lagged""")
def maintained_changes(spark, sf_dir):
    first, deltas = _deltas(Tables(spark, sf_dir))
    store = MT.create_changes(MT.sums_of(first), scratch(spark), 16)
    for i, delta in enumerate(deltas):
        MT.add_to_changes(store, delta, f"delta {i}")
    return rounded(rounded(MT.changes(store), 2, "variacion_monto"), 6, "variacion_monto_pct")


@query("a18_a20_maintained_trend", over("trend", "peaks") + """
SELECT user_id, months AS n_meses_activos, mes_mas_compras, mes_mayor_monto, round(pct_all, 6) AS variacion_mensual_promedio_pct
FROM trend JOIN peaks USING (user_id)""")
def maintained_trend(spark, sf_dir):
    first, deltas = _deltas(Tables(spark, sf_dir))
    store = MT.create_sums(first, scratch(spark), 16)
    for i, delta in enumerate(deltas):
        MT.add_transactions(store, delta, f"delta {i}")
    return rounded(MT.customer_sums(store).select(
        "user_id", F.col("_months").alias("n_meses_activos"), "mes_mas_compras", "mes_mayor_monto", "variacion_mensual_promedio_pct"), 6)


@query("w04_category_shares", over("cats") + """
SELECT user_id, merchant_category, total / 100.0::DOUBLE AS total_spend_cat, n,
 CAST(sum(total) OVER (PARTITION BY user_id) AS BIGINT) / 100.0::DOUBLE AS user_spend,
 round(total::DOUBLE / sum(total) OVER (PARTITION BY user_id)::DOUBLE, 6) AS pcat FROM cats""")
def shares(spark, sf_dir):
    return rounded(X.category_shares(Tables(spark, sf_dir).transactions), 6, "pcat")


@query("w05_best_month_row", over("monthly") + """
SELECT user_id, mes, total / 100.0::DOUBLE AS monto_mes, n AS transacciones_mes FROM monthly
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY total DESC, mes) = 1""")
def best_month(spark, sf_dir):
    return X.best_month(Tables(spark, sf_dir).transactions)


@query("j04_best_category_rows", over("cats") + """
SELECT c.user_id, merchant_category, total / 100.0::DOUBLE AS total_spend_cat, n, top / 100.0::DOUBLE AS max_spend_cat
FROM cats c JOIN (SELECT user_id, max(total) AS top FROM cats GROUP BY user_id) m
 ON c.user_id = m.user_id AND c.total = m.top""")
def best_rows(spark, sf_dir):
    return X.best_category_rows(Tables(spark, sf_dir).transactions)


@query("j07_spend_in_named_categories", over("cats", "tied") + """
SELECT c.user_id, CAST(sum(total) AS BIGINT) / 100.0::DOUBLE AS total_spend_fav
FROM cats c JOIN tied t ON c.user_id = t.user_id AND list_contains(string_split(t.categoria_favorita, ' + '), merchant_category)
GROUP BY c.user_id""")
def spend_named(spark, sf_dir):
    tx = Tables(spark, sf_dir).transactions
    named = X.transaction_features(tx, ties="joined").select("user_id", "categoria_favorita")
    return X.spend_in_named(tx, named, "categoria_favorita")


IRRATIONAL = ("hhi", "share_fav", "variacion_mensual_promedio_pct")
query("j03_transaction_features_v12", over("tx_v12") + "SELECT * FROM tx_v12")(_tx(digits=IRRATIONAL))
query("j03_transaction_features_v0", over("tx_v0") + "SELECT * FROM tx_v0")(
    _tx(digits=IRRATIONAL, ties="joined", change_variant="skip_first"))


@query("spend_trend", over("trend", "peaks") + """
SELECT user_id, months AS n_meses_activos, mes_mas_compras, mes_mayor_monto,
 total / 100.0::DOUBLE / months AS monto_promedio_mensual, n::DOUBLE / months AS transacciones_promedio_mensual,
 change / 100.0::DOUBLE / months AS variacion_mensual_promedio, round(pct_all, 6) AS variacion_mensual_promedio_pct
FROM trend JOIN peaks USING (user_id)""")
def spend_trend(spark, sf_dir):
    return rounded(X.spend_trend(Tables(spark, sf_dir).transactions), 6, "variacion_mensual_promedio_pct")


# -- assembled --------------------------------------------------------------------

JOINED_V0 = """joined AS MATERIALIZED (SELECT d.*, p.* EXCLUDE (user_id, dias_entre_productos, antiguedad_cliente),
 CAST(dias_entre_productos AS INTEGER) AS dias_entre_productos,
 CAST(antiguedad_cliente AS INTEGER) AS antiguedad_cliente, t.* EXCLUDE (user_id)
 FROM banded d LEFT JOIN prod_v0 p USING (user_id) LEFT JOIN tx_v0 t USING (user_id))"""
CLEANED = """cleaned AS MATERIALIZED (SELECT * REPLACE (coalesce(segundo_producto, 'none') AS segundo_producto,
 coalesce(fecha_segundo_producto, DATE '1900-01-01') AS fecha_segundo_producto,
 coalesce(dias_entre_productos, 0) AS dias_entre_productos) FROM joined)"""
GENERAL = """general AS MATERIALIZED (SELECT * EXCLUDE (total_spend, monto_promedio_mensual, monto_promedio_transaccion,
 hhi, share_fav, total_transacciones) FROM cleaned)"""
ALL_V0 = ("banded", "prod_v0", "tx_v0")


def raw(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return FE.raw_features(t.demographics, t.products, t.transactions, REFERENCE_DATE)


def _rounded_raw(df):
    return rounded(df, 6, *[c for c in IRRATIONAL if c in df.columns])


query("c02_raw_features", over(*ALL_V0, more=JOINED_V0) + "SELECT * FROM joined")(
    lambda spark, sf_dir: _rounded_raw(raw(spark, sf_dir)))
query("c03_cleaned_features", over(*ALL_V0, more=f"{JOINED_V0}, {CLEANED}") + "SELECT * FROM cleaned")(
    lambda spark, sf_dir: _rounded_raw(FE.cleaned_features(raw(spark, sf_dir))))
query("c04_general_features", over(*ALL_V0, more=f"{JOINED_V0}, {CLEANED}, {GENERAL}") + "SELECT * EXCLUDE (categoria_favorita) FROM general")(
    lambda spark, sf_dir: _rounded_raw(FE.general_features(FE.cleaned_features(raw(spark, sf_dir)))))


@query("j01_customer_left_join", over("banded", "prod_v12", "basic") + """
SELECT d.user_id, age_range_sturges, primer_producto, n AS total_transacciones
FROM banded d LEFT JOIN prod_v12 USING (user_id) LEFT JOIN basic USING (user_id)""")
def left_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return FE.joined(t.demographics, P.product_features(t.products),
                     X.transaction_features(t.transactions)).select(
        "user_id", "age_range_sturges", "primer_producto", "total_transacciones")


BASE_V12 = """base AS MATERIALIZED (SELECT d.*, p.* EXCLUDE (user_id, dias_entre_productos),
 coalesce(dias_entre_productos, 0) AS dias_entre_productos,
 t.* EXCLUDE (user_id, variacion_mensual_promedio, variacion_mensual_promedio_pct),
 coalesce(variacion_mensual_promedio, 0) AS variacion_mensual_promedio,
 coalesce(pct_all, 0) AS variacion_mensual_promedio_pct
 FROM banded d LEFT JOIN prod_v12 p USING (user_id) LEFT JOIN tx_v12 t USING (user_id) LEFT JOIN trend r USING (user_id))"""


def scaled_sql(column: str) -> str:
    return (f"round(({column} - avg({column}) OVER ()) / CASE WHEN stddev_pop({column}) OVER () = 0 THEN 1 "
            f"ELSE stddev_pop({column}) OVER () END, 6) AS {column}")


def coded_sql(column: str) -> str:
    return f"CAST(dense_rank() OVER (ORDER BY coalesce({column}, 'nan')) - 1 AS INTEGER) AS {column}"


C01_SQL = over("banded", "prod_v12", "tx_v12", "trend", more=BASE_V12) + "SELECT user_id, " + ", ".join([
    *[scaled_sql(c) for c in FE.SCALED],
    *[coded_sql(c) for c in FE.ENCODED if c != "combinacion_productos"],
    FLAGS, COUNTS, "n_meses_activos", "round(ln(1 + total_spend_fav), 6) AS total_spend_fav",
    *[f"CAST(epoch({c}) AS BIGINT) AS {c}_ts" for c in ("fecha_primer_producto", "mes_mas_compras", "mes_mayor_monto")],
]) + " FROM base"


@query("c01_generate_features", C01_SQL)
def generated(spark, sf_dir):
    t = Tables(spark, sf_dir)
    df = FE.generate_features(t.demographics, t.products, t.transactions, REFERENCE_DATE)
    return rounded(df, 6)
