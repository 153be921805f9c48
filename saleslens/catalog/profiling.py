"""Exploratory profiling, cleaning, encoders and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from saleslens import schemas as S
from saleslens.catalog.base import Tables, over, query, rounded
from saleslens.catalog.features import (
    ALL_V0,
    CLEANED,
    JOINED_V0,
    coded_sql,
    raw,
    scaled_sql,
)
from saleslens.functions import age_band, amount_edges, amount_labels, cut, epoch, month_of, quarter_label
from saleslens.operators import cleaning as C
from saleslens.operators import encode as E
from saleslens.operators import profile as R
from saleslens.operators import ranks as RK
from saleslens.operators import transactions as X
from saleslens.operators.ranks import exact_quantiles
from saleslens.plans import features as FE
from saleslens.session import durable, scratch
from saleslens.sources import tables as IO
from saleslens.sources.adapters import REFERENCE_DATE, table

# -- one column -------------------------------------------------------------------


@query("a21_age_profile", over("demographics") + """
SELECT round(avg(age), 6) AS media, min(age) AS minimo, max(age) AS maximo, round(var_samp(age), 6) AS varianza,
 round(stddev_samp(age), 6) AS desviacion, median(age) AS mediana,
 (SELECT first(age ORDER BY n DESC, age) FROM (SELECT age, count(*) AS n FROM demographics GROUP BY age)) AS moda FROM demographics""")
def age_profile(spark, sf_dir):
    return rounded(R.univariate(Tables(spark, sf_dir).demographics, "age"), 6)


@query("a21_amount_profile", over("transactions") + """
SELECT round(avg(amount), 4) AS media, min(amount) AS minimo, max(amount) AS maximo, round(var_samp(amount), 1) AS varianza,
 round(stddev_samp(amount), 4) AS desviacion, round(median(amount), 4) AS mediana,
 (SELECT first(amount ORDER BY n DESC, amount) FROM (SELECT amount, count(*) AS n FROM transactions GROUP BY amount)) AS moda
FROM transactions""")
def amount_profile(spark, sf_dir):
    df = R.univariate(Tables(spark, sf_dir).transactions, "amount")
    return rounded(rounded(df, 4, "media", "desviacion", "mediana"), 1, "varianza")


@query("a22_frequency", over("demographics") + "SELECT occupation, count(*) AS n FROM demographics GROUP BY 1")
def frequency(spark, sf_dir):
    return R.frequency(Tables(spark, sf_dir).demographics, "occupation", ordered=True)


@query("a23_by_month", over("transactions") + """
SELECT CAST(date_trunc('month', date) AS DATE) AS mes, count(*) AS n FROM transactions GROUP BY 1""")
def by_month(spark, sf_dir):
    return R.by_month(Tables(spark, sf_dir).transactions, "date")


@query("a23_by_year", over("products") + """
SELECT CAST(year(contract_date) AS INTEGER) AS anio, count(*) AS n FROM products GROUP BY 1""")
def by_year(spark, sf_dir):
    return R.by_year(Tables(spark, sf_dir).products, "contract_date")


@query("a23_by_quarter", over("transactions") + """
SELECT CAST(year(date) AS INTEGER) AS anio, CAST(quarter(date) AS INTEGER) AS trimestre, count(*) AS n
FROM transactions GROUP BY 1, 2""")
def by_quarter(spark, sf_dir):
    return R.by_quarter(Tables(spark, sf_dir).transactions, "date")


@query("a23_o04_by_quarter_label", over("products") + """
SELECT 'T' || quarter(contract_date) || ' ' || year(contract_date) AS periodo,
 year(contract_date) + (quarter(contract_date) - 1) / 4.0::DOUBLE AS periodo_num, count(*) AS n FROM products GROUP BY 1, 2""")
def by_label(spark, sf_dir):
    return R.by_quarter_label(Tables(spark, sf_dir).products, "contract_date")


@query("a24_duplicate_keys", over("products") + """
SELECT user_id, product_type, count(*) AS n FROM products GROUP BY ALL HAVING count(*) > 1""")
def duplicates(spark, sf_dir):
    return R.duplicates(Tables(spark, sf_dir).products, ["user_id", "product_type"])


@query("a33_null_counts", over("clients") + " UNION ALL ".join(
    f"SELECT '{c}' AS columna, count(*) FILTER ({c} IS NULL) AS nulos FROM clients"
    for c in ("id", "user_id", "age", "segment", "probability", "status")))
def nulls(spark, sf_dir):
    return R.null_counts(Tables(spark, sf_dir).clients.select("id", "user_id", "age", "segment", "probability", "status"))


@query("a34_describe", over("transactions", "demographics", more="""
v AS (SELECT 'amount' AS columna, amount AS valor FROM transactions)""") + """
SELECT columna, count(valor) AS n, round(avg(valor), 4) AS media, round(stddev_samp(valor), 4) AS desviacion,
 min(valor) AS minimo, max(valor) AS maximo, round(quantile_cont(valor, 0.25), 4) AS q25,
 round(quantile_cont(valor, 0.5), 4) AS q50, round(quantile_cont(valor, 0.75), 4) AS q75 FROM v GROUP BY columna""")
def describe(spark, sf_dir):
    return rounded(R.describe(Tables(spark, sf_dir).transactions, ["amount"]), 4)


@query("a34_describe_clients", over("clients", more="""
v AS (SELECT 'age' AS columna, age::DOUBLE AS valor FROM clients UNION ALL SELECT 'probability', probability FROM clients)""") + """
SELECT columna, count(valor) AS n, round(avg(valor), 6) AS media, round(stddev_samp(valor), 6) AS desviacion,
 round(min(valor), 6) AS minimo, round(max(valor), 6) AS maximo, round(quantile_cont(valor, 0.25), 6) AS q25,
 round(quantile_cont(valor, 0.5), 6) AS q50, round(quantile_cont(valor, 0.75), 6) AS q75 FROM v GROUP BY columna""")
def describe_clients(spark, sf_dir):
    return rounded(R.describe(Tables(spark, sf_dir).clients, ["age", "probability"]), 6)


@query("a34_sketched_quartiles", over("transactions") + """
SELECT merchant_category, cuartil, TRUE AS cerca FROM (SELECT DISTINCT merchant_category FROM transactions), (VALUES ('q25'), ('q50'), ('q75')) v(cuartil)""")
def sketched_quartiles(spark, sf_dir):
    """Quartiles from one sketch for each month, merged; each has the right part of the amounts below it, within twice the stated error."""
    tx, quartiles = Tables(spark, sf_dir).transactions.withColumn("mes", month_of("date")), {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    merged = RK.merged_sketches(RK.quantile_sketch(tx, "amount", ["merchant_category", "mes"]), ["merchant_category"])
    found = durable(RK.sketched_quantiles(merged, quartiles))
    parts = tx.join(found, "merchant_category").groupBy("merchant_category").agg(*[
        F.array(F.avg((F.col("amount") < F.col(q)).cast("int")), F.avg((F.col("amount") <= F.col(q)).cast("int"))).alias(q) for q in quartiles])
    near = F.array(*[F.struct(F.lit(q).alias("cuartil"), ((F.col(q)[0] - f < 0.0266) & (f - F.col(q)[1] < 0.0266)).alias("cerca"))
                     for q, f in quartiles.items()])
    return parts.select("merchant_category", F.explode(near).alias("r")).select("merchant_category", "r.*")


@query("a35_top_values", over("products") + """
SELECT product_type, count(*) AS n FROM products GROUP BY 1 ORDER BY n DESC, product_type LIMIT 3""")
def top(spark, sf_dir):
    return R.top_values(Tables(spark, sf_dir).products, "product_type", 3)


@query("a35_distinct_count", over("transactions") + "SELECT count(DISTINCT amount) AS n_distinct FROM transactions")
def distinct(spark, sf_dir):
    return R.distinct_count(Tables(spark, sf_dir).transactions, "amount")


@query("u03_distinct_values", over("demographics") + "SELECT DISTINCT income_range FROM demographics")
def values(spark, sf_dir):
    return R.distinct_values(Tables(spark, sf_dir).demographics, "income_range")


@query("a38_extrema", over("transactions") + "SELECT min(amount) AS minimo, max(amount) AS maximo FROM transactions")
def extrema(spark, sf_dir):
    return R.extrema(Tables(spark, sf_dir).transactions, "amount")


BINS = "CASE " + " ".join(
    f"WHEN amount <= {(i + 1) * 10000} THEN '{i * 10000}–{(i + 1) * 10000}'" for i in range(11)) + " END"


@query("f02_amount_bins", over("transactions") + f"""
SELECT {BINS} AS amount_range, count(*) AS n FROM transactions GROUP BY 1""")
def amount_bins(spark, sf_dir):
    edges = amount_edges(0.0, 110000.0)
    ranged = Tables(spark, sf_dir).transactions.withColumn("amount_range", cut("amount", edges, amount_labels(edges)))
    return R.frequency(ranged, "amount_range")


@query("f01_age_bands", over("banded") + "SELECT user_id, age_range_sturges FROM banded")
def age_bands(spark, sf_dir):
    return Tables(spark, sf_dir).demographics.select("user_id", age_band("age").alias("age_range_sturges"))


# -- two columns --------------------------------------------------------------------


def _wide(values_of, column):
    return ", ".join(f"count(*) FILTER ({column} = '{v}') AS \"{v}\"" for v in values_of)


@query("a26_age_by_income", over("banded") + f"""
SELECT age_range_sturges, {_wide(S.INCOME_RANGES, 'income_range')} FROM banded GROUP BY 1""")
def age_by_income(spark, sf_dir):
    banded = FE.with_age_band(Tables(spark, sf_dir).demographics)
    return R.contingency(banded, "age_range_sturges", "income_range", S.INCOME_RANGES)


@query("a26_product_by_quarter", over("products") + """
SELECT product_type, """ + ", ".join(f"count(*) FILTER (quarter(contract_date) = {q}) AS \"T{q}\"" for q in range(1, 5))
       + " FROM products GROUP BY 1")
def product_by_quarter(spark, sf_dir):
    quarters = Tables(spark, sf_dir).products.withColumn("q", quarter_label("contract_date", with_year=False))
    return R.contingency(quarters, "product_type", "q", ["T1", "T2", "T3", "T4"])


@query("a26_product_by_year", over("products") + """
SELECT product_type, """ + ", ".join(f"count(*) FILTER (year(contract_date) = {y}) AS \"{y}\"" for y in range(1995, 2002))
       + " FROM products GROUP BY 1")
def product_by_year(spark, sf_dir):
    years = Tables(spark, sf_dir).products.withColumn("year", F.year("contract_date"))
    return R.contingency(years, "product_type", "year", range(1995, 2002))


@query("a26_product_by_every_year", over("products") + """
SELECT product_type, year(contract_date) AS year, count(*) AS n FROM products GROUP BY ALL""")
def product_by_every_year(spark, sf_dir):
    """All years there are, one row for each pair."""
    years = Tables(spark, sf_dir).products.withColumn("year", F.year("contract_date").cast("bigint"))
    return R.pair_counts(years, "product_type", "year")


for first_column in ("age_range_sturges", "income_range"):
    query(f"a26_{first_column}_by_risk", over("banded") + f"""
SELECT {first_column}, {_wide(S.RISK_PROFILES, 'risk_profile')} FROM banded GROUP BY 1""")(
        lambda spark, sf_dir, c=first_column: R.contingency(
            FE.with_age_band(Tables(spark, sf_dir).demographics), c, "risk_profile", S.RISK_PROFILES))


@query("a26_card_buyers_age_by_income", over("products", "banded") + f"""
SELECT age_range_sturges, {_wide(S.INCOME_RANGES, 'income_range')} FROM products LEFT JOIN banded USING (user_id)
WHERE product_type = 'credit_card' GROUP BY 1""")
def card_buyers_by_income(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = C.holders(t.products, "credit_card").join(FE.with_age_band(t.demographics), "user_id", "left")
    return R.contingency(rows, "age_range_sturges", "income_range", S.INCOME_RANGES)


for attribute in ("income_range", "age_range_sturges", "risk_profile"):
    query(f"j05_a26_{attribute}_by_category", over("transactions", "banded") + f"""
SELECT {attribute}, {_wide(S.MERCHANT_CATEGORIES, 'merchant_category')}
FROM transactions LEFT JOIN banded USING (user_id) GROUP BY 1""")(
        lambda spark, sf_dir, a=attribute: R.attribute_contingency(
            Tables(spark, sf_dir).transactions, "merchant_category",
            FE.with_age_band(Tables(spark, sf_dir).demographics), a, S.MERCHANT_CATEGORIES))


@query("j05_products_with_customers", over("products", "demographics") + """
SELECT p.*, d.* EXCLUDE (user_id) FROM products p LEFT JOIN demographics d USING (user_id)""")
def detail_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.attach(t.products, t.demographics)


@query("a26_card_buyers_age_by_risk", over("products", "banded") + f"""
SELECT age_range_sturges, {_wide(S.RISK_PROFILES, 'risk_profile')} FROM products LEFT JOIN banded USING (user_id)
WHERE product_type = 'credit_card' GROUP BY 1""")
def card_buyers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.crossed_buyers(t.products, FE.with_age_band(t.demographics), "credit_card",
                            "age_range_sturges", "risk_profile", S.RISK_PROFILES)


for rows, columns, domain in (("age_range_sturges", "income_range", S.INCOME_RANGES),
                              ("age_range_sturges", "risk_profile", S.RISK_PROFILES),
                              ("income_range", "risk_profile", S.RISK_PROFILES)):
    query(f"a27_{rows}_by_{columns}_with_totals", over("banded") + f"""
SELECT coalesce({rows}, 'Total') AS {rows}, {_wide(domain, columns)}, count(*) AS "Total"
FROM banded GROUP BY ROLLUP ({rows})""")(
        lambda spark, sf_dir, r=rows, c=columns, d=domain: R.contingency(
            FE.with_age_band(Tables(spark, sf_dir).demographics), r, c, d, totals=True))


@query("a27_amount_range_by_category_with_totals", over("transactions") + f"""
SELECT coalesce(r, 'Total') AS amount_range, {_wide(S.MERCHANT_CATEGORIES, 'merchant_category')}, count(*) AS "Total"
FROM (SELECT *, {BINS} AS r FROM transactions) GROUP BY ROLLUP (r)""")
def amount_by_category(spark, sf_dir):
    edges = amount_edges(0.0, 110000.0)
    ranged = Tables(spark, sf_dir).transactions.withColumn("amount_range", cut("amount", edges, amount_labels(edges)))
    return R.contingency(ranged, "amount_range", "merchant_category", S.MERCHANT_CATEGORIES, totals=True)


@query("u01_appended_total_row", over("demographics") + """
SELECT risk_profile, count(*) AS n FROM demographics GROUP BY 1 UNION ALL SELECT 'Total', count(*) FROM demographics""")
def total_row(spark, sf_dir):
    return R.with_total_row(R.frequency(Tables(spark, sf_dir).demographics, "risk_profile"), "risk_profile", ["n"])


@query("a28_median_age_by_income", over("demographics") + """
SELECT income_range, count(*) AS n, median(age) AS mediana FROM demographics GROUP BY 1""")
def median_age(spark, sf_dir):
    return R.group_median(Tables(spark, sf_dir).demographics, "income_range", "age")


@query("a28_median_amount_by_category", over("transactions") + """
SELECT merchant_category, count(*) AS n, round(median(amount), 4) AS mediana FROM transactions GROUP BY 1""")
def median_amount(spark, sf_dir):
    return rounded(R.group_median(Tables(spark, sf_dir).transactions, "merchant_category", "amount"), 4)


@query("a29_mean_by_category", over("transactions") + """
SELECT merchant_category, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE / count(*) AS promedio FROM transactions GROUP BY 1""")
def mean_amount(spark, sf_dir):
    return R.group_mean(Tables(spark, sf_dir).transactions, ["merchant_category"], "amount", ordered=True, money=True)


@query("a29_mean_by_month_and_category", over("transactions") + """
SELECT CAST(date_trunc('month', date) AS DATE) AS mes, merchant_category,
 CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE / count(*) AS promedio FROM transactions GROUP BY 1, 2""")
def mean_by_month(spark, sf_dir):
    months = Tables(spark, sf_dir).transactions.withColumn("mes", F.trunc("date", "month"))
    return R.group_mean(months, ["mes", "merchant_category"], "amount", money=True)


TARGETED = "SELECT coalesce(insurance, FALSE) AS insurance, total / 100.0::DOUBLE / months AS gasto FROM trend LEFT JOIN flags USING (user_id)"


def _with_target(t):
    from saleslens.operators.products import ownership_flags

    owned = ownership_flags(t.products).select("user_id", "insurance")
    spend = X.transaction_features(t.transactions, REFERENCE_DATE).select(
        "user_id", "categoria_favorita_monto", F.col("monto_promedio_mensual").alias("gasto"))
    return spend.join(owned, "user_id", "left").withColumn("insurance", F.coalesce("insurance", F.lit(False)))


@query("a31_spend_by_target", over("trend", "flags", more=f"t AS ({TARGETED})") + """
SELECT insurance, round(avg(gasto), 4) AS media, round(stddev_samp(gasto), 4) AS sd, count(*) AS n,
 round(median(gasto), 4) AS mediana FROM t GROUP BY 1""")
def spend_by_target(spark, sf_dir):
    return rounded(R.grouped_stats(_with_target(Tables(spark, sf_dir)), "insurance", "gasto"), 4)


@query("w03_favourite_share_by_target", over("favour", "flags") + """
SELECT insurance, categoria_favorita_monto, n, round(n * 100.0 / sum(n) OVER (PARTITION BY insurance), 6) AS percentage
FROM (SELECT coalesce(insurance, FALSE) AS insurance, categoria_favorita_monto, count(*) AS n
 FROM favour LEFT JOIN flags USING (user_id) GROUP BY ALL)""")
def share_by_target(spark, sf_dir):
    return rounded(R.share_within(_with_target(Tables(spark, sf_dir)), "insurance", "categoria_favorita_monto"), 6)


@query("a32_buyer_profile", over("products", "banded", more="j AS (SELECT * FROM products LEFT JOIN banded USING (user_id))")
       + " UNION ALL ".join(f"SELECT product_type, '{a}' AS variable, {a} AS valor, count(*) AS n FROM j GROUP BY ALL"
                            for a in ("age_range_sturges", "risk_profile", "income_range")))
def buyers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.buyer_profile(t.products, FE.with_age_band(t.demographics))


for product in ("investment_account", "credit_card", "insurance", "savings_account", "checking_account"):
    query(f"p07_holders_of_{product}", over("products") + f"SELECT * FROM products WHERE product_type = '{product}'")(
        lambda spark, sf_dir, p=product: C.holders(Tables(spark, sf_dir).products, p))

CORRELATED = ["total_spend", "monto_promedio_transaccion", "hhi", "share_fav", "n_meses_activos", "recencia_transaccion"]


@query("a36_correlation", over("tx_v12") + " UNION ALL ".join(
    f"SELECT '{x}' AS variable_x, '{y}' AS variable_y, round(corr({x}::DOUBLE, {y}::DOUBLE), 5) AS correlacion FROM tx_v12"
    for x in CORRELATED for y in CORRELATED))
def correlation(spark, sf_dir):
    df = X.transaction_features(Tables(spark, sf_dir).transactions, REFERENCE_DATE)
    return rounded(R.correlation(df, CORRELATED), 5)


@query("a37_variance_inflation", over("basic") + """
SELECT v.variable, round(1 / (1 - power(corr(n::DOUBLE, months::DOUBLE), 2)), 4) AS vif
FROM basic, (VALUES ('total_transacciones'), ('n_meses_activos')) v(variable) GROUP BY v.variable""")
def vif(spark, sf_dir):
    df = X.transaction_features(Tables(spark, sf_dir).transactions, REFERENCE_DATE)
    return rounded(R.variance_inflation(df, ["total_transacciones", "n_meses_activos"], constant=False), 4)


_SIX = range(len(CORRELATED))


@query("a37_variance_inflation_all", over("tx_v12").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
m AS (SELECT [{', '.join(f'avg({c}::DOUBLE)' for c in CORRELATED)}] AS mean, [{', '.join(f'stddev_pop({c}::DOUBLE)' for c in CORRELATED)}] AS deviation,
 [{', '.join(f'corr({a}::DOUBLE, {b}::DOUBLE)' for a in CORRELATED for b in CORRELATED)}] AS c FROM tx_v12),
inverse AS (SELECT 0 AS k, c FROM m UNION ALL SELECT k + 1,
 [CASE WHEN x // 6 = k AND x % 6 = k THEN 1 / c[7 * k + 1] WHEN x // 6 = k THEN c[x + 1] / c[7 * k + 1]
  WHEN x % 6 = k THEN -c[x + 1] / c[7 * k + 1] ELSE c[x + 1] - c[x - x % 6 + k + 1] * c[6 * k + x % 6 + 1] / c[7 * k + 1] END
  FOR x IN range(36)] FROM inverse WHERE k < 6)
SELECT 'const' AS variable, round(1 + list_sum([c[x + 1] * mean[x // 6 + 1] / deviation[x // 6 + 1] * mean[x % 6 + 1] / deviation[x % 6 + 1]
  FOR x IN range(36)]), 4) AS vif FROM (SELECT c FROM inverse WHERE k = 6), (SELECT mean, deviation FROM m)
{' '.join(f"UNION ALL SELECT '{CORRELATED[i]}', round(c[{7 * i + 1}], 4) FROM inverse WHERE k = 6" for i in _SIX)}""")
def vif_all(spark, sf_dir):
    df = rounded(X.transaction_features(Tables(spark, sf_dir).transactions, REFERENCE_DATE), 6, "hhi", "share_fav")
    return rounded(R.variance_inflation(df, CORRELATED), 4)


# -- cleaning -----------------------------------------------------------------------


@query("p02_dropped_columns", over("demographics") + "SELECT user_id, age, income_range FROM demographics")
def dropped(spark, sf_dir):
    return C.drop_columns(Tables(spark, sf_dir).demographics, ["occupation", "risk_profile", "not_there"])


@query("p03_p04_renamed_columns", over("cat_counts") + "SELECT user_id, food_count AS food_n, travel_count AS travel_n FROM cat_counts")
def renamed(spark, sf_dir):
    df = X.transaction_features(Tables(spark, sf_dir).transactions)
    twins = df.select("user_id", F.col("food_count").alias("food.x"), F.col("travel_count").alias("travel.x"))
    return C.add_suffix(C.rename_by_pattern(twins), "_n")


@query("p05_join_without_twins", over("clients", "demographics") + """
SELECT c.id, c.user_id, c.age, d.income_range FROM clients c LEFT JOIN demographics d USING (user_id)""")
def twins(spark, sf_dir):
    t = Tables(spark, sf_dir)
    joined = C.join_without_twins(t.clients.select("id", "user_id", "age"), t.demographics, "user_id")
    return joined.select("id", "user_id", "age", "income_range")


@query("p06_imputed", over("prod_v0") + """
SELECT user_id, coalesce(segundo_producto, 'none') AS segundo_producto,
 coalesce(fecha_segundo_producto, DATE '1900-01-01') AS fecha_segundo_producto,
 CAST(coalesce(dias_entre_productos, 0) AS INTEGER) AS dias_entre_productos FROM prod_v0""")
def imputed(spark, sf_dir):
    from saleslens.operators.products import product_features

    df = product_features(Tables(spark, sf_dir).products, REFERENCE_DATE, "null")
    return C.impute_missing_second(df).select(
        "user_id", "segundo_producto", "fecha_segundo_producto", "dias_entre_productos")


@query("p12_date_like_columns", " UNION ALL ".join(
    f"SELECT '{name}' AS columna FROM orders HAVING count(*) = count(TRY_CAST({value} AS TIMESTAMP))"
    for name, value in (("fecha", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"), ("o_orderpriority", "o_orderpriority"),
                        ("o_orderstatus", "o_orderstatus"))))
def date_like(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").cast("string").alias("fecha"), "o_orderpriority", "o_orderstatus")
    return spark.createDataFrame([(c,) for c in C.date_like_columns(orders)], "columna string")


@query("p13_coerced_dates", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END AS fecha FROM orders")
def coerced(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") == "F", "not a date").otherwise(F.col("o_orderdate").cast("string"))
    return C.coerce_dates(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("fecha")), ["fecha"])


@query("p14_continuous_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS columna FROM lineitem HAVING count(DISTINCT {c}) > 10"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def continuous(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return spark.createDataFrame([(c,) for c in C.continuous_columns(lines)], "columna string")


@query("p15_aligned_columns", over("demographics") + "SELECT user_id, CAST(0 AS INTEGER) AS hhi, age FROM demographics")
def aligned(spark, sf_dir):
    return C.align_columns(Tables(spark, sf_dir).demographics, ["hhi", "age"], keys=["user_id"])


@query("p15_schema_differences", """
SELECT * FROM (VALUES ('missing', 'hhi'), ('extra', 'income_range'), ('extra', 'risk_profile'), ('extra', 'occupation')) v(kind, columna)""")
def differences(spark, sf_dir):
    found = C.schema_differences(Tables(spark, sf_dir).demographics, ["user_id", "hhi", "age"])
    return spark.createDataFrame([(k, c) for k, names in found.items() for c in names], "kind string, columna string")


@query("p17_as_double", over("clients") + "SELECT user_id, id::DOUBLE AS id, age::DOUBLE AS age FROM clients")
def doubles(spark, sf_dir):
    return C.to_double(Tables(spark, sf_dir).clients.select("user_id", "id", "age"))


# -- encoders -------------------------------------------------------------------------


@query("f08_epochs", over("pair") + """
SELECT user_id, CAST(epoch(fecha_primer_producto) AS BIGINT) AS s, CAST(epoch(fecha_primer_producto) AS BIGINT) * 1000000000 AS ns FROM pair""")
def epochs(spark, sf_dir):
    from saleslens.operators.products import first_second

    return first_second(Tables(spark, sf_dir).products).select(
        "user_id", epoch("fecha_primer_producto").alias("s"), epoch("fecha_primer_producto", "ns").alias("ns"))


@query("f07_f10_truncated_dates", over("contacts") + """
SELECT id, CAST(date_trunc('day', contacted_at) AS DATE) AS dia, CAST(date_trunc('month', contacted_at) AS DATE) AS mes FROM contacts""")
def truncated(spark, sf_dir):
    from saleslens.functions import month_of

    return Tables(spark, sf_dir).contacts.select(
        "id", F.to_date("contacted_at").alias("dia"), month_of("contacted_at").alias("mes"))


@query("f09_log1p", over("favour") + "SELECT user_id, round(ln(1 + total_spend_fav), 6) AS total_spend_fav FROM favour")
def logs(spark, sf_dir):
    df = X.transaction_features(Tables(spark, sf_dir).transactions).select("user_id", "total_spend_fav")
    return rounded(E.log1p(df, ["total_spend_fav"]), 6)


@query("f11_label_codes", over("banded") + "SELECT user_id, " + ", ".join(
    coded_sql(c) for c in ("income_range", "risk_profile", "occupation", "age_range_sturges")) + " FROM banded")
def codes(spark, sf_dir):
    columns = ["income_range", "risk_profile", "occupation", "age_range_sturges"]
    df = FE.with_age_band(Tables(spark, sf_dir).demographics).select("user_id", *columns)
    return E.LabelEncoder.fit(df, columns).transform(df)


@query("f11_label_table", "SELECT c_name AS label, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS code FROM customer")
def long_dictionary(spark, sf_dir):
    return E.label_table(table(spark, sf_dir, "customer"), "c_name")


@query("f12_one_hot", over("demographics") + """
SELECT user_id, income_range = '150k+' AS "income_range_150k+", income_range = '30k-50k' AS "income_range_30k-50k",
 income_range = '50k-100k' AS "income_range_50k-100k", risk_profile = 'conservative' AS risk_profile_conservative,
 risk_profile = 'moderate' AS risk_profile_moderate FROM demographics""")
def one_hot(spark, sf_dir):
    df = Tables(spark, sf_dir).demographics.select("user_id", "income_range", "risk_profile")
    return E.OneHot.fit(df, ["income_range", "risk_profile"]).transform(df)


@query("f13_standard_scale", over("clients") + f"SELECT id, {scaled_sql('age')}, {scaled_sql('probability')} FROM clients")
def scaled(spark, sf_dir):
    df = Tables(spark, sf_dir).clients.select("id", "age", "probability")
    return rounded(E.StandardScaler.fit(df, ["age", "probability"]).transform(df), 6)


@query("f14_winsorized", over("transactions", more="""
q AS (SELECT quantile_cont(amount, 0.01) AS lo, quantile_cont(amount, 0.99) AS hi FROM transactions)""") + """
SELECT transaction_id, round(greatest(least(amount, hi), lo), 4) AS amount FROM transactions, q""")
def winsorized(spark, sf_dir):
    df = Tables(spark, sf_dir).transactions.select("transaction_id", "amount")
    return rounded(E.Winsorizer.fit(df, ["amount"]).transform(df), 4)


@query("f14_quantiles_in_many_buckets", over("transactions") + """
SELECT merchant_category, round(quantile_cont(amount, 0.01), 4) AS p01, round(quantile_cont(amount, 0.99), 4) AS p99
FROM transactions GROUP BY 1""")
def many_buckets(spark, sf_dir):
    df = Tables(spark, sf_dir).transactions
    return rounded(exact_quantiles(df, "amount", {"p01": 0.01, "p99": 0.99}, ["merchant_category"], rows_per_bucket=1000), 4)


@query("f22_booleans", over("scored") + "SELECT id, label = 1 AS label FROM scored")
def booleans(spark, sf_dir):
    return E.to_boolean(Tables(spark, sf_dir).scored.select("id", "label"), ["label"])


@query("f24_quarter_text", over("products") + """
SELECT user_id, 'T' || quarter(contract_date) AS trimestre FROM products""")
def quarters(spark, sf_dir):
    return Tables(spark, sf_dir).products.select("user_id", quarter_label("contract_date", with_year=False).alias("trimestre"))


@query("f25_split_names", over("products") + """
SELECT user_id, string_agg(DISTINCT product_type, ' + ' ORDER BY product_type) AS combinacion,
 count(DISTINCT product_type) AS partes FROM products GROUP BY user_id""")
def split_names(spark, sf_dir):
    from saleslens.operators.products import combinations

    df = combinations(Tables(spark, sf_dir).products)
    return df.withColumn("partes", F.size(F.split("combinacion", r" \+ ")).cast("bigint"))


# -- design matrices ----------------------------------------------------------------------

MATRIX = f"""{JOINED_V0}, {CLEANED}, general AS MATERIALIZED (SELECT c.* EXCLUDE (variacion_mensual_promedio_pct),
 pct_skip AS variacion_mensual_promedio_pct FROM cleaned c LEFT JOIN trend r USING (user_id))"""
TS = ", ".join(f"CAST(epoch({c}) AS BIGINT) * 1000000000 AS {c}_ts" for c in FE.DATES)
BOTH_FLAGS = "checking_account, savings_account, credit_card, insurance, investment"
PLAIN = ["age", "dias_entre_productos", "antiguedad_cliente", "numero_productos"]


def general(spark, sf_dir):
    return FE.general_features(FE.cleaned_features(raw(spark, sf_dir)))


@query("c06_forest_matrix", over(*ALL_V0, more=MATRIX) + "SELECT user_id, " + ", ".join([
    *PLAIN, *[f"{c}_count" for c in S.MERCHANT_CATEGORIES], *[coded_sql(c) for c in FE.ENCODED], BOTH_FLAGS,
    "n_meses_activos", "recencia_transaccion", "transacciones_promedio_mensual", "variacion_mensual_promedio",
    "round(variacion_mensual_promedio_pct, 6) AS variacion_mensual_promedio_pct",
    "round(ln(1 + total_spend_fav), 6) AS total_spend_fav", TS]) + " FROM general")
def forest(spark, sf_dir):
    from saleslens.plans.matrices import forest_matrix

    df = forest_matrix(general(spark, sf_dir))
    return rounded(df, 6, "variacion_mensual_promedio_pct", "total_spend_fav")


CLIPPED = """clipped AS MATERIALIZED (SELECT * REPLACE (
 CASE WHEN variacion_mensual_promedio IS NOT NULL THEN greatest(least(variacion_mensual_promedio,
  (SELECT quantile_cont(variacion_mensual_promedio, 0.99) FROM general)),
  (SELECT quantile_cont(variacion_mensual_promedio, 0.01) FROM general)) END AS variacion_mensual_promedio,
 ln(1 + total_spend_fav) AS total_spend_fav, ln(1 + variacion_mensual_promedio_pct) AS variacion_mensual_promedio_pct) FROM general)"""


@query("c07_boosted_matrix", over(*ALL_V0, more=f"{MATRIX}, {CLIPPED}") + "SELECT user_id, " + ", ".join([
    *[scaled_sql(c) for c in [*PLAIN, *[f"{c}_count" for c in S.MERCHANT_CATEGORIES], "recencia_transaccion"]],
    *[coded_sql(c) for c in FE.ENCODED], BOTH_FLAGS, "n_meses_activos",
    "transacciones_promedio_mensual", "round(variacion_mensual_promedio, 8) AS variacion_mensual_promedio",
    "round(variacion_mensual_promedio_pct, 6) AS variacion_mensual_promedio_pct",
    "round(total_spend_fav, 6) AS total_spend_fav", TS]) + " FROM clipped")
def boosted(spark, sf_dir):
    from saleslens.plans.matrices import boosted_matrix

    df = boosted_matrix(general(spark, sf_dir))
    scaled = [c for c, t in df.dtypes if t == "double"
              and c not in ("transacciones_promedio_mensual", "variacion_mensual_promedio")]
    return rounded(rounded(df, 6, *scaled), 8, "variacion_mensual_promedio")


HOT = {"income_range": sorted(S.INCOME_RANGES)[1:], "risk_profile": sorted(S.RISK_PROFILES)[1:],
       "age_range_sturges": S.AGE_LABELS[1:]}


@query("c05_logistic_matrix", over(*ALL_V0, more=f"{MATRIX}, {CLIPPED}") + "SELECT user_id, " + ", ".join([
    *[scaled_sql(c) for c in [*PLAIN, *[f"{c}_count" for c in S.MERCHANT_CATEGORIES], "total_spend_fav",
                            "transacciones_promedio_mensual", "variacion_mensual_promedio",
                            "variacion_mensual_promedio_pct", "n_meses_activos", "recencia_transaccion"]],
    *[f"{c} = '{v}' AS \"{c}_{v}\"" for c, domain in HOT.items() for v in domain], BOTH_FLAGS, TS]) + " FROM clipped")
def logistic(spark, sf_dir):
    from saleslens.plans.matrices import logistic_matrix

    df = logistic_matrix(general(spark, sf_dir))
    open_ended = ("occupation_", "primer_producto_", "segundo_producto_", "combinacion_productos_", "categoria_favorita")
    kept = [c for c in df.columns if not c.startswith(open_ended)]
    return rounded(df.select(*[F.col(f"`{c}`") for c in kept]), 6)


@query("s04_features_without_target", over("banded", "prod_v12") + """
SELECT user_id, age, numero_productos FROM banded LEFT JOIN prod_v12 USING (user_id)""")
def split(spark, sf_dir):
    from saleslens.operators.products import product_features

    t = Tables(spark, sf_dir)
    df = t.demographics.join(product_features(t.products, REFERENCE_DATE), "user_id", "left")
    x, y = IO.split_target(df)
    return x.join(y, "user_id").select("user_id", "age", "numero_productos")


@query("s04_written_split", over("banded", "prod_v12") + """
SELECT user_id, age, numero_productos, insurance FROM banded LEFT JOIN prod_v12 USING (user_id)""")
def written_split(spark, sf_dir):
    """Features and target as they are in the two folders written."""
    from saleslens.operators.products import product_features
    from saleslens.session import durable, scratch

    t, folder = Tables(spark, sf_dir), scratch(spark)
    df = t.demographics.join(product_features(t.products, REFERENCE_DATE), "user_id", "left")
    IO.write_split(df, folder)
    x, y = spark.read.parquet(f"{folder}/X"), spark.read.parquet(f"{folder}/y")
    return x.drop(*[c for c in x.columns if c not in ("user_id", "age", "numero_productos")]).join(y, "user_id")


# -- sources -------------------------------------------------------------------------------


@query("s02_tables_in_memory", over("products") + "SELECT * FROM products")
def in_memory(spark, sf_dir):
    texts = Tables(spark, sf_dir).products.withColumn("contract_date", F.col("contract_date").cast("string"))
    return IO.coerced(texts, S.PRODUCTS)


@query("s11_empty_tables", "SELECT 'products' AS tabla WHERE (SELECT count(*) FROM orders) = 0")
def empties(spark, sf_dir):
    t = Tables(spark, sf_dir)
    names = IO.empty_tables({"demographics": t.demographics, "products": t.products, "transactions": t.transactions})
    return spark.createDataFrame([(n,) for n in names], "tabla string")


@query("s11_empty_tables_found", "SELECT 'transactions' AS tabla WHERE NOT EXISTS (SELECT * FROM lineitem WHERE l_shipdate < DATE '1900-01-01')")
def empties_found(spark, sf_dir):
    t = Tables(spark, sf_dir)
    names = IO.empty_tables({"demographics": t.demographics, "products": t.products,
                             "transactions": t.transactions.where("date < DATE '1900-01-01'")})
    return spark.createDataFrame([(n,) for n in names], "tabla string")


@query("s12_table_audit", over("clients", "contacts", "products", "transactions") + """
SELECT 'demographics' AS tabla, TRUE AS presente, (SELECT count(*) FROM clients) AS filas
UNION ALL SELECT 'prediction_results', FALSE, NULL UNION ALL SELECT 'contacts', TRUE, (SELECT count(*) FROM contacts)
UNION ALL SELECT 'contact_history', FALSE, NULL UNION ALL SELECT 'products', TRUE, (SELECT count(*) FROM products)
UNION ALL SELECT 'transactions', TRUE, (SELECT count(*) FROM transactions) UNION ALL SELECT 'goals', FALSE, NULL""")
def audit(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return IO.audit_frames(spark, {"demographics": t.clients, "contacts": t.contacts, "products": t.products,
                                   "transactions": t.transactions})


@query("s01_s03_csv_round_trip", over("demographics") + "SELECT * FROM demographics")
def round_trip(spark, sf_dir):
    place = f"{scratch(spark)}/demographics.csv"
    IO.write_csv(Tables(spark, sf_dir).demographics, place)
    return IO.read_csv(spark, place, S.DEMOGRAPHICS)


@query("s05_csv_without_columns", over("products") + "SELECT user_id, product_type FROM products")
def without_columns(spark, sf_dir):
    place = f"{scratch(spark)}/products.csv"
    IO.write_csv(Tables(spark, sf_dir).products, place)
    return IO.read_csv_without(spark, place, S.PRODUCTS, ["contract_date", "not_there"])


@query("s13_schema_report", """
SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
 ELSE 'string' END AS data_type, "null" AS is_nullable FROM (DESCRIBE customer)""")
def schema(spark, sf_dir):
    return IO.schema_report(table(spark, sf_dir, "customer"))


@query("o05_first_rows", over("demographics") + """
SELECT * FROM demographics ORDER BY user_id LIMIT 5""")
def first_rows(spark, sf_dir):
    return IO.first_rows(Tables(spark, sf_dir).demographics.orderBy("user_id"), 5)


@query("o03_multi_key_sort", over("numbered") + "SELECT user_id, contract_date, product_type, rank FROM numbered")
def sorted_products(spark, sf_dir):
    from saleslens.operators.products import running_number

    df = running_number(Tables(spark, sf_dir).products)
    return df.select("user_id", "contract_date", "product_type", "rank")
