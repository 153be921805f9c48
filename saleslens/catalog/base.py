"""Registry of queries with the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.sources import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is there twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Round irrational results, whose last bits depend on the order of addition."""
    names = columns or [f for f, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})


class Tables:
    """Model tables of one folder of test data."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def demographics(self) -> DataFrame:
        return A.demographics(self.spark, self.sf_dir)

    @property
    def products(self) -> DataFrame:
        return A.products(self.spark, self.sf_dir)

    @property
    def transactions(self) -> DataFrame:
        return A.transactions(self.spark, self.sf_dir)

    @property
    def clients(self) -> DataFrame:
        return A.clients(self.spark, self.sf_dir)

    @property
    def contacts(self) -> DataFrame:
        return A.contacts(self.spark, self.sf_dir)

    @property
    def changes(self) -> DataFrame:
        return A.status_changes(self.spark, self.sf_dir)

    @property
    def scored(self) -> DataFrame:
        return A.scored_labels(self.spark, self.sf_dir)


# ---------------------------------------------------------------------------
# The same model tables as SQL common table expressions.
# ---------------------------------------------------------------------------
_INCOME = """CASE WHEN c_acctbal < 2000 THEN '30k-50k' WHEN c_acctbal < 5000 THEN '50k-100k'
  WHEN c_acctbal < 8000 THEN '100k-150k' ELSE '150k+' END"""
_RISK = "CASE WHEN c_nationkey % 3 = 0 THEN 'conservative' WHEN c_nationkey % 3 = 1 THEN 'moderate' ELSE 'aggressive' END"
BAND = """CASE WHEN age < 18 THEN NULL WHEN age <= 24.5 THEN '18–24' WHEN age <= 31 THEN '25–31'
  WHEN age <= 37.5 THEN '32–38' WHEN age <= 44 THEN '39–45' WHEN age <= 50.5 THEN '46–52'
  WHEN age <= 57 THEN '53–59' WHEN age <= 63.5 THEN '60–66' WHEN age <= 70 THEN '67–70' END"""

CTE = {
    "demographics": f"""SELECT CAST(c_custkey AS VARCHAR) AS user_id, CAST(18 + c_custkey % 53 AS INTEGER) AS age,
  {_INCOME} AS income_range, {_RISK} AS risk_profile, c_mktsegment AS occupation FROM customer""",
    "banded": f"SELECT *, {BAND} AS age_range_sturges FROM demographics",
    "products": """SELECT CAST(o_custkey AS VARCHAR) AS user_id, CASE o_orderpriority
  WHEN '1-URGENT' THEN 'checking_account' WHEN '2-HIGH' THEN 'insurance' WHEN '3-MEDIUM' THEN 'savings_account'
  WHEN '4-NOT SPECIFIED' THEN 'credit_card' WHEN '5-LOW' THEN 'investment_account' END AS product_type,
  CAST(o_orderdate AS DATE) AS contract_date FROM orders""",
    "recoded": """SELECT user_id, CASE WHEN product_type = 'investment_account' THEN 'investment' ELSE product_type END
  AS product_type, contract_date FROM products""",
    "transactions": """SELECT l_orderkey || '-' || l_linenumber AS transaction_id, CAST(o_custkey AS VARCHAR) AS user_id,
  CAST(l_shipdate AS DATE) AS date, l_extendedprice AS amount, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
  CASE l_suppkey % 7 WHEN 0 THEN 'entertainment' WHEN 1 THEN 'food' WHEN 2 THEN 'health' WHEN 3 THEN 'shopping'
  WHEN 4 THEN 'supermarket' WHEN 5 THEN 'transport' WHEN 6 THEN 'travel' END AS merchant_category
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "clients": f"""SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS user_id, CAST(18 + c_custkey % 53 AS INTEGER) AS age,
  {_INCOME} AS income_range, {_RISK} AS risk_profile, c_mktsegment AS occupation,
  CASE WHEN c_custkey % 5 > 0 THEN 's' || CAST(c_custkey % 5 AS VARCHAR) END AS segment,
  CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'contacted' WHEN 2 THEN 'interested' ELSE 'converted' END AS status,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, (c_acctbal + 1000) / 11000)) AS probability FROM customer""",
    "contacts": """SELECT event_id AS id, user_id AS client_id, ts AS contacted_at, CASE event_type
  WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'not_interested'
  WHEN 'error' THEN 'unreachable' END AS outcome FROM events""",
    "changes": """SELECT user_id AS client_id, CASE event_type WHEN 'purchase' THEN 'converted' WHEN 'view' THEN 'contacted'
  WHEN 'click' THEN 'interested' WHEN 'error' THEN 'lost' WHEN 'signup' THEN 'archived' END AS new_status,
  ts AS changed_at FROM events""",
    "flags": """SELECT user_id, bool_or(product_type = 'checking_account') AS checking_account,
  bool_or(product_type = 'savings_account') AS savings_account, bool_or(product_type = 'credit_card') AS credit_card,
  bool_or(product_type = 'insurance') AS insurance, bool_or(product_type = 'investment') AS investment
  FROM recoded GROUP BY user_id""",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY contract_date, product_type) AS rank
  FROM recoded""",
    "pair": """SELECT user_id, max(CASE WHEN rank = 1 THEN product_type END) AS primer_producto,
  max(CASE WHEN rank = 1 THEN contract_date END) AS fecha_primer_producto,
  max(CASE WHEN rank = 2 THEN product_type END) AS segundo_producto,
  max(CASE WHEN rank = 2 THEN contract_date END) AS fecha_segundo_producto FROM numbered GROUP BY user_id""",
    "scored": """SELECT id, probability AS score, CAST(coalesce(insurance, FALSE) AS INTEGER) AS label
  FROM clients LEFT JOIN flags USING (user_id)""",
    "monthly": """SELECT user_id, CAST(date_trunc('month', date) AS DATE) AS mes, CAST(sum(cents) AS BIGINT) AS total,
  count(*) AS n FROM transactions GROUP BY ALL""",
    "lagged": "SELECT *, lag(total) OVER (PARTITION BY user_id ORDER BY mes) AS previous FROM monthly",
    "peaks": """SELECT user_id, first(mes ORDER BY n DESC, mes) AS mes_mas_compras,
  first(mes ORDER BY total DESC, mes) AS mes_mayor_monto FROM monthly GROUP BY user_id""",
    "cats": """SELECT user_id, merchant_category, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n
  FROM transactions GROUP BY ALL""",
    "basic": """SELECT user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, max(date) AS last,
  count(DISTINCT date_trunc('month', date)) AS months FROM transactions GROUP BY user_id""",
    "cat_counts": "SELECT user_id, " + ", ".join(
        f"count(*) FILTER (merchant_category = '{c}') AS {c}_count" for c in
        ("entertainment", "food", "health", "shopping", "supermarket", "transport", "travel"))
    + " FROM transactions GROUP BY user_id",
    "favour": """SELECT user_id, first(merchant_category ORDER BY n DESC, merchant_category) AS categoria_favorita,
  first(merchant_category ORDER BY total DESC, merchant_category) AS categoria_favorita_monto,
  max(total) / 100.0::DOUBLE AS total_spend_fav FROM cats GROUP BY user_id""",
    "tied": """SELECT user_id, (SELECT string_agg(merchant_category, ' + ' ORDER BY merchant_category) FROM cats c
    WHERE c.user_id = m.user_id AND c.n = m.top_n) AS categoria_favorita,
  (SELECT string_agg(merchant_category, ' + ' ORDER BY merchant_category) FROM cats c
    WHERE c.user_id = m.user_id AND c.total = m.top) AS categoria_favorita_monto,
  (SELECT CAST(sum(total) AS BIGINT) FROM cats c WHERE c.user_id = m.user_id AND c.total = m.top) / 100.0::DOUBLE AS total_spend_fav
  FROM (SELECT user_id, max(n) AS top_n, max(total) AS top FROM cats GROUP BY user_id) m""",
    "conc": """SELECT user_id, sum(power(c.total::DOUBLE / b.total, 2)) AS hhi
  FROM cats c JOIN basic b USING (user_id) GROUP BY user_id""",
    "trend": """SELECT user_id, count(*) AS months, CAST(sum(total) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS n,
  CAST(coalesce(sum(total - previous), 0) AS BIGINT) AS change,
  sum(CASE WHEN previous IS NULL THEN 0.0 ELSE total::DOUBLE / previous - 1 END) / count(*) AS pct_all,
  avg(total::DOUBLE / previous - 1) AS pct_skip FROM lagged GROUP BY user_id""",
    "prod_side": """SELECT *, CAST(checking_account AS INTEGER) + CAST(savings_account AS INTEGER)
  + CAST(credit_card AS INTEGER) + CAST(insurance AS INTEGER) + CAST(investment AS INTEGER) AS numero_productos,
  concat_ws(' + ', CASE WHEN checking_account THEN 'checking_account' END, CASE WHEN credit_card THEN 'credit_card' END,
   CASE WHEN insurance THEN 'insurance' END, CASE WHEN investment THEN 'investment' END,
   CASE WHEN savings_account THEN 'savings_account' END) AS all_names,
  date_diff('day', fecha_primer_producto, DATE '2002-01-01') AS antiguedad_cliente
  FROM pair JOIN flags USING (user_id)""",
    "prod_v12": """SELECT * EXCLUDE (all_names), CASE WHEN numero_productos = 0 THEN 'sin_productos'
   WHEN numero_productos <= 2 THEN all_names ELSE 'multi_producto' END AS combinacion_productos,
  date_diff('day', fecha_primer_producto, coalesce(fecha_segundo_producto, DATE '1900-01-01')) AS dias_entre_productos
  FROM prod_side""",
    "prod_v0": """SELECT * EXCLUDE (all_names), CASE WHEN all_names IN ('checking_account', 'savings_account',
   'credit_card + savings_account', 'insurance + savings_account', 'checking_account + insurance',
   'checking_account + credit_card', 'checking_account + investment', 'investment + savings_account')
   THEN all_names ELSE 'OTRA_COMBINACION' END AS combinacion_productos,
  date_diff('day', fecha_primer_producto, fecha_segundo_producto) AS dias_entre_productos FROM prod_side""",
}
_TX = """SELECT user_id, b.n AS total_transacciones, b.total / 100.0::DOUBLE / b.n AS monto_promedio_transaccion,
  b.total / 100.0::DOUBLE AS total_spend, b.months AS n_meses_activos,
  CAST(date_diff('day', b.last, DATE '2002-01-01') AS INTEGER) AS recencia_transaccion,
  entertainment_count, food_count, health_count, shopping_count, supermarket_count, transport_count, travel_count,
  categoria_favorita, categoria_favorita_monto, total_spend_fav, round(hhi, 6) AS hhi,
  round(total_spend_fav / (b.total / 100.0::DOUBLE), 6) AS share_fav, mes_mas_compras, mes_mayor_monto,
  t.total / 100.0::DOUBLE / t.months AS monto_promedio_mensual, t.n::DOUBLE / t.months AS transacciones_promedio_mensual,
  {change} AS variacion_mensual_promedio, round({pct}, 6) AS variacion_mensual_promedio_pct
  FROM basic b JOIN cat_counts USING (user_id) JOIN {fav} USING (user_id) JOIN conc USING (user_id)
  JOIN peaks USING (user_id) JOIN trend t USING (user_id)"""
CTE["tx_v12"] = _TX.format(change="t.change / 100.0::DOUBLE / t.months", pct="pct_all", fav="favour")
CTE["tx_v0"] = _TX.format(
    change="CASE WHEN t.months > 1 THEN t.change / 100.0::DOUBLE / (t.months - 1) END", pct="pct_skip", fav="tied")

_NEEDS = {
    "banded": ["demographics"], "recoded": ["products"], "flags": ["recoded"], "numbered": ["recoded"],
    "pair": ["numbered"], "scored": ["clients", "flags"], "monthly": ["transactions"], "lagged": ["monthly"],
    "peaks": ["monthly"], "cats": ["transactions"], "basic": ["transactions"], "cat_counts": ["transactions"],
    "favour": ["cats"], "tied": ["cats"], "conc": ["cats", "basic"], "trend": ["lagged"],
    "prod_side": ["pair", "flags"], "prod_v12": ["prod_side"], "prod_v0": ["prod_side"],
    "tx_v12": ["basic", "cat_counts", "favour", "conc", "peaks", "trend"],
    "tx_v0": ["basic", "cat_counts", "tied", "conc", "peaks", "trend"],
}


def over(*names: str, more: str = "") -> str:
    """``WITH`` clause of the named tables and those they need; ``more`` adds further ones."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({CTE[n]})" for n in ordered]
    return "WITH " + ",\n".join(parts + ([more] if more else [])) + "\n"
