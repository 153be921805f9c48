"""Design matrices for the three kinds of model, from the general feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from saleslens import schemas as S
from saleslens.functions import epoch
from saleslens.operators.cleaning import drop_columns
from saleslens.operators.encode import LabelEncoder, OneHot, StandardScaler, Winsorizer, log1p, to_boolean
from saleslens.session import durable

# Which columns each matrix transforms.
DATE_COLUMNS = ["fecha_primer_producto", "fecha_segundo_producto", "mes_mas_compras", "mes_mayor_monto"]
BOOLEANS = ["checking_account", "savings_account", "credit_card", "investment"]
CATEGORICAL = [
    "income_range", "risk_profile", "occupation", "age_range_sturges", "primer_producto",
    "segundo_producto", "combinacion_productos", "categoria_favorita_monto",
]
CHANGE, CHANGE_PCT = "variacion_mensual_promedio", "variacion_mensual_promedio_pct"
TREE_SCALED = [
    "age", "dias_entre_productos", "antiguedad_cliente", "numero_productos",
    "entertainment_count", "food_count", "health_count", "shopping_count",
    "supermarket_count", "transport_count", "travel_count",
]
LOGISTIC_SCALED = [
    *TREE_SCALED, "total_spend_fav", "transacciones_promedio_mensual", CHANGE, CHANGE_PCT,
    "n_meses_activos", "recencia_transaccion",
]


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def _prepared(general: DataFrame, logged: Sequence[str]) -> DataFrame:
    """Dates to nanoseconds, logs and booleans, computed once for all the fits that follow."""
    dates = _present(general, DATE_COLUMNS)
    df = general.withColumns({f"{c}_ts": epoch(c, "ns") for c in dates}).drop(*dates)
    return durable(to_boolean(log1p(drop_columns(df, S.COLLINEAR_COLUMNS), logged), BOOLEANS))


def _winsorized(df: DataFrame) -> DataFrame:
    return Winsorizer.fit(df, _present(df, [CHANGE])).transform(df)


def _scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return StandardScaler.fit(df, _present(df, columns)).transform(df)


def _labelled(df: DataFrame) -> DataFrame:
    return LabelEncoder.fit(df, _present(df, CATEGORICAL)).transform(df)


def logistic_matrix(general: DataFrame) -> DataFrame:
    """Logs, winsorized change, 17 scaled columns, one-hot categories; key and target kept."""
    df = _winsorized(_prepared(general, ["total_spend_fav", CHANGE_PCT]))
    df = _scaled(df, LOGISTIC_SCALED)
    return OneHot.fit(df, _present(df, CATEGORICAL)).transform(df)


def forest_matrix(general: DataFrame) -> DataFrame:
    """Log of the favourite spend and label codes; nothing is scaled."""
    return _labelled(_prepared(general, ["total_spend_fav"]))


def boosted_matrix(general: DataFrame) -> DataFrame:
    """Logs, winsorized change, eleven columns and recency scaled, label codes."""
    df = _winsorized(_prepared(general, ["total_spend_fav", CHANGE_PCT]))
    return _labelled(_scaled(df, [*TREE_SCALED, "recencia_transaccion"]))
