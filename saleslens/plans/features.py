"""Feature tables: raw, cleaned, reduced, and the scaled and encoded default."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from saleslens import schemas as S
from saleslens.functions import age_band, epoch
from saleslens.operators.cleaning import drop_columns, impute_missing_second
from saleslens.operators.encode import LabelEncoder, StandardScaler, log1p
from saleslens.operators.products import product_features
from saleslens.operators.transactions import transaction_features
from saleslens.session import durable

# Column lists of the default feature table.
DROPPED = [
    "total_spend", "monto_promedio_transaccion", "monto_promedio_mensual", "hhi", "share_fav",
    "total_transacciones", "categoria_favorita", "transacciones_promedio_mensual",
]
DATES = ["fecha_primer_producto", "fecha_segundo_producto", "mes_mas_compras", "mes_mayor_monto"]
SCALED = [
    "age", "dias_entre_productos", "antiguedad_cliente", "numero_productos",
    "recencia_transaccion", "variacion_mensual_promedio", "variacion_mensual_promedio_pct",
]
ENCODED = [
    "income_range", "risk_profile", "occupation", "age_range_sturges", "primer_producto",
    "segundo_producto", "combinacion_productos", "categoria_favorita_monto",
]
IMPUTED_ZERO = ["dias_entre_productos", "variacion_mensual_promedio", "variacion_mensual_promedio_pct"]
LEAKY = ["numero_productos", "segundo_producto", "primer_producto", "dias_entre_productos"]
# The combination spells the target out, so no matrix may be trained with it either.
LEAKY_IN_MATRIX = [*LEAKY, "combinacion_productos"]
OUTPUT = [
    "user_id", "age", "income_range", "risk_profile", "occupation", "age_range_sturges",
    "primer_producto", "segundo_producto",
    "checking_account", "credit_card", "insurance", "investment", "savings_account",
    "dias_entre_productos", "antiguedad_cliente", "numero_productos",
    "n_meses_activos", "recencia_transaccion",
    *[f"{c}_count" for c in S.MERCHANT_CATEGORIES],
    "categoria_favorita_monto", "total_spend_fav",
    "variacion_mensual_promedio", "variacion_mensual_promedio_pct",
    "fecha_primer_producto_ts", "mes_mas_compras_ts", "mes_mayor_monto_ts",
]


def with_age_band(demographics: DataFrame) -> DataFrame:
    return demographics.withColumn("age_range_sturges", age_band("age"))


def joined(demographics: DataFrame, product_side: DataFrame, transaction_side: DataFrame) -> DataFrame:
    """Every customer of the demographics with what is known of products and transactions."""
    return (
        with_age_band(demographics)
        .join(product_side, "user_id", "left")
        .join(transaction_side, "user_id", "left")
    )


def raw_features(demographics: DataFrame, products: DataFrame, transactions: DataFrame,
                 reference_date: str = S.REFERENCE_DATE, second_variant: str = "null",
                 change_variant: str = "skip_first", ties: str = "joined",
                 listed_combos: bool = True) -> DataFrame:
    """Unscaled table of the early versions: tied favourites joined, first month skipped."""
    return joined(
        demographics,
        product_features(products, reference_date, second_variant, listed_combos),
        transaction_features(transactions, reference_date, change_variant, ties),
    )


def cleaned_features(raw: DataFrame) -> DataFrame:
    return impute_missing_second(raw)


def general_features(cleaned: DataFrame) -> DataFrame:
    """The reduced table: without collinear columns and without the favourite by count."""
    return drop_columns(cleaned, [*S.COLLINEAR_COLUMNS, "categoria_favorita"])


def default_base(demographics: DataFrame, products: DataFrame, transactions: DataFrame,
                 reference_date: str = S.REFERENCE_DATE, epoch_unit: str = "s",
                 second_variant: str = "v12", change_variant: str = "v12",
                 ties: str = "first", listed_combos: bool = False) -> DataFrame:
    """The default table before anything is fitted: joined, reduced, dates as numbers, imputed."""
    df = joined(
        demographics,
        product_features(products, reference_date, second_variant, listed_combos),
        transaction_features(transactions, reference_date, change_variant, ties),
    )
    df = drop_columns(df, DROPPED)
    df = df.withColumns({f"{c}_ts": epoch(c, epoch_unit) for c in DATES}).drop(*DATES, "fecha_segundo_producto_ts")
    return df.fillna(0, IMPUTED_ZERO)


@dataclass(frozen=True)
class FeatureModel:
    """Scaler moments and label dictionaries learned from one table, usable on another."""

    scaler: StandardScaler
    labels: LabelEncoder

    @classmethod
    def fit(cls, base: DataFrame, missing: str = "nan") -> FeatureModel:
        encoded = [c for c in ENCODED if c != "combinacion_productos" and c in base.columns]
        scaled = [c for c in SCALED if c in base.columns]
        return cls(StandardScaler.fit(base, scaled), LabelEncoder.fit(base, encoded, missing))

    def transform(self, base: DataFrame) -> DataFrame:
        out = self.labels.transform(log1p(self.scaler.transform(base), ["total_spend_fav"]))
        return out.select(*[c for c in OUTPUT if c in out.columns])


def generate_features(demographics: DataFrame, products: DataFrame, transactions: DataFrame,
                      reference_date: str = S.REFERENCE_DATE, exclude_leaky: bool = False,
                      missing: str = "nan", model: FeatureModel | None = None,
                      **options: object) -> DataFrame:
    """One scaled and encoded row per customer.

    Moments and dictionaries are fitted on the same table unless a fitted ``model`` is given. The
    unscaled table is written once to the checkpoint folder, so that fitting and transforming do
    not compute the aggregations again. ``options`` are those of ``default_base``.

    The product columns in ``LEAKY`` come from the same contracts as the target; ``exclude_leaky``
    leaves them out.
    """
    base = default_base(demographics, products, transactions, reference_date, **options)
    if model is None:
        base = durable(base)
        model = FeatureModel.fit(base, missing)
    out = model.transform(base)
    return drop_columns(out, LEAKY) if exclude_leaky else out
