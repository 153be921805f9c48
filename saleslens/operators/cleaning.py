"""Recoding, dropping, imputing, filtering, and checks on columns."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens import schemas as S


def recode(df: DataFrame, column: str, mapping: Mapping[str, str] = S.PRODUCT_RECODE) -> DataFrame:
    return df.replace(dict(mapping), subset=[column])


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop what is there; names that are not are ignored."""
    return df.drop(*columns)


def rename_by_pattern(df: DataFrame, pattern: str = r"\.x$", replacement: str = "") -> DataFrame:
    return df.toDF(*[re.sub(pattern, replacement, c) for c in df.columns])


def add_suffix(df: DataFrame, suffix: str, keep: Sequence[str] = ("user_id",)) -> DataFrame:
    return df.toDF(*[c if c in keep else c + suffix for c in df.columns])


def join_without_twins(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that takes from ``right`` only the columns ``left`` does not have yet."""
    fresh = [c for c in right.columns if c == key or c not in left.columns]
    return left.join(right.select(*fresh), key, "left")


def impute_missing_second(df: DataFrame) -> DataFrame:
    """The fixed stand-ins for customers with one product only."""
    return (
        df.withColumn("fecha_segundo_producto",
                      F.coalesce("fecha_segundo_producto", F.lit(S.NO_SECOND_DATE).cast("date")))
        .fillna({"segundo_producto": S.NO_SECOND_PRODUCT, "dias_entre_productos": 0})
    )


def holders(products: DataFrame, product_type: str) -> DataFrame:
    return products.where(F.col("product_type") == product_type)


def between_dates(df: DataFrame, column: str, start=None, end=None,
                  end_inclusive_day: bool = False) -> DataFrame:
    """Inclusive range on a timestamp; a bound left out is no bound.

    ``end`` is the midnight at the start of that day unless ``end_inclusive_day`` takes in the
    whole day. The comparison is on the bare column, so it reaches the Parquet scan.
    """
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("timestamp"))
    if end is not None:
        last = F.lit(end).cast("timestamp")
        df = df.where(
            F.col(column) < F.date_add(F.to_date(last), 1).cast("timestamp")
            if end_inclusive_day else F.col(column) <= last
        )
    return df


def any_of(df: DataFrame, choices: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """Keep rows matching every non-empty list; a null value matches only the empty text."""
    for column, values in choices.items():
        if values:
            df = df.where(F.coalesce(F.col(column), F.lit("")).isin(list(values)))
    return df


def at_least(df: DataFrame, threshold: float, column: str = "probability") -> DataFrame:
    return df.where(F.col(column) >= F.lit(threshold))


def recent(df: DataFrame, column: str, as_of: str | dt.datetime, days: int = 30) -> DataFrame:
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return df.where(F.col(column) >= since)


def date_like_columns(df: DataFrame) -> list[str]:
    """Text columns whose every value reads as a date. One pass over all rows, no sample."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return []
    row = df.agg(*[
        ((F.count(F.col(f"`{c}`")) > 0)
         & (F.count(F.col(f"`{c}`")) == F.count(F.try_to_timestamp(F.col(f"`{c}`"))))).alias(c)
        for c in names
    ]).first()
    return [c for c in names if row[c]]


def coerce_dates(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Parse as timestamps; what does not parse becomes null."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in columns})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def continuous_columns(df: DataFrame, more_than: int = 10, skip_prefix: str = "Unnamed") -> list[str]:
    """Numeric columns with more than ``more_than`` different values.

    One pass estimates every column at once. Only columns near the limit, which hold few different
    values by then, are counted exactly in a second pass.
    """
    names = [c for c in numeric_columns(df) if not c.startswith(skip_prefix)]
    if not names:
        return []
    rough = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in names]).first()
    near = [c for c in names if rough[c] <= 2 * more_than]
    exact = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in near]).first() if near else {}
    return [c for c in names if c not in near or exact[c] > more_than]


def schema_differences(df: DataFrame, expected: Sequence[str]) -> dict[str, list[str]]:
    return {
        "missing": [c for c in expected if c not in df.columns],
        "extra": [c for c in df.columns if c not in expected],
    }


def align_columns(df: DataFrame, expected: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exactly the expected columns, in their order; those not there are 0."""
    return df.select(*keys, *[
        F.col(c) if c in df.columns else F.lit(0).alias(c) for c in expected
    ])


def to_double(df: DataFrame, skip: Sequence[str] = ("user_id",)) -> DataFrame:
    def cast(c: str) -> Column:
        return F.col(c) if c in skip else F.col(c).cast("double").alias(c)

    return df.select(*[cast(c) for c in df.columns])


def three_feature_encoding(clients: DataFrame) -> DataFrame:
    """age, income 1 to 4 and risk 1 to 3, with the fixed defaults for what is not listed."""
    def code(column: str, codes: Mapping[str, int], default: int) -> Column:
        out = F.lit(default)
        for word, number in codes.items():
            out = F.when(F.col(column) == word, number).otherwise(out)
        return out

    return clients.select(
        "user_id",
        F.coalesce(F.col("age"), F.lit(0)).alias("age"),
        code("income_range", S.INCOME_CODES, 1).alias("income_code"),
        code("risk_profile", S.RISK_CODES, 2).alias("risk_code"),
    )
