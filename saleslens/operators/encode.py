"""Encoders with a fit step (one pass over the data, small result) and a lazy transform."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslens.operators.ranks import ROWS_PER_BUCKET, bucket_by_value, exact_quantiles, running_totals
from saleslens.session import durable


@dataclass(frozen=True)
class StandardScaler:
    """(x - mean) / population deviation; a constant column is divided by 1."""

    stats: Mapping[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> StandardScaler:
        row = df.agg(*[
            f(F.col(c).cast("double")).alias(f"{p}_{c}")
            for c in columns for p, f in (("m", F.avg), ("s", F.stddev_pop))
        ]).first()
        return cls({c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c).cast("double") - F.lit(mean)) / F.lit(sd) for c, (mean, sd) in self.stats.items()
        })


@dataclass(frozen=True)
class Winsorizer:
    """Clip to two interpolated quantiles."""

    bounds: Mapping[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> Winsorizer:
        bounds = {}
        for c in columns:
            row = exact_quantiles(df, c, {"low": low, "high": high}).first()
            bounds[c] = (row["low"], row["high"])
        return cls(bounds)

    def transform(self, df: DataFrame) -> DataFrame:
        def clip(c: str, low: float, high: float) -> Column:
            x = F.col(c).cast("double")
            return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))

        return df.withColumns({
            c: clip(c, low, high) for c, (low, high) in self.bounds.items() if low is not None
        })


def _as_text(column: str, missing: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(missing))


@dataclass(frozen=True)
class LabelEncoder:
    """Code of a text = its place among the different texts in the order of their bytes, from 0.

    The dictionary of each column is a table and is joined, so it may be of any length. Null is the
    text ``missing``. A text not seen when fitting gives null.
    """

    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    missing: str = "nan"

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], missing: str = "nan") -> LabelEncoder:
        if not columns:
            return cls({}, missing)
        pairs = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), _as_text(c, missing).alias("label")) for c in columns
        ])).alias("p")).select("p.*").distinct()
        # All dictionaries are numbered together; a column's codes start where its rows do.
        coded = durable(_numbered(pairs))
        return cls({c: coded.where(F.col("column") == c).select("label", "code") for c in columns}, missing)

    def transform(self, df: DataFrame) -> DataFrame:
        order, out = df.columns, df
        for c, table in self.tables.items():
            renamed = table.select(F.col("label").alias("_label"), F.col("code").alias("_code"))
            out = (
                out.join(renamed, _as_text(c, self.missing) == F.col("_label"), "left")
                .withColumn(c, F.col("_code")).drop("_label", "_code")
            )
        return out.select(*order)


def _numbered(pairs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """column, label, code of distinct (column, label)."""
    rows = durable(pairs.select(F.struct("column", "label").alias("_place"), F.lit(1).alias("_one")))
    placed = bucket_by_value(rows, "_place", rows_per_bucket).withColumn("column", F.col("_place.column"))
    ranked = running_totals(placed, {"_upto": "_one"}, [F.col("_place.label")], ["column"])
    return ranked.select("column", F.col("_place.label").alias("label"), (F.col("_upto") - 1).cast("int").alias("code"))


def label_table(df: DataFrame, column: str, missing: str = "nan", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Different texts of a column with their codes, for dictionaries of any length."""
    pairs = df.select(F.lit(column).alias("column"), _as_text(column, missing).alias("label")).distinct()
    return _numbered(pairs, rows_per_bucket).select("label", "code")


@dataclass(frozen=True)
class OneHot:
    """One boolean column per category but the first; a null has false in all of them.

    The result has a column for each category, so their texts pass through the driver.
    """

    categories: Mapping[str, list[str]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> OneHot:
        found: dict[str, list[str]] = {c: [] for c in columns}
        pairs = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label")) for c in columns
        ])).alias("p")).select("p.*").where("label is not null").distinct()
        for r in pairs.collect():
            found[r["column"]].append(r["label"])
        return cls({c: sorted(v, key=lambda s: s.encode()) for c, v in found.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        made = {
            f"{c}_{value}": F.coalesce(F.col(c).cast("string") == F.lit(value), F.lit(False))
            for c, values in self.categories.items() for value in values[1:]
        }
        return df.withColumns(made).drop(*self.categories)


def log1p(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Natural log of 1 + x; null where it is not defined."""
    return df.withColumns({c: F.log1p(F.col(c).cast("double")) for c in columns if c in df.columns})


def to_boolean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("boolean") for c in columns if c in df.columns})
