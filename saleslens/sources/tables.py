"""Reading and writing tables, and checks on what is there."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens import schemas as S


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a given schema; columns are matched by name, types never guessed."""
    names = spark.read.option("header", True).csv(path).columns
    by_name = {f.name: f for f in schema.fields}
    in_file = T.StructType([by_name.get(n, T.StructField(n, T.StringType())) for n in names])
    read = spark.read.schema(in_file).option("header", True).csv(path)
    return read.select(*[
        F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def read_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three input tables of a folder."""
    return tuple(
        read_csv(spark, f"{folder}/{name}.csv", schema) for name, schema in (
            ("demographics", S.DEMOGRAPHICS), ("products", S.PRODUCTS), ("transactions", S.TRANSACTIONS))
    )


def coerced(df: DataFrame, schema: T.StructType) -> DataFrame:
    """A table given in memory, its columns cast to the types of the model."""
    return df.withColumns({
        f.name: F.col(f.name).cast(f.dataType) for f in schema.fields if f.name in df.columns
    })


def read_csv_without(spark: SparkSession, path: str, schema: T.StructType,
                     excluded: Sequence[str] | None = None) -> DataFrame:
    return read_csv(spark, path, schema).drop(*(excluded or []))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str = "user_id", buckets: int = 512) -> None:
    """Save as a catalog table bucketed and sorted by key, so that joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def split_target(df: DataFrame, target: str = S.TARGET, key: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """Features without the target, and the target; both keep the key."""
    return df.drop(target), df.select(key, target)


def write_split(df: DataFrame, folder: str, target: str = S.TARGET, key: str = "user_id") -> None:
    x, y = split_target(df, target, key)
    write_parquet(x, f"{folder}/X")
    write_parquet(y, f"{folder}/y")


def score_rows(scored: DataFrame, threshold: float, probability: str = "probability") -> DataFrame:
    """Score file: user_id, t0 with four decimals, t0b as 0 or 1, t1 always 0."""
    p = F.col(probability)
    return scored.select(
        "user_id", (F.rint(p * 10000) / 10000).alias("t0"), (p >= F.lit(threshold)).cast("int").alias("t0b"),
        F.lit(0).alias("t1"))


def empty_tables(tables: Mapping[str, DataFrame]) -> list[str]:
    """Names of the tables without a row; each check stops at the first row found."""
    return [name for name, df in tables.items() if df.isEmpty()]


def audit_frames(spark: SparkSession, tables: Mapping[str, DataFrame],
                 expected: Sequence[str] = tuple(S.EXPECTED_TABLES)) -> DataFrame:
    """(tabla, presente, filas) for every expected table."""
    report = spark.createDataFrame([(t, t in tables) for t in expected], "tabla string, presente boolean")
    counted = None
    for name in expected:
        if name in tables:
            one = tables[name].agg(F.count("*").alias("filas")).select(F.lit(name).alias("tabla"), "filas")
            counted = one if counted is None else counted.unionByName(one)
    if counted is None:
        return report.withColumn("filas", F.lit(None).cast("bigint"))
    return report.join(counted, "tabla", "left")


def audit_catalog(spark: SparkSession, expected: Sequence[str] = tuple(S.EXPECTED_TABLES),
                  database: str | None = None) -> DataFrame:
    """The same report over the tables of the session catalog."""
    def name(t: str) -> str:
        return f"{database}.{t}" if database else t

    return audit_frames(spark, {t: spark.table(name(t)) for t in expected if spark.catalog.tableExists(name(t))},
                        expected)


def schema_report(df: DataFrame) -> DataFrame:
    """(column_name, data_type, is_nullable) per column."""
    rows = [(f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO") for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string, is_nullable string")


def first_rows(df: DataFrame, k: int = 5) -> DataFrame:
    return df.limit(k)
