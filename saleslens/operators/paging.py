"""Pages of a ranked table by position, from a stored order.

The rows are written once in ranges of their order, with the number of rows before each range. The place of
a page tells the ranges it lies in, and only their files are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from saleslens.operators.ranks import PLACE, numbered_in_order, running_totals
from saleslens.session import durable

ROWS_PER_RANGE = 100_000
_RANGE = "_range"


def _with_range(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields, StructField(_RANGE, IntegerType())])


@dataclass(frozen=True)
class RankedTable:
    """A folder with ranges of rows, and their counts, in the order ``by``."""

    spark: SparkSession
    folder: str
    by: tuple[Column, ...]

    def ranges(self) -> DataFrame:
        """(range, n rows, upto: rows up to its end), a row for each range."""
        return self.spark.read.parquet(f"{self.folder}/ranges")

    def total(self) -> int:
        return self.ranges().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def ranges_of(self, page: int, size: int) -> list[tuple[int, int]]:
        """(range, rows before it) of the ranges that a page lies in: two, unless a page is larger than a range."""
        if page < 1 or size < 1:
            raise ValueError("page and size are at least 1")
        first, last = (page - 1) * size, page * size
        inside = self.ranges().where((F.col("upto") > first) & (F.col("upto") - F.col("n") < last))
        return sorted((r["range"], r["upto"] - r["n"]) for r in inside.collect())

    def page(self, page: int, size: int = 10) -> DataFrame:
        """One page, in order; beyond the last one there are no rows."""
        held = self.ranges_of(page, size)
        empty = self.spark.read.parquet(f"{self.folder}/empty")
        if not held:
            return empty
        places = [f"{self.folder}/rows/{_RANGE}={r}" for r, _ in held]
        rows = self.spark.read.schema(_with_range(empty)).option("basePath", f"{self.folder}/rows").parquet(*places)  # others are not listed
        here = rows.where(F.col(_RANGE).isin([r for r, _ in held])).drop(_RANGE)
        return here.orderBy(*self.by).offset((page - 1) * size - held[0][1]).limit(size)


def write_ranked(rows: DataFrame, folder: str, by: tuple[Column, ...], rows_per_range: int = ROWS_PER_RANGE) -> RankedTable:
    """Write rows in ranges of the order ``by``, which must tell all rows apart that may be many, such as by an id at its end.

    The order is made by tasks of ``ROWS_PER_RANGE`` rows at least; smaller ranges are runs of rows inside these, numbered on.
    """
    spark = rows.sparkSession
    pieces = max(1, -(-rows.count() // max(rows_per_range, ROWS_PER_RANGE)))
    piece, sorted_rows = numbered_in_order(rows.repartitionByRange(pieces, *by), *by)
    staged = durable(sorted_rows.withColumn("_piece", piece).withColumn(_RANGE, F.floor(F.col(PLACE) / rows_per_range).cast("int")).drop(PLACE))
    sizes = sorted((r["_piece"], r["n"]) for r in staged.groupBy("_piece").agg((F.max(_RANGE) + 1).alias("n")).collect())  # a row for each task
    before = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    placed = staged.join(F.broadcast(spark.createDataFrame(before, "_piece int, _before int")), "_piece").select(
        *rows.columns, (F.col(_RANGE) + F.col("_before")).alias(_RANGE))
    placed.write.mode("overwrite").partitionBy(_RANGE).parquet(f"{folder}/rows")
    rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{folder}/empty")
    counts = placed.groupBy(F.col(_RANGE).alias("range")).agg(F.count("*").alias("n"))
    # A row for each range; their sums run in groups of a thousand.
    summed = running_totals(counts.withColumn("_bucket", F.shiftright("range", 10)), {"upto": "n"}, [F.col("range")])
    summed.select("range", "n", "upto").write.mode("overwrite").parquet(f"{folder}/ranges")
    return RankedTable(spark, folder, tuple(by))


def ranked_clients(clients: DataFrame, folder: str, rows_per_range: int = ROWS_PER_RANGE) -> RankedTable:
    """Clients in the order of the priority list: most probable first, nulls lead, then by id."""
    return write_ranked(clients, folder, (F.desc_nulls_first("probability"), F.asc("id")), rows_per_range)
