"""Exploratory profiling: frequencies, periods, contingency tables, moments, collinearity."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleslens.functions import cents, month_of, quarter_label
from saleslens.operators.factoring import inflation, triangle
from saleslens.operators.ranks import quantiles_of_counts, value_counts

TOTAL = "Total"


# -- one column ------------------------------------------------------------

def frequency(df: DataFrame, column: str, ordered: bool = False) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column)) if ordered else counts


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    return frequency(df.where(F.col(column).isNotNull()), column, ordered=True).limit(k)


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """Number of different values, counted over the distinct rows of all tasks."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().agg(
        F.count("*").alias("n_distinct"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def mode(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value, the smallest on ties, from counts per value."""
    counts = frequency(df.where(F.col(column).isNotNull()), column)
    return counts.agg(_most_frequent(column, "n").alias("moda"))


def _most_frequent(column: str, n: str) -> Column:
    return F.min(F.when(F.col(column).isNotNull(), F.struct((-F.col(n)).alias("v"), F.col(column).alias("x"))))["x"]


def moments_of_counts(counts: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Per group of ``by``: rows, rows with a value, mean, extremes, mode, sample variance and deviation, from ``value_counts``.

    The variance is summed around the mean, so it keeps its digits; both passes are over the counts.
    """
    n, x = F.col("_n"), F.col("_x")
    present = F.col(column).isNotNull()
    first = counts.groupBy(*by).agg(
        F.sum("_n").alias("filas"), F.coalesce(F.sum(F.when(present, n)), F.lit(0)).alias("n"),
        F.sum(x * n).alias("_sum"), F.min(column).alias("minimo"), F.max(column).alias("maximo"),
        _most_frequent(column, "_n").alias("moda"),
    ).withColumn("media", F.try_divide("_sum", F.col("n").cast("double"))).drop("_sum")
    means = first.select(F.struct(*by).alias("_group"), F.col("media").alias("_mean"))
    around = counts.withColumn("_group", F.struct(*by)).join(means, "_group").groupBy("_group").agg(
        F.sum(n * (x - F.col("_mean")) * (x - F.col("_mean"))).alias("_squares"))
    variance = F.try_divide("_squares", (F.col("n") - 1).cast("double"))
    return first.withColumn("_group", F.struct(*by)).join(around, "_group", "left").withColumns(
        {"varianza": variance, "desviacion": F.sqrt(variance)}).drop("_group", "_squares")


def univariate(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, mode, range, sample variance and deviation in one row, from one scan.

    A table without rows has a row of nulls.
    """
    counts = value_counts(df.select(column, F.lit(1).alias("_all")), column, ["_all"])
    if not counts.head(1):
        counts = counts.unionByName(df.sparkSession.createDataFrame([(1, 0)], "_all int, _n long"), allowMissingColumns=True)
    found = moments_of_counts(counts, column, ["_all"]).join(
        quantiles_of_counts(counts, {"mediana": 0.5}, ["_all"]), "_all", "left")
    return found.select("media", "minimo", "maximo", "varianza", "desviacion", "mediana", "moda")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, deviation, extremes and exact quartiles; one row per column, all from one scan and one shuffle."""
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("columna"), F.col(c).cast("double").alias("valor")) for c in columns
    ])).alias("p")).select("p.*")
    counts = value_counts(pairs, "valor", ["columna"])
    basic = moments_of_counts(counts, "valor", ["columna"]).select("columna", "n", "media", "desviacion", "minimo", "maximo")
    return basic.join(quantiles_of_counts(counts, quartiles, ["columna"]), "columna", "left")


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column as (columna, nulos) rows, all counted in one pass."""
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counted.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("columna"), F.col(f"`{c}`").alias("nulos")) for c in df.columns
    ])).alias("r")).select("r.*")


def columns_with_nulls(df: DataFrame) -> DataFrame:
    return null_counts(df).where(F.col("nulos") > 0)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def extrema(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("minimo"), F.max(column).alias("maximo"))


def equal_width_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Edges of equal bins over the observed range."""
    from saleslens.functions import amount_edges

    low, high = extrema(df, column).first()
    return amount_edges(float(low), float(high), bins)


# -- periods -----------------------------------------------------------------

def by_month(df: DataFrame, date: str, also: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*also, month_of(date).alias("mes")).agg(F.count("*").alias("n"))


def by_year(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy(F.year(date).alias("anio")).agg(F.count("*").alias("n"))


def by_quarter(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy(F.year(date).alias("anio"), F.quarter(date).alias("trimestre")).agg(
        F.count("*").alias("n"))


def by_quarter_label(df: DataFrame, date: str) -> DataFrame:
    """Labels such as ``T1 2021`` in the order of time."""
    number = F.year(date) + (F.quarter(date) - 1) / 4
    return (
        df.groupBy(quarter_label(date).alias("periodo"), number.alias("periodo_num"))
        .agg(F.count("*").alias("n")).orderBy("periodo_num")
    )


# -- two columns -------------------------------------------------------------

def pair_counts(df: DataFrame, rows: str, columns: str, weight: str | None = None) -> DataFrame:
    n = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(rows, columns).agg(n.alias("n"))


def contingency(df: DataFrame, rows: str, columns: str, values: Sequence,
                totals: bool = False, weight: str | None = None) -> DataFrame:
    """Counts of ``rows`` by ``columns`` as a wide table, zeros filled in.

    ``values`` is the domain of ``columns``. With ``totals`` a Total column and row are added; they
    are formed from the counted pairs, so the data is still read and shuffled once. ``weight``
    names a column of counts when ``df`` is already grouped.
    """
    pairs = pair_counts(df, rows, columns, weight)
    if not totals:
        wide = pairs.groupBy(rows).pivot(columns, list(values)).agg(F.sum("n"))
        return wide.fillna(0, [str(v) for v in values])
    known = pairs.withColumn("_label", F.coalesce(F.col(rows).cast("string"), F.lit("NA")))
    wide = known.rollup("_label").agg(
        *[F.coalesce(F.sum(F.when(F.col(columns) == F.lit(v), F.col("n"))), F.lit(0)).alias(str(v))
          for v in values],
        F.sum("n").alias(TOTAL),
    )
    return wide.select(F.coalesce(F.col("_label"), F.lit(TOTAL)).alias(rows),
                       *[F.col(f"`{v}`") for v in values], TOTAL)


def with_total_row(table: DataFrame, label: str, numeric: Sequence[str]) -> DataFrame:
    """Append a row of column sums to a small finished table."""
    row = table.agg(*[F.sum(c).alias(c) for c in numeric]).withColumn(label, F.lit(TOTAL))
    return table.unionByName(row, allowMissingColumns=True)


def _with_median(groups: DataFrame, counts: DataFrame, by: str) -> DataFrame:
    medians = quantiles_of_counts(counts, {"mediana": 0.5}, [by]).withColumnRenamed(by, "_by")
    return groups.join(medians, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def group_median(df: DataFrame, by: str, column: str) -> DataFrame:
    """Rows and median of ``column`` per value of ``by``, from one scan."""
    counts = value_counts(df, column, [by])
    return _with_median(counts.groupBy(by).agg(F.sum("_n").alias("n")), counts, by)


def group_mean(df: DataFrame, by: Sequence[str], column: str, name: str = "promedio",
               ordered: bool = False, money: bool = False) -> DataFrame:
    """Mean per group; ``money`` adds up whole cents, so that the mean is the same on every run."""
    mean = F.sum(cents(column)) / 100 / F.count(column) if money else F.avg(column)
    out = df.groupBy(*by).agg(mean.alias(name))
    return out.orderBy(F.desc(name)) if ordered else out


def grouped_stats(df: DataFrame, by: str, column: str) -> DataFrame:
    """Mean, median, deviation and rows of ``column`` per value of ``by``, from one scan."""
    counts = value_counts(df, column, [by])
    basic = moments_of_counts(counts, column, [by]).select(by, "media", F.col("desviacion").alias("sd"), F.col("filas").alias("n"))
    return _with_median(basic, counts, by)


def share_within(df: DataFrame, group: str, category: str) -> DataFrame:
    """Count and percentage of each category inside its group, from counted pairs."""
    inside = Window.partitionBy(group)
    return pair_counts(df, group, category).withColumn(
        "percentage", F.col("n") * 100.0 / F.sum("n").over(inside))


# -- detail with customer attributes --------------------------------------------

def attach(detail: DataFrame, dimension: DataFrame, key: str = "user_id") -> DataFrame:
    """Detail rows with the attributes of their customer.

    Whether the dimension is broadcast is left to its measured size; otherwise adaptive execution
    splits the partitions of a customer with very many rows.
    """
    return detail.join(dimension, key, "left")


def counts_by_attribute(detail: DataFrame, category: str, dimension: DataFrame,
                        attributes: Sequence[str], key: str = "user_id") -> DataFrame:
    """Detail rows counted per customer and category first, then joined with the attributes."""
    counted = detail.groupBy(key, category).agg(F.count("*").alias("n"))
    return counted.join(dimension.select(key, *attributes), key, "left")


def attribute_contingency(detail: DataFrame, category: str, dimension: DataFrame, attribute: str,
                          values: Sequence[str], key: str = "user_id") -> DataFrame:
    """Wide counts of a customer attribute by a category of the detail rows."""
    joined = counts_by_attribute(detail, category, dimension, [attribute], key)
    return contingency(joined, attribute, category, values, weight="n")


def buyer_profile(products: DataFrame, demographics: DataFrame,
                  attributes: Sequence[str] = ("age_range_sturges", "risk_profile", "income_range")) -> DataFrame:
    """Holders of each product by each attribute: (product_type, variable, valor, n)."""
    joined = counts_by_attribute(products, "product_type", demographics, attributes)
    sets = [[F.col("product_type"), F.col(a)] for a in attributes]
    grouped = joined.groupingSets(sets, "product_type", *attributes).agg(
        F.sum("n").alias("n"), *[F.grouping(a).alias(f"_g_{a}") for a in attributes])
    variable = F.coalesce(*[F.when(F.col(f"_g_{a}") == 0, F.lit(a)) for a in attributes])
    value = F.coalesce(*[F.when(F.col(f"_g_{a}") == 0, F.col(a)) for a in attributes])
    return grouped.select("product_type", variable.alias("variable"), value.alias("valor"), "n")


def crossed_buyers(products: DataFrame, demographics: DataFrame, product_type: str, rows: str,
                   columns: str, values: Sequence[str]) -> DataFrame:
    """Holders of one product, one customer attribute by another."""
    held = products.where(F.col("product_type") == product_type)
    joined = counts_by_attribute(held, "product_type", demographics, [rows, columns])
    return contingency(joined, rows, columns, values, weight="n")


# -- association ---------------------------------------------------------------

def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair as (variable_x, variable_y, correlacion) rows.

    One pass; each pair uses the rows where both values are present.
    """
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    one_row = df.agg(*[
        F.corr(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"r_{i}_{j}")
        for i, j in pairs
    ])
    cells = [
        F.struct(F.lit(columns[i]).alias("variable_x"), F.lit(columns[j]).alias("variable_y"),
                 F.col(f"r_{min(i, j)}_{max(i, j)}").alias("correlacion"))
        for i in range(len(columns)) for j in range(len(columns))
    ]
    return one_row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def variance_inflation(df: DataFrame, columns: Sequence[str], constant: bool = True) -> DataFrame:
    """Variance inflation factors over complete rows, largest first.

    Rows are reduced to triangular factors in the tasks (``factoring``). A column that others make up has an
    infinite factor; a constant column, and every column of a table without rows, has none (null).
    ``constant`` adds the row of the intercept.
    """
    factors, intercept = inflation(*triangle(df, columns))
    rows = [*zip(columns, factors), *([("const", intercept)] if constant else [])]
    ordered = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0)))
    return df.sparkSession.createDataFrame(ordered, "variable string, vif double")
