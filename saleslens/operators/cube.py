"""Heat maps and contingency tables from a stored partial cube.

Rows are counted once over all attributes. From these counts smaller tables over some of the attributes
are made, those that save most for the pairs to be asked for; each is made from the smallest one that
holds its attributes, and so is every answer. Rows are never read again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens import schemas as S
from saleslens.functions import dashboard_age_band

VIEWS = "attributes array<string>, n_rows long, folder string"
_TOTAL, _KNOWN, _SUM = "n", "con_probabilidad", "suma"


def client_attributes() -> dict[str, Column]:
    """What the heat maps of clients ask for: raw values, and the band of the age."""
    raw = [c for c in S.HEATMAP_VARIABLES if c != "probability"] + ["status"]
    return {**{c: F.col(c) for c in raw}, "age_band": dashboard_age_band("age")}


def _sums(rows: DataFrame, attributes: Sequence[str]) -> DataFrame:
    return rows.groupBy(*attributes).agg(*[F.sum(c).alias(c) for c in (_TOTAL, _KNOWN, _SUM)])


@dataclass(frozen=True)
class Cube:
    """The stored views, smallest first: their attributes, number of rows and folder."""

    spark: SparkSession
    views: list[tuple[tuple[str, ...], int, str]]

    def view_for(self, attributes: Sequence[str]) -> tuple[tuple[str, ...], int, str]:
        """The smallest stored view that has all the attributes."""
        for view in self.views:
            if set(attributes) <= set(view[0]):
                return view
        raise ValueError(f"no view has {', '.join(attributes)}")

    def counts(self, *attributes: str) -> DataFrame:
        """(attributes, n, con_probabilidad, suma) over any of the attributes."""
        held, _, folder = self.view_for(attributes)
        rows = self.spark.read.parquet(folder)
        return rows if set(held) == set(attributes) else _sums(rows, attributes)

    def heatmap(self, x: str, y: str) -> DataFrame:
        """Clients per pair of raw values, as texts, missing ones as N/A."""
        def text(c: str) -> Column:
            return F.coalesce(F.col(c).cast("string"), F.lit("N/A"))

        if x == y:
            return self.counts(x).select(text(x).alias("x"), text(x).alias("y"), F.col(_TOTAL).alias("value"))
        return self.counts(x, y).select(text(x).alias("x"), text(y).alias("y"), F.col(_TOTAL).alias("value"))

    def banded_heatmap(self, x: str, y: str, metric: str = "probability", bands: Mapping[str, Sequence[str]] = S.HEATMAP_BANDS) -> DataFrame:
        """Dense matrix over fixed categories, empty cells 0; the mean probability to two decimals, or the count."""
        if metric not in ("probability", "count"):
            raise ValueError(f"{metric!r} is not one of probability, count")
        name = {c: "age_band" if c == "age" else c for c in bands}
        grid = self.spark.createDataFrame(
            [(j, i, yc, xc) for j, yc in enumerate(bands[y]) for i, xc in enumerate(bands[x])], "y_pos int, x_pos int, y string, x string")
        mean = F.bround(F.try_divide(F.col(_SUM).cast("double"), F.col(_KNOWN).cast("double")), 2)
        cells = self.counts(*{name[x], name[y]}).select(
            F.col(name[x]).alias("x"), F.col(name[y]).alias("y"), (mean if metric == "probability" else F.col(_TOTAL)).alias("value"))
        return grid.join(cells, ["x", "y"], "left").select("y_pos", "x_pos", "y", "x", F.coalesce("value", F.lit(0)).alias("value"))

    def contingency(self, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
        """One row per value of ``rows``, a count for each of ``values`` of the other attribute."""
        counted = self.counts(rows, columns)
        return counted.groupBy(rows).agg(*[F.coalesce(F.sum(F.when(F.col(columns) == v, F.col(_TOTAL))), F.lit(0)).alias(v) for v in values])


def chosen(attributes: Sequence[str], sizes: Mapping[frozenset, int], most: int) -> list[frozenset]:
    """Views to store besides that of all attributes: each next one saves the most rows read over all pairs."""
    pairs = [frozenset(p) for p in combinations(attributes, 2)]
    cost = dict.fromkeys(pairs, sizes[frozenset(attributes)])
    out: list[frozenset] = []
    while len(out) < most:
        saved = {v: sum(max(0, cost[p] - n) for p in pairs if p <= v) for v, n in sizes.items() if v not in out}
        best = max(saved, key=lambda v: (saved[v], -sizes[v], sorted(v)))
        if saved[best] <= 0:
            break
        out.append(best)
        for p in pairs:
            if p <= best:
                cost[p] = min(cost[p], sizes[best])
    return out


def build(clients: DataFrame, folder: str, attributes: Mapping[str, Column] | None = None, most: int = 6) -> Cube:
    """Count the clients over all attributes in one scan, and store up to ``most`` smaller views.

    Probabilities are summed as decimals, so that every view gives the same sums.
    """
    named = attributes or client_attributes()
    spark, names = clients.sparkSession, list(named)
    p = F.col("probability").cast("decimal(28,18)")
    rows = clients.select(*[c.alias(n) for n, c in named.items()], p.alias("_p"))
    rows.groupBy(*names).agg(F.count("*").alias(_TOTAL), F.count("_p").alias(_KNOWN), F.sum("_p").alias(_SUM)).write.mode(
        "overwrite").parquet(f"{folder}/0")
    base = spark.read.parquet(f"{folder}/0")
    subsets = [frozenset(s) for k in (2, 3) for s in combinations(names, k) if k < len(names)]
    # Distinct combinations of each subset, all from one pass over the counts.
    found = base.agg(F.count("*").alias("all"), *[
        F.approx_count_distinct(F.struct(*sorted(s)), 0.02).alias(f"s{i}") for i, s in enumerate(subsets)]).first()
    sizes = {s: found[f"s{i}"] for i, s in enumerate(subsets)} | {frozenset(names): found["all"]}
    views = [(tuple(names), found["all"], f"{folder}/0")]
    for i, s in enumerate(sorted(chosen(names, sizes, most), key=len, reverse=True), 1):
        made = Cube(spark, sorted(views, key=lambda v: v[1]))
        made.counts(*sorted(s)).select(*sorted(s), _TOTAL, _KNOWN, _SUM).write.mode("overwrite").parquet(f"{folder}/{i}")
        views.append((tuple(sorted(s)), spark.read.parquet(f"{folder}/{i}").count(), f"{folder}/{i}"))
    spark.createDataFrame([(list(a), n, f) for a, n, f in views], VIEWS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/views")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> Cube:
    """A stored cube; a row for each view."""
    rows = spark.read.schema(VIEWS).parquet(f"{folder}/views").collect()
    return Cube(spark, sorted(((tuple(r["attributes"]), r["n_rows"], r["folder"]) for r in rows), key=lambda v: v[1]))
