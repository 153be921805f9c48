"""Business queries over clients and contacts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslens import schemas as S
from saleslens.functions import dashboard_age_band, priority_band, series_name
from saleslens.operators.cleaning import any_of, between_dates, recent

def _p() -> Column:
    return F.col("probability")


def kpi_summary(clients: DataFrame, contacts: DataFrame, threshold: float = S.SERVICE_THRESHOLD) -> DataFrame:
    """One row: clients, mean probability, contact rows, clients at or above the threshold."""
    contacted = contacts.agg(F.count("id").alias("contacted"))
    return clients.agg(
        F.count("*").alias("total_clients"),
        F.coalesce(F.avg(_p()), F.lit(0.0)).alias("churn_risk_mean"),
        F.count_if(_p() >= threshold).alias("at_risk_count"),
        F.lit(0.0).alias("conversion_rate"),
    ).select("*", contacted.scalar().alias("contacted"))


def business_kpis(clients: DataFrame, threshold: float = S.BUSINESS_THRESHOLD,
                  conversion: float = 0.20, value: int = 1000) -> DataFrame:
    counted = clients.agg(
        F.count("*").alias("total_clients"),
        F.bround(F.coalesce(F.avg(_p()), F.lit(0.0)), 2).alias("churn_risk_mean"),
        F.count_if(F.coalesce(F.col("status"), F.lit("pending")) != "pending").alias("contacted"),
        F.count_if(_p() >= threshold).alias("potential_clients"),
    )
    potential = F.col("potential_clients")
    return counted.select(
        "total_clients", "churn_risk_mean", "contacted",
        F.lit(0.0).alias("conversion_rate"),
        potential.alias("at_risk_count"),
        "potential_clients",
        F.floor(potential * F.lit(conversion)).alias("expected_conversion"),
        (potential * value).alias("financial_opportunity"),
        F.col("contacted").alias("contact_progress"),
    )


# -- priority list -----------------------------------------------------------

LIST_COLUMNS = ["id", "user_id", "probability", "status", "age", "risk_profile", "income_range"]


def ranked_page(clients: DataFrame, page: int = 1, size: int = 10,
                after: tuple[float | None, int] | None = None) -> DataFrame:
    """One page of clients, most probable first (nulls lead), id as the tie-break.

    A page far down keeps all the rows before it as well; ``after`` gives the probability and id
    of the last row seen instead, and then every page costs the same.
    """
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page is at least 1, size 1 to 100")
    ordered = [F.desc_nulls_first("probability"), F.asc("id")]
    if after is None:
        return clients.orderBy(*ordered).offset((page - 1) * size).limit(size)
    probability, last_id = after
    if probability is None:
        rest = _p().isNotNull() | (F.col("id") > last_id)
    else:
        rest = (_p() < probability) | ((_p() == probability) & (F.col("id") > last_id))
    return clients.where(rest).orderBy(*ordered).limit(size)


def list_row(clients: DataFrame) -> DataFrame:
    """Columns of the list: null probability shows as 0, null status as pending."""
    return clients.select(
        "id", "user_id",
        F.coalesce(_p(), F.lit(0.0)).alias("probability"),
        F.when(F.coalesce(F.col("status"), F.lit("")) == "", "pending").otherwise(F.col("status")).alias("status"),
        "age", "risk_profile", "income_range",
        priority_band(_p()).alias("priority"),
    )


def priority_list(clients: DataFrame, page: int = 1, size: int = 10,
                  after: tuple[float | None, int] | None = None) -> DataFrame:
    return list_row(ranked_page(clients.select(*LIST_COLUMNS), page, size, after))


def resort(df: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """Order by any column; texts by bytes, missing ones as the empty text."""
    c = F.col(column)
    if dict(df.dtypes)[column] == "string":
        c = F.coalesce(c, F.lit(""))
    return df.orderBy(c.desc() if descending else c.asc(), F.asc("id"))


def export_list(listed: DataFrame, statuses: Sequence[str] = (), risks: Sequence[str] = (),
                priorities: Sequence[str] = ()) -> DataFrame:
    """The filtered list as texts for a file: two decimals, missing values empty."""
    kept = any_of(listed, {"status": statuses, "risk_profile": risks, "priority": priorities})

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    age = F.when(F.col("age") == 0, "").otherwise(F.coalesce(F.col("age").cast("string"), F.lit("")))
    return kept.select(
        "id", "user_id", F.format_string("%.2f", "probability").alias("probability"), "status",
        age.alias("age"), text("income_range"), text("risk_profile"), text("priority"),
    )


# -- distributions -------------------------------------------------------------

def probability_histogram(clients: DataFrame, include_upper: bool = False) -> DataFrame:
    """Five bins of 0.2, lower bound included; a probability of exactly 1 is in none of them.

    The percentage is of all clients with a probability. ``include_upper`` puts 1 in the last bin.
    One pass, all bins as conditional counts, so empty ones are there with 0.
    """
    bounds = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    inside = [(_p() >= lo) & (_p() < hi) for lo, hi in zip(bounds, bounds[1:])]
    if include_upper:
        inside[-1] = (_p() >= bounds[-2]) & (_p() <= bounds[-1])
    counted = clients.agg(
        F.count(_p()).alias("total"), *[F.count_if(c).alias(f"b{i}") for i, c in enumerate(inside)])
    rows = [
        F.struct(
            F.lit(f"{20 * i}-{20 * i + 20}%").alias("range"),
            F.col(f"b{i}").alias("count"),
            F.coalesce(F.bround(F.try_divide(F.col(f"b{i}").cast("double"), F.col("total")) * 100, 2),
                       F.lit(0.0)).alias("percentage"),
        ) for i in range(5)
    ]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def missing_probabilities(clients: DataFrame) -> DataFrame:
    """The clients a histogram leaves out because they have no probability."""
    return clients.agg(F.count_if(_p().isNull()).alias("sin_probabilidad"))


def contacted_histogram(clients: DataFrame, threshold: float = 0.2389) -> DataFrame:
    """Ten bins of 0.1, clients still pending against all others."""
    edges = [i / 10 for i in range(11)]
    pending = F.coalesce(F.col("status"), F.lit("pending")) == "pending"
    aggregates = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = (_p() >= lo) & (_p() < hi)
        aggregates += [F.count_if(inside & pending).alias(f"p{i}"), F.count_if(inside & ~pending).alias(f"c{i}")]
    rows = [
        F.struct(F.lit(f"{int(lo * 100)}-{int(hi * 100)}%").alias("range"),
                 F.col(f"p{i}").alias("no_contacted"), F.col(f"c{i}").alias("contacted"),
                 F.lit(threshold).alias("threshold"))
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ]
    return clients.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# -- heat maps -----------------------------------------------------------------

def _check(name: str, allowed: Sequence[str]) -> None:
    if name not in allowed:
        raise ValueError(f"{name!r} is not one of {', '.join(allowed)}")


def heatmap(clients: DataFrame, x: str, y: str) -> DataFrame:
    """Clients per pair of raw values, as texts, missing ones as N/A."""
    _check(x, S.HEATMAP_VARIABLES)
    _check(y, S.HEATMAP_VARIABLES)
    return (
        clients.groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("id").alias("value"))
        .select(F.coalesce(F.col("_x").cast("string"), F.lit("N/A")).alias("x"),
                F.coalesce(F.col("_y").cast("string"), F.lit("N/A")).alias("y"), "value")
    )


def heatmap_axis(clients: DataFrame, variable: str) -> DataFrame:
    """Values of one axis, in the order of texts."""
    _check(variable, S.HEATMAP_VARIABLES)
    text = F.coalesce(F.col(variable).cast("string"), F.lit("N/A"))
    return clients.select(text.alias("value")).distinct().orderBy("value")


def banded_heatmap(clients: DataFrame, x: str, y: str, metric: str = "probability",
                   bands: Mapping[str, Sequence[str]] = S.HEATMAP_BANDS) -> DataFrame:
    """Dense matrix over fixed categories: (y_pos, x_pos, y, x, value), empty cells 0.

    ``metric`` is the mean probability (two decimals) or the count. The grid is a literal of at
    most a few dozen cells, and the data is grouped once.
    """
    _check(x, list(bands))
    _check(y, list(bands))
    _check(metric, ["probability", "count"])

    def key(name: str) -> Column:
        return dashboard_age_band("age") if name == "age" else F.col(name).cast("string")

    grid = clients.sparkSession.createDataFrame(
        [(j, i, yc, xc) for j, yc in enumerate(bands[y]) for i, xc in enumerate(bands[x])],
        "y_pos int, x_pos int, y string, x string")
    value = F.bround(F.avg(_p()), 2) if metric == "probability" else F.count("*")
    cells = clients.groupBy(key(x).alias("x"), key(y).alias("y")).agg(value.alias("value"))
    return grid.join(cells, ["x", "y"], "left").select(
        "y_pos", "x_pos", "y", "x", F.coalesce("value", F.lit(0)).alias("value"))


def banded_matrix(clients: DataFrame, x: str, y: str, metric: str = "probability",
                  bands: Mapping[str, Sequence[str]] = S.HEATMAP_BANDS) -> DataFrame:
    """The same cells as one row per y with a column per x."""
    cells = banded_heatmap(clients, x, y, metric, bands)
    return cells.groupBy("y_pos", "y").pivot("x", list(bands[x])).agg(F.first("value")).orderBy("y_pos")


def percent_cell(value: str | Column) -> Column:
    return F.format_string("%.0f%%", (F.col(value) if isinstance(value, str) else value) * 100)


def segment_opportunity(cells: DataFrame, count: str = "value") -> DataFrame:
    expected = F.floor(F.col(count) * F.lit(0.2) + 0.5)
    return cells.withColumns({"expected_conversion": expected, "financial": expected * 1000})


# -- contacts ------------------------------------------------------------------

def contact_progress(contacts: DataFrame, start=None, end=None,
                     outcomes: Sequence[str] = tuple(S.OUTCOMES), end_inclusive_day: bool = False) -> DataFrame:
    """Contacts per day, one column per outcome, zeros filled in.

    Outcomes outside the list, and missing ones, are added to ``other``.
    """
    kept = between_dates(contacts, "contacted_at", start, end, end_inclusive_day)
    known = [o for o in outcomes if o != "other"]
    outcome = F.when(F.col("outcome").isin(known), F.col("outcome")).otherwise("other")
    return (
        kept.where(F.col("contacted_at").isNotNull())
        .groupBy(F.to_date("contacted_at").alias("date"))
        .agg(*[F.count_if(outcome == o).alias(o) for o in outcomes])
    )


def contact_series(contacts: DataFrame, start=None, end=None) -> DataFrame:
    """The same counts in long form with titled series names."""
    daily = contact_progress(contacts, start, end)
    rows = [F.struct(series_name(F.lit(o)).alias("name"), F.col(o).alias("data")) for o in S.OUTCOMES]
    return daily.select("date", F.explode(F.array(*rows)).alias("r")).select("date", "r.*")


def contact_pace(clients: DataFrame, monthly_target: int = 100, as_of: str = "2024-01-15",
                 threshold: float = S.BUSINESS_THRESHOLD) -> DataFrame:
    """Contacts made against a monthly target, and the daily rate that is still needed."""
    day = F.lit(as_of).cast("date")
    target = F.lit(monthly_target)
    counted = clients.agg(
        F.count_if(F.coalesce(F.col("status"), F.lit("pending")) != "pending").alias("total_contacted"),
        F.count_if(_p() >= threshold).alias("total_prioritized"),
    )
    done = F.col("total_contacted")
    left = F.greatest(F.lit(1), F.dayofmonth(F.last_day(day)) - F.dayofmonth(day))
    remaining = F.greatest(F.lit(0).cast("bigint"), target - done)
    steps = counted.select(
        "total_contacted", "total_prioritized",
        target.alias("monthly_target"), done.alias("contacted_this_month"),
        left.alias("days_remaining"), remaining.alias("remaining_contacts"),
        F.ceil(remaining / left).alias("daily_needed"),
        F.floor(done / F.greatest(F.lit(1), F.dayofmonth(day))).alias("daily_expected"),
    ).withColumn("difference", F.col("daily_expected") - F.col("daily_needed"))
    # Fixed texts shown to the user.
    message = (
        F.when(F.col("contacted_this_month") >= F.col("monthly_target"),
               F.format_string("¡Meta mensual de %d contactos alcanzada!", "monthly_target"))
        .when(F.col("difference") >= 0,
              F.format_string("Ritmo actual (%d/día) suficiente para alcanzar la meta.", "daily_expected"))
        .otherwise(F.format_string("Ritmo actual (%d/día) insuficiente. Necesitas %d/día.",
                                   "daily_expected", "daily_needed"))
    )
    return steps.withColumn("projection_message", message)


def pace_percentages(pace: DataFrame) -> DataFrame:
    """Progress in whole percent, and the projection to the end of the month, at most 100."""
    def percent(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.floor(a * 100.0 / b + 0.5)).otherwise(0)

    done, target = F.col("contacted_this_month"), F.col("monthly_target")
    projected = done + F.col("daily_expected") * F.col("days_remaining")
    return pace.select(
        percent(F.col("total_contacted"), F.col("total_prioritized")).alias("general_pct"),
        percent(done, target).alias("monthly_pct"),
        projected.alias("projected_contacts"),
        F.least(percent(projected, target), F.lit(100).cast("bigint")).alias("projected_pct"),
        (projected >= target).alias("will_reach_target"),
    )


def health_counts(clients: DataFrame, predictions: DataFrame, contacts: DataFrame, as_of: str,
                  high: float = 0.7, days: int = 30, date: str = "prediction_date") -> DataFrame:
    """High-probability clients, predictions of the last days, and all contacts, in one row."""
    fresh = recent(predictions, date, as_of, days).agg(F.count("*").alias("n"))
    every = contacts.agg(F.count("*").alias("n"))
    return clients.agg(F.count_if(_p() >= high).alias("high_probability")).select(
        "*", fresh.scalar().alias("recent_predictions"), every.scalar().alias("contacts"))
