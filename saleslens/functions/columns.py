"""Scalar rules as Catalyst expressions. Nothing here runs Python per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from saleslens import schemas as S


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(amount: str | Column) -> Column:
    """Money as whole cents, so that sums are exact in any order of addition."""
    return F.rint(_col(amount).cast("double") * 100).cast("bigint")


def month_of(date: str | Column) -> Column:
    return F.trunc(_col(date), "month")


def epoch(date: str | Column, unit: str = "s") -> Column:
    """Date as epoch seconds (``s``) or nanoseconds (``ns``), the same in every time zone."""
    seconds = F.unix_date(F.to_date(_col(date))).cast("bigint") * 86_400
    return {"s": seconds, "ns": seconds * F.lit(1_000_000_000).cast("bigint")}[unit]


# -- binning ---------------------------------------------------------------

def cut(value: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins, lowest edge included; outside the edges and null give null."""
    v = _col(value)
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    out = F.when(v < edges[0], None)
    for upper, label in zip(edges[1:], labels):
        out = out.when(v <= upper, label)
    return out


def age_band(age: str | Column) -> Column:
    return cut(age, S.AGE_EDGES, S.AGE_LABELS)


def amount_edges(low: float = S.AMOUNT_RANGE[0], high: float = S.AMOUNT_RANGE[1],
                 bins: int = S.AMOUNT_BINS) -> list[float]:
    """``bins`` equal steps from ``low`` to ``high``; the last edge is exactly ``high``."""
    step = (high - low) / bins
    return [low + i * step for i in range(bins)] + [high]


def amount_labels(edges: Sequence[float]) -> list[str]:
    return [f"{round(a)}–{round(b)}" for a, b in zip(edges, edges[1:])]


def dashboard_age_band(age: str | Column) -> Column:
    """Dashboard bands; whatever is outside 18 to 55 falls into the last one."""
    a = _col(age)
    out = F.when(a.isNull(), None)
    for low, high in ((18, 25), (26, 35), (36, 45), (46, 55)):
        out = out.when(a.between(low, high), f"{low}-{high}")
    return out.otherwise("56+")


# -- product combinations -----------------------------------------------------

def _owned(flags: Mapping[str, Column]) -> Column:
    return F.array_compact(F.array(*[
        F.when(F.coalesce(flags[name], F.lit(False)), F.lit(name)) for name in sorted(flags)
    ]))


def combo_label(flags: Mapping[str, Column]) -> Column:
    """None, the one product, the two joined in order of name, or the many-products word."""
    owned = _owned(flags)
    return (
        F.when(F.size(owned) == 0, S.COMBO_NONE)
        .when(F.size(owned) <= 2, F.array_join(owned, " + "))
        .otherwise(S.COMBO_MANY)
    )


def combo_listed(flags: Mapping[str, Column]) -> Column:
    """Only the listed combinations keep their label; every other one shares a word."""
    joined = F.array_join(_owned(flags), " + ")
    return F.when(joined.isin(S.COMBO_LISTED), joined).otherwise(S.COMBO_OTHER)


# -- best of a fixed set of columns ------------------------------------------

def first_named(values: Mapping[str, Column], top: Column) -> Column:
    """Name of the value equal to ``top``; on ties the first name in alphabetical order."""
    return F.coalesce(*[F.when(values[name] == top, F.lit(name)) for name in sorted(values)])


def all_named(values: Mapping[str, Column], top: Column) -> Column:
    """Names of all values equal to ``top`` joined with " + "; null when there is no ``top``."""
    names = F.concat_ws(" + ", *[F.when(values[name] == top, F.lit(name)) for name in sorted(values)])
    return F.when(top.isNotNull(), names)


# -- scores, text --------------------------------------------------------------

def priority_band(probability: str | Column, inclusive: bool = False) -> Column:
    """high / medium / low at 0.7 and 0.4; null is low. ``inclusive`` closes both bounds."""
    p = _col(probability)
    high, medium = (p >= 0.7, p >= 0.4) if inclusive else (p > 0.7, p > 0.4)
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def label_probability(probability: str | Column, threshold: float) -> Column:
    return (_col(probability) >= F.lit(threshold)).cast("int")


def income_lower_bound(text: str | Column, read_thousands: bool = False) -> Column:
    """Lower bound of an income text; what cannot be read gives the fixed fallback.

    A range such as ``30k-50k`` cannot be read by default, because only a range without ``k``
    or a single ``30k`` is understood; ``read_thousands`` reads the ``k`` in ranges as well.
    """
    plain = F.regexp_replace(_col(text), r"[$,]", "")
    low = F.trim(F.split_part(plain, F.lit("-"), F.lit(1)))

    def number(c: Column) -> Column:
        return c.try_cast("double")

    def thousands(c: Column) -> Column:
        return number(F.trim(F.replace(F.lower(c), F.lit("k"), F.lit("")))) * 1000

    in_range = (
        F.when(F.lower(low).contains("k"), thousands(low)).otherwise(number(low))
        if read_thousands else number(low)
    )
    value = (
        F.when(plain.contains("-"), in_range)
        .when(F.lower(plain).contains("k"), thousands(plain))
        .otherwise(number(plain))
    )
    return F.coalesce(value, F.lit(S.INCOME_FALLBACK))


def series_name(outcome: str | Column) -> Column:
    return F.initcap(F.replace(_col(outcome), F.lit("_"), F.lit(" ")))


def quarter_label(date: str | Column, with_year: bool = True) -> Column:
    q = F.concat(F.lit("T"), F.quarter(_col(date)).cast("string"))
    return F.concat(q, F.lit(" "), F.year(_col(date)).cast("string")) if with_year else q
