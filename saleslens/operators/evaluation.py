"""Splits, curves and metrics from a label column and a score column.

Rows are summed to one per score before any order is taken, and orders run through the bucketed
running totals, so neither a hot score nor one of two classes ends up in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslens.operators.ranks import bucket_by_value, hashed_rank, running_totals
from saleslens.session import durable


# -- balance and splits -------------------------------------------------------

def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def _order(key: str, seed: int, order_key: Column | None) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed)) if order_key is None else order_key


def stratified_split(df: DataFrame, key: str, label: str = "label", test_fraction: float = 0.3,
                     seed: int = 42, order_key: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Add ``is_test``: the given part of every class, chosen by a hash of the key."""
    ranked = hashed_rank(df, _order(key, seed, order_key), [key], [label], bucket)
    size = F.floor(F.col("rank_all") * F.lit(test_fraction) + 0.5)
    return ranked.withColumn("is_test", F.col("rank") <= size).drop("rank", "rank_all")


def stratified_folds(df: DataFrame, key: str, label: str = "label", folds: int = 5, seed: int = 42,
                     order_key: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Add ``fold`` from 0; per class the folds differ by one row at most."""
    ranked = hashed_rank(df, _order(key, seed, order_key), [key], [label], bucket)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % folds).cast("int")).drop("rank", "rank_all")


# -- metrics at a threshold -----------------------------------------------------

def _cells(score: str, label: str, threshold: float, suffix: str = "") -> list[Column]:
    said, true = F.col(score) >= F.lit(threshold), F.col(label) == 1
    return [
        F.count_if(~said & ~true).alias(f"tn{suffix}"),
        F.count_if(said & ~true).alias(f"fp{suffix}"),
        F.count_if(~said & true).alias(f"fn{suffix}"),
        F.count_if(said & true).alias(f"tp{suffix}"),
    ]


def confusion(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5,
              by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp; one row, or one per group of ``by``."""
    return df.groupBy(*by).agg(*_cells(score, label, threshold))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return precision, recall, _ratio(2 * precision * recall, precision + recall)


def metrics(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5,
            by: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall and F1; an empty denominator gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall, f1 = _prf(tp, fp, fn)
    return confusion(df, score, label, threshold, by).select(
        *by, _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1_score"))


def _report_rows(suffix: str = "") -> Column:
    tn, fp, fn, tp = (F.col(f"{c}{suffix}") for c in ("tn", "fp", "fn", "tp"))
    p1, r1, f1 = _prf(tp, fp, fn)
    p0, r0, f0 = _prf(tn, fn, fp)
    n1, n0 = tp + fn, tn + fp
    everything = n0 + n1
    accuracy = _ratio(tp + tn, everything)

    def row(name: str, precision: Column, recall: Column, f: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("clase"), precision.alias("precision"), recall.alias("recall"),
                        f.alias("f1"), support.alias("support"))

    def weighted(a: Column, b: Column) -> Column:
        return _ratio(a * n0 + b * n1, everything)

    return F.array(
        row("0", p0, r0, f0, n0), row("1", p1, r1, f1, n1),
        row("accuracy", accuracy, accuracy, accuracy, everything),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, everything),
        row("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), everything),
    )


def classification_report(df: DataFrame, score: str = "score", label: str = "label",
                          threshold: float = 0.5) -> DataFrame:
    """Per class and averaged precision, recall, F1 and support, from four counts."""
    counted = confusion(df, score, label, threshold)
    return counted.select(F.explode(_report_rows()).alias("r")).select("r.*")


def compare_thresholds(df: DataFrame, thresholds: Sequence[float], score: str = "score",
                       label: str = "label") -> DataFrame:
    """The report at several thresholds, all counted in the same pass."""
    counted = df.agg(*[c for i, t in enumerate(thresholds) for c in _cells(score, label, t, f"_{i}")])
    per_threshold = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tn_{i}").alias("tn"), F.col(f"fp_{i}").alias("fp"),
                 F.col(f"fn_{i}").alias("fn"), F.col(f"tp_{i}").alias("tp")) for i, t in enumerate(thresholds)
    ])
    rows = counted.select(F.explode(per_threshold).alias("t")).select("t.*")
    return rows.select("*", F.explode(_report_rows()).alias("r")).select(*rows.columns, "r.*")


# -- curves ---------------------------------------------------------------------

def cumulative(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Per score, in falling order: true and false positives at or above it."""
    per_score = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg"))
    return running_totals(bucket_by_value(durable(per_score), "threshold"), {"tp": "_pos", "fp": "_neg"},
                          [F.col("threshold").desc()], by, bucket_order="desc")


def roc_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, fpr, tpr) per distinct score; the point (0, 0) is not listed."""
    return cumulative(df, score, label).select(
        "threshold", _ratio(F.col("fp"), F.col("fp_all")).alias("fpr"),
        _ratio(F.col("tp"), F.col("tp_all")).alias("tpr"))


def pr_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, precision, recall) per distinct score; the point (recall 0, 1) is not listed."""
    return cumulative(df, score, label).select(
        "threshold", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("tp_all")).alias("recall"))


def areas(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid areas under the ROC and the precision-recall curve, null with one class only.

    The point before each score follows from its own counts, so no row looks at another one.
    """
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "_pos", "_neg"))
    tp0, fp0 = tp - pos, fp - neg
    precision = _ratio(tp, tp + fp)
    precision0 = F.coalesce(F.try_divide(tp0.cast("double"), tp0 + fp0), F.lit(1.0))
    return cumulative(df, score, label, by).groupBy(*by).agg(
        F.sum(neg.cast("decimal(18,0)") * (tp + tp0).cast("decimal(19,0)")).alias("_roc"),
        F.sum(pos * (precision + precision0)).alias("_pr"),
        F.max("tp_all").alias("_p"), F.max("fp_all").alias("_n"),
    ).select(
        *by, F.try_divide(F.col("_roc").cast("double") / 2.0, F.col("_p").cast("double") * F.col("_n")).alias("roc_auc"),
        F.try_divide(F.col("_pr") / 2.0, F.col("_p")).alias("pr_auc"),
    )


def best_threshold(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Score with the largest F1 as a threshold, the lowest on ties."""
    tp, fp = F.col("tp"), F.col("fp")
    f1 = _ratio(2 * tp, tp + fp + F.col("tp_all"))
    return cumulative(df, score, label).select("threshold", f1.alias("f1")).agg(
        F.min(F.struct((-F.col("f1")).alias("v"), F.col("threshold").alias("t"))).alias("b")
    ).select(F.col("b")["t"].alias("threshold"), (-F.col("b")["v"]).alias("f1"))


def precision_at_top(df: DataFrame, key: str, fraction: float = 0.2, score: str = "score",
                     label: str = "label", seed: int = 42, order_key: Column | None = None,
                     bucket: Column | None = None) -> DataFrame:
    """Part of positives among the best-scored ``fraction`` of rows, in one row.

    All rows above the cut score count; of the rows at it, as many as are missing, in the order
    of a hash of their key. The cut (one row) is read first, so that only its rows are ranked.
    """
    scored = df.where(F.col(score).isNotNull())
    per_score = scored.groupBy(F.col(score).alias("_score")).agg(
        F.count("*").alias("_rows"), F.count_if(F.col(label) == 1).alias("_pos"))
    run = running_totals(bucket_by_value(durable(per_score), "_score"), {"_upto": "_rows", "_positive": "_pos"},
                         [F.col("_score").desc()], bucket_order="desc")
    wanted = F.ceil(F.col("_upto_all") * F.lit(fraction))
    cut = run.where((F.col("_upto") - F.col("_rows") < wanted) & (wanted <= F.col("_upto"))).select(
        "_score", wanted.alias("k"), (wanted - F.col("_upto") + F.col("_rows")).alias("missing"),
        (F.col("_positive") - F.col("_pos")).alias("above")).first()
    if cut is None:
        return df.sparkSession.createDataFrame([(0, 0, None)], "k bigint, positivos bigint, precision double")
    at_cut = hashed_rank(scored.where(F.col(score) == F.lit(cut["_score"])),
                         _order(key, seed, order_key), [key], bucket=bucket)
    chosen = (F.col("rank") <= F.lit(cut["missing"])) & (F.col(label) == 1)
    return at_cut.agg((F.lit(cut["above"]) + F.count_if(chosen)).alias("positivos")).select(
        F.lit(cut["k"]).cast("bigint").alias("k"), "positivos", _ratio(F.col("positivos"), F.lit(cut["k"])).alias("precision"))
