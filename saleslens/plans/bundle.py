"""A trained model together with the moments and dictionaries its features were fitted with.

A later batch is scaled and coded by what was learned in training, so codes and scales do not shift
under the model.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens import schemas as S
from saleslens.operators.encode import LabelEncoder, StandardScaler
from saleslens.operators.evaluation import best_threshold, compare_thresholds, stratified_split
from saleslens.plans.features import LEAKY, FeatureModel
from saleslens.plans.scoring import batch_scores
from saleslens.plans.training import (
    boosted_trees, class_weights, feature_names, load_model, pipeline, ready, save_model, scored)
from saleslens.session import durable, evenly

MOMENTS = "column string, mean double, deviation double"
LABELS = "column string, label string, code int"
SETTINGS = "missing string, encoded array<string>"


@dataclass(frozen=True)
class Bundle:
    features: FeatureModel
    model: PipelineModel
    threshold: float

    def score(self, base: DataFrame, as_of: str | None = None) -> DataFrame:
        """(user_id, probability, is_target, created_at) of a table as ``default_base`` gives it."""
        return batch_scores(self.model, self.features.transform(base), self.threshold, as_of)

    def save(self, folder: str) -> None:
        """Dictionaries are written as one table of any length; the rest is small."""
        spark = SparkSession.active()
        moments = [(c, float(m), float(d)) for c, (m, d) in self.features.scaler.stats.items()]
        labels = self.features.labels
        parts = [t.select(F.lit(c).alias("column"), "label", "code") for c, t in labels.tables.items()]
        coded = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], LABELS)
        coded.write.mode("overwrite").parquet(f"{folder}/labels")
        spark.createDataFrame(moments, MOMENTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/moments")
        spark.createDataFrame([(labels.missing, list(labels.tables))], SETTINGS).coalesce(1).write.mode(
            "overwrite").parquet(f"{folder}/settings")
        save_model(self.model, self.threshold, folder)


def load_bundle(folder: str) -> Bundle:
    spark = SparkSession.active()
    moments = spark.read.schema(MOMENTS).parquet(f"{folder}/moments").collect()  # a row per scaled column
    settings = spark.read.schema(SETTINGS).parquet(f"{folder}/settings").first()
    coded = spark.read.schema(LABELS).parquet(f"{folder}/labels")
    tables = {c: coded.where(F.col("column") == c).select("label", "code") for c in settings["encoded"]}
    features = FeatureModel(StandardScaler({r["column"]: (r["mean"], r["deviation"]) for r in moments}),
                            LabelEncoder(tables, settings["missing"]))
    return Bundle(features, *load_model(folder))


def final_model(base: DataFrame, estimator: Estimator | None = None, dropped: Sequence[str] = LEAKY,
                test_fraction: float = 0.3, seed: int = 42) -> tuple[Bundle, DataFrame]:
    """Fit features and model, take the threshold with the best F1 on the test rows.

    The report compares 0.5 with that threshold on the test rows. ``cross_validated`` gives the
    metrics over all rows at the threshold found.
    """
    base = durable(base)
    features = FeatureModel.fit(base)
    table = features.transform(base).drop(*dropped)
    names = feature_names(table)
    weighted = class_weights(durable(ready(table, names)))  # counted, ranked and joined
    rows = durable(evenly(stratified_split(weighted, "user_id", test_fraction=test_fraction, seed=seed)))
    model = pipeline(names, estimator or boosted_trees()).fit(rows.where("NOT is_test"))
    held_out = durable(scored(model, rows.where("is_test")))
    best = best_threshold(held_out).first()["threshold"]
    threshold = S.SERVICE_THRESHOLD if best is None else best
    return Bundle(features, model, threshold), compare_thresholds(held_out, [S.SERVICE_THRESHOLD, threshold])
