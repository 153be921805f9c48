"""Batch scoring: align to the model, score, label, merge into the stored predictions."""

from __future__ import annotations

import logging

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslens import schemas as S
from saleslens.operators.cleaning import align_columns, schema_differences, to_double
from saleslens.operators.merge import upsert_predictions

log = logging.getLogger(__name__)


def model_columns(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def batch_scores(model: PipelineModel, features: DataFrame, threshold: float = S.SERVICE_THRESHOLD,
                 as_of: str | None = None) -> DataFrame:
    """(user_id, probability, is_target, created_at) of every customer of the feature table.

    Columns are brought to those of the model; missing ones are logged and 0. A failure is an
    error here, never a made-up score.
    """
    expected = model_columns(model)
    differences = schema_differences(features.drop("user_id", S.TARGET), expected)
    for kind, names in differences.items():
        if names:
            log.warning("%s columns: %s", kind, names)
    aligned = to_double(align_columns(features, expected, keys=["user_id"])).fillna(0.0, expected)
    probability = vector_to_array("probability")[1]
    created = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return model.transform(aligned).select(
        "user_id", probability.alias("probability"),
        (probability >= F.lit(threshold)).alias("is_target"), created.alias("created_at"))


def score_and_merge(model: PipelineModel, features: DataFrame, stored: DataFrame,
                    threshold: float = S.SERVICE_THRESHOLD, as_of: str | None = None) -> DataFrame:
    """New content of the prediction table."""
    return upsert_predictions(stored, batch_scores(model, features, threshold, as_of))
