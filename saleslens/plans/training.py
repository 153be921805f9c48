"""Training and model selection; metrics come from the evaluation operators.

Linear models and forests are MLlib's. Boosted trees as they are searched, curved and explained are those of
``boosting``: second-order gains, columns drawn per tree. MLlib's boosted trees remain for pipelines.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from hashlib import md5
from itertools import product

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.operators.evaluation import areas, confusion, metrics, stratified_folds
from saleslens.operators.ranks import bucket_by_hash
from saleslens.plans import boosting
from saleslens.session import durable, evenly

# The searched hyper-parameters, by the names of ``boosting.Setting``.
SEARCH_SPACE = {
    "trees": [100, 200, 300],
    "depth": [3, 5, 7],
    "rate": [0.01, 0.1, 0.2],
    "rows": [0.5, 0.7, 1.0],
    "columns": [0.5, 0.7, 1.0],
}

#: Rows that a task of ``exchanged`` gives, about.
ROWS_PER_TASK = 500_000


def boosted_trees(**params: object) -> GBTClassifier:
    settings = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.2, "subsamplingRate": 1.0,
                "featureSubsetStrategy": "0.7", "seed": 42, **params}
    return GBTClassifier(featuresCol="features", labelCol="label", **settings)


def balanced_logistic(**params: object) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", **params)


def random_forest(**params: object) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="label", **{"numTrees": 100, "seed": 42, **params})


def feature_names(df: DataFrame, skip: Sequence[str] = ("user_id", "insurance", "label", "weight", "fold", "is_test")) -> list[str]:
    return [c for c in df.columns if c not in skip]


def ready(df: DataFrame, features: Sequence[str], target: str = "insurance", key: str = "user_id") -> DataFrame:
    """(key, label, the features as doubles); missing values, and the target of who owns nothing, are 0."""
    return df.select(
        key, F.coalesce(F.col(target).cast("int").cast("double"), F.lit(0.0)).alias("label"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])


def assembled(df: DataFrame, features: Sequence[str], target: str = "insurance", key: str = "user_id") -> DataFrame:
    """(key, label, features) with the features in one vector."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return assembler.transform(ready(df, features, target, key)).select(key, "label", "features")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` = rows / (classes x rows of the class)."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(weight)
    return df.withColumn("weight", weight)


def scored(model: Model, df: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, label, score) with the probability of class 1."""
    out = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return out.select(key, *[c for c in ("label", "fold") if c in df.columns], "score")


def out_of_fold(estimator: Estimator, df: DataFrame, folds: int = 5, seed: int = 42, key: str = "user_id",
                order_key: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Score of every row by a model that has not seen its fold."""
    folded = durable(evenly(stratified_folds(df, key, folds=folds, seed=seed, order_key=order_key, bucket=bucket)))
    parts = None
    for i in range(folds):
        model = estimator.fit(folded.where(F.col("fold") != i))
        part = scored(model, folded.where(F.col("fold") == i), key)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def cross_validated(estimator: Estimator, df: DataFrame, folds: int = 5, seed: int = 42, threshold: float = 0.5, key: str = "user_id",
                    order_key: Column | None = None, bucket: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Mean of the fold metrics in one row, and the confusion matrix of all held-out rows."""
    held_out = durable(out_of_fold(estimator, df, folds, seed, key, order_key, bucket))
    means = fold_metrics(held_out, threshold).agg(*[F.avg(c).alias(c) for c in ("roc_auc", "accuracy", "precision", "recall", "f1_score")])
    return means, confusion(held_out, threshold=threshold)


def fold_metrics(held_out: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(fold, n, positives, metrics and areas) of scores with a fold."""
    sizes = held_out.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives"))
    return sizes.join(metrics(held_out, threshold=threshold, by=["fold"]), "fold").join(areas(held_out, by=["fold"]), "fold")


def drawn_settings(space: Mapping[str, Sequence] = SEARCH_SPACE, n: int = 50, seed: int = 42) -> list[boosting.Setting]:
    """``n`` different settings from the whole grid, in the order of a digest of their place in it."""
    grid = [dict(zip(space, values)) for values in product(*space.values())]
    order = sorted(range(len(grid)), key=lambda i: md5(f"{i}:{seed}".encode()).hexdigest())
    return [boosting.Setting(**grid[i]) for i in order[:n]]


def random_search(folded: DataFrame, features: Sequence[str], settings: Sequence[boosting.Setting], folds: int = 5,
                  key: str = "user_id") -> DataFrame:
    """(setting, the fields of the settings, fold, n, positives, roc_auc): held-out area of every setting on every fold.

    ``folded`` has a label and a fold from 0. All models are trained together; settings that differ in the
    number of trees share one. Means over the folds rank the settings (``search_means``).
    """
    data = boosting.binned(folded, features, key, fold="fold")
    scores = boosting.held_out_scores(data, settings, folds)  # written already, the join is by a row for each model
    groups = ["setting", "fold"]
    measured = areas(scores, by=groups).select(*groups, "roc_auc").join(
        scores.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives")), groups)
    names = list(SEARCH_SPACE)
    listed = folded.sparkSession.createDataFrame(
        [(i, *(getattr(s, n) for n in names)) for i, s in enumerate(settings)], "setting int, trees int, depth int, rate double, rows double, columns double")
    return measured.join(F.broadcast(listed), "setting").select("setting", *names, "fold", "n", "positives", "roc_auc")  # a row per setting


def search_means(found: DataFrame) -> DataFrame:
    """(setting, its fields, mean area over the folds), best first; the first listed setting on ties."""
    return found.groupBy("setting", *SEARCH_SPACE).agg(F.avg("roc_auc").alias("roc_auc")).orderBy(F.desc("roc_auc"), "setting")


def boosted_learning_curve(folded: DataFrame, features: Sequence[str], setting: boosting.Setting, sizes: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0),
                           folds: int = 5, key: str = "user_id") -> DataFrame:
    """(size, fold, n of validation rows, train_rows, train_auc, validation_auc) of nested training samples, all models in the same passes."""
    data = boosting.binned(folded, features, key, fold="fold")
    plans = [boosting.Plan(setting, i, (setting.trees,), size, both=True) for size in sizes for i in range(folds)]
    scores = durable(boosting.scores_of(data, plans))
    groups = ["plan", "trained"]
    measured = scores.groupBy(*groups).agg(F.count("*").alias("n")).join(areas(scores, by=groups), groups, "left")
    listed = folded.sparkSession.createDataFrame([(p, float(plan.part), plan.fold) for p, plan in enumerate(plans)], "plan int, size double, fold int")
    trained = F.col("trained")
    return measured.join(F.broadcast(listed), "plan").groupBy("size", "fold").agg(  # a row per plan
        F.sum(F.when(~trained, F.col("n"))).alias("n"), F.coalesce(F.sum(F.when(trained, F.col("n"))), F.lit(0)).alias("train_rows"),
        F.max(F.when(trained, F.col("roc_auc"))).alias("train_auc"), F.max(F.when(~trained, F.col("roc_auc"))).alias("validation_auc"))


def learning_curve(estimator: Estimator, df: DataFrame, sizes: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 5, seed: int = 42,
                   key: str = "user_id", part: Column | None = None, order_key: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Training and validation area by size of the training set.

    The samples are nested: a row is in a sample when ``part``, by default from a hash of its key, is below its size.
    """
    own = F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(1_000_000)) / 1e6 if part is None else part
    folded = durable(stratified_folds(df, key, folds=folds, seed=seed, order_key=order_key, bucket=bucket).withColumn("_part", own))
    outcomes = None
    for size in sizes:
        for i in range(folds):
            train = folded.where((F.col("fold") != i) & (F.col("_part") < size))
            model = estimator.fit(train)
            for part, rows in (("train", train), ("validation", folded.where(F.col("fold") == i))):
                one = scored(model, rows, key).select(
                    F.lit(float(size)).alias("size"), F.lit(i).alias("fold"), F.lit(part).alias("part"), "label", "score")
                outcomes = one if outcomes is None else outcomes.unionByName(one)
    outcomes = durable(outcomes)
    groups = ["size", "fold", "part"]
    measured = areas(outcomes, by=groups).join(outcomes.groupBy(*groups).agg(F.count("*").alias("_n")), groups)
    in_training = F.col("part") == "train"
    return measured.groupBy("size").agg(
        F.avg(F.when(in_training, F.col("_n"))).alias("train_rows"),
        F.avg(F.when(in_training, F.col("roc_auc"))).alias("train_auc"),
        F.avg(F.when(~in_training, F.col("roc_auc"))).alias("validation_auc"),
    ).orderBy("size")


def importances(model: Model, features: Sequence[str]) -> DataFrame:
    """Importance of every feature, largest first."""
    values = (float(v) for v in model.featureImportances.toArray())
    rows = sorted(zip(features, values), key=lambda r: -r[1])
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def exchanged(table: DataFrame, features: Sequence[str], seed: int = 42, rows_per_bucket: int = 1000) -> DataFrame:
    """Every row once for each feature, with the value of that feature taken from another row, and once as it is (feature '').

    Rows are dealt to buckets by a hash and put in its order. In a bucket the values of each feature
    move on by a number of places of its own, so one exchange serves all features and each keeps its values.
    A bucket holds about ``rows_per_bucket`` rows, also where keys repeat, as rows are told apart by their place.
    """
    marked = durable(table)
    total = marked.count()
    bits = max(0, (-(-total // rows_per_bucket) - 1).bit_length())
    # Tasks follow the rows that come out, which are many more than those that are shuffled.
    pieces = max(table.sparkSession.sparkContext.defaultParallelism, -(-total * (len(features) + 1) // ROWS_PER_TASK))
    hashed = F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))
    others = [c for c in table.columns if c not in features]
    whole = F.struct(F.col("_hash").alias("h"), *[F.col(c).alias(f"c{i}") for i, c in enumerate([*others, *features])])
    buckets = (
        marked.withColumn("_hash", hashed).withColumn("_bucket", bucket_by_hash(F.col("_hash"), bits) if bits else F.lit(0))
        .repartition(pieces, "_bucket").groupBy("_bucket")
        .agg(F.array_sort(F.collect_list(whole)).alias("_rows"))
    )
    n = F.size("_rows")

    def given(i: Column, j: int) -> Column:
        step = F.when(n > 1, 1 + F.pmod(F.xxhash64("_bucket", F.lit(seed + 1 + j)), F.greatest(n - 1, F.lit(1)))).otherwise(0)
        return F.col("_rows")[((i + step) % n).cast("int")][f"c{len(others) + j}"]

    moved = F.transform("_rows", lambda row, i: F.struct(
        row.alias("own"), *[given(i, j).alias(f"g{j}") for j in range(len(features))]))
    rows = buckets.select(F.explode(moved).alias("_r")).select("_r.*")
    long = rows.select("*", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))).alias("_j"))
    names = F.array(F.lit(""), *[F.lit(f) for f in features])
    return long.select(
        names[F.col("_j") + 1].alias("feature"), *[F.col(f"own.c{i}").alias(c) for i, c in enumerate(others)],
        *[F.when(F.col("_j") == j, F.col(f"g{j}")).otherwise(F.col(f"own.c{len(others) + j}")).alias(f) for j, f in enumerate(features)])


def permutation_importance(model_of: Callable[[DataFrame], DataFrame], table: DataFrame, features: Sequence[str],
                           seed: int = 42, rows_per_bucket: int = 1000) -> DataFrame:
    """Loss of area when one feature at a time is exchanged between rows, largest loss first.

    ``model_of`` gives (feature, label, score) for the table of ``exchanged``: all features are scored in one pass.
    """
    outcomes = model_of(exchanged(table, features, seed, rows_per_bucket)).select("feature", "label", "score")  # read once
    measured = {r["feature"]: r["roc_auc"] for r in areas(outcomes, by=["feature"]).collect()}
    rows = sorted(((f, None if measured.get("") is None else measured[""] - measured[f]) for f in features), key=lambda r: -(r[1] or 0.0))
    return table.sparkSession.createDataFrame(rows, "feature string, auc_loss double")


def without_features(estimator: Estimator, table: DataFrame, dropped: Sequence[str], target: str = "insurance", folds: int = 5, seed: int = 42,
                     order_key: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """(fold, n, positives, metrics and areas, features) after leaving out a list of columns."""
    kept = table.drop(*dropped)
    names = feature_names(kept)
    held_out = durable(out_of_fold(estimator, assembled(kept, names, target), folds, seed, order_key=order_key, bucket=bucket))
    return fold_metrics(held_out).withColumn("features", F.lit(len(names)))


def save_model(model: PipelineModel, threshold: float, folder: str) -> None:
    """Model and threshold side by side; an earlier model at the place is replaced."""
    model.write().overwrite().save(f"{folder}/model")
    row = SparkSession.active().createDataFrame([(float(threshold),)], "threshold double")
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/threshold")


def load_model(folder: str) -> tuple[PipelineModel, float]:
    threshold = SparkSession.active().read.schema("threshold double").parquet(f"{folder}/threshold").first()[0]
    return PipelineModel.load(f"{folder}/model"), threshold


def pipeline(features: Sequence[str], estimator: Estimator) -> Pipeline:
    """Assembler and estimator in one, so that the saved model knows its columns."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), estimator])
