import datetime as dt

import pytest
from pyspark.sql import functions as F

from saleslens import schemas as S
from saleslens.plans import features as FE
from saleslens.plans import matrices as MX
from saleslens.plans import scoring as SC
from saleslens.plans import training as TR
from saleslens.plans.bundle import final_model, load_bundle
from saleslens.operators import evaluation as E

D = dt.date


@pytest.fixture(scope="module")
def tables(spark):
    people = [(f"u{i}", 18 + i % 50, S.INCOME_RANGES[i % 4], S.RISK_PROFILES[i % 3], f"job {i % 6}") for i in range(80)]
    names = ["checking_account", "savings_account", "credit_card", "insurance", "investment_account"]
    products = [(f"u{i}", names[(i + k) % 5], D(2020 + k, 1 + i % 12, 1)) for i in range(78) for k in range(1 + i % 2)]
    spend = [(f"t{i}-{k}", f"u{i}", D(2023, 1 + (i + k) % 12, 3), 10.0 + (i * 7 + k * 13) % 90,
              S.MERCHANT_CATEGORIES[(i * k) % 7], None) for i in range(77) for k in range(5)]
    return (spark.createDataFrame(people, S.DEMOGRAPHICS), spark.createDataFrame(products, S.PRODUCTS),
            spark.createDataFrame(spend, S.TRANSACTIONS))


def test_default_features(tables):
    df = FE.generate_features(*tables)
    assert df.columns == FE.OUTPUT and len(df.columns) == 32 and df.count() == 80
    stats = df.agg(F.avg("age").alias("m"), F.stddev_pop("age").alias("s")).first()
    assert stats["m"] == pytest.approx(0, abs=1e-9) and stats["s"] == pytest.approx(1)
    alone = df.where("user_id = 'u79'").first()
    assert alone["fecha_primer_producto_ts"] is None and alone["food_count"] is None
    assert not set(FE.LEAKY) & set(FE.generate_features(*tables, exclude_leaky=True).columns)


def test_missing_second_product_is_the_text_nan(tables):
    base = FE.default_base(*tables)
    words = sorted({r[0] or "nan" for r in base.select("segundo_producto").distinct().collect()})
    got = FE.generate_features(*tables).where("user_id = 'u0'").first()["segundo_producto"]
    assert words[got] == "nan"


def test_fitted_model_is_reused(tables):
    model = FE.FeatureModel.fit(FE.default_base(*tables))
    people, products, spend = tables
    few = people.where("age < 30")
    again = FE.generate_features(few, products, spend, model=model)
    full = FE.generate_features(*tables).join(few.select("user_id"), "user_id", "left_semi")
    columns = ["user_id", "income_range", "occupation", F.round("age", 9).alias("age")]
    assert again.select(*columns).exceptAll(full.select(*columns)).isEmpty() and again.count() == few.count()


@pytest.fixture(scope="module")
def general(tables):
    return FE.general_features(FE.cleaned_features(FE.raw_features(*tables)))


def test_matrices(general):
    assert not set(S.COLLINEAR_COLUMNS) & set(general.columns)
    for build in (MX.logistic_matrix, MX.forest_matrix, MX.boosted_matrix):
        df = build(general)
        assert df.count() == 80 and {"user_id", "insurance", "fecha_primer_producto_ts"} <= set(df.columns)
        assert not set(MX.DATE_COLUMNS) & set(df.columns)
    forest = MX.forest_matrix(general)
    assert forest.agg(F.max("age")).first()[0] == 67


@pytest.fixture(scope="module")
def matrix(general):
    return MX.boosted_matrix(general).drop(*FE.LEAKY_IN_MATRIX).fillna(0)


def test_weights_are_balanced(spark):
    df = spark.createDataFrame([(1.0,)] * 3 + [(0.0,)] * 9, "label double")
    got = {r["label"]: r["weight"] for r in TR.class_weights(df).distinct().collect()}
    assert got == {1.0: 2.0, 0.0: pytest.approx(12 / 18)}


def test_cross_validation_covers_every_row(matrix):
    names = TR.feature_names(matrix)
    df = TR.class_weights(TR.assembled(matrix, names))
    scores = TR.out_of_fold(TR.balanced_logistic(maxIter=5), df, folds=2)
    assert scores.count() == 80 and scores.where("score BETWEEN 0 AND 1").count() == 80
    means, cells = TR.cross_validated(TR.balanced_logistic(maxIter=5), df, folds=2)
    assert sum(cells.first()) == 80 and 0 <= means.first()["accuracy"] <= 1


def test_search_draws_different_settings():
    drawn = TR.drawn_settings(n=50)
    assert len(set(drawn)) == 50 and len(set(TR.drawn_settings(n=1000))) == 243
    assert all(getattr(s, k) in TR.SEARCH_SPACE[k] for s in drawn for k in TR.SEARCH_SPACE) and {s.trees for s in drawn} == {100, 200, 300}
    assert drawn != TR.drawn_settings(n=50, seed=1)


def test_importance_of_an_informative_feature(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("user_id"), (F.col("id") % 2).alias("insurance"),
                                 (F.col("id") % 2 * 2.0).alias("tells"), F.rand(3).alias("noise"))
    train = TR.assembled(df, ["tells", "noise"])
    model = TR.random_forest(numTrees=5).fit(train)
    assert TR.importances(model, ["tells", "noise"]).first()["feature"] == "tells"
    got = TR.permutation_importance(lambda t: TR.scored(model, TR.assembled(t, ["tells", "noise"], key="feature"), key="feature"),
                                    df, ["noise", "tells"], rows_per_bucket=120)
    rows = got.collect()
    assert rows[0]["feature"] == "tells" and rows[0]["auc_loss"] > 0.3 and abs(rows[1]["auc_loss"]) < 0.1


def test_save_load_score_merge(matrix, spark, tmp_path):
    names = TR.feature_names(matrix)
    ready = TR.class_weights(TR.ready(matrix, names))
    model = TR.pipeline(names, TR.boosted_trees(maxIter=2)).fit(ready)
    TR.save_model(model, 0.3, str(tmp_path))
    loaded, threshold = TR.load_model(str(tmp_path))
    assert threshold == 0.3 and SC.model_columns(loaded) == names
    scores = SC.batch_scores(loaded, matrix.drop("age"), threshold, "2024-01-01")
    assert scores.columns == ["user_id", "probability", "is_target", "created_at"] and scores.count() == 80
    stored = spark.createDataFrame([("u1", 0.0, False, None), ("gone", 0.2, False, None)], S.PREDICTIONS)
    merged = SC.score_and_merge(loaded, matrix, stored, threshold, "2024-01-01")
    assert merged.count() == 81 and merged.where("user_id = 'gone'").first()["probability"] == 0.2
    assert E.class_balance(ready).count() == 2


def test_bundle_scores_a_later_batch_as_before(tables, tmp_path):
    people, products, spend = tables
    bundle, report = final_model(FE.default_base(*tables), TR.boosted_trees(maxIter=2))
    assert report.where("threshold = 0.5").count() == 5
    bundle.save(str(tmp_path))
    loaded = load_bundle(str(tmp_path))
    assert loaded.threshold == bundle.threshold and loaded.features.scaler == bundle.features.scaler
    later = FE.default_base(people.where("age < 30"), products, spend)
    full = bundle.score(FE.default_base(*tables), "2024-01-01")
    again = loaded.score(later, "2024-01-01")
    assert again.count() == later.count() and again.exceptAll(full).isEmpty()


def test_boosted_trees_find_an_informative_feature(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("user_id"), (F.col("id") % 3 == 0).alias("insurance"),
                                 (F.col("id") % 3).alias("tells"), F.rand(3).alias("noise"))
    rows = TR.assembled(df, ["tells", "noise"])
    for estimator in (TR.boosted_trees(maxIter=5), TR.random_forest(numTrees=5)):
        got = E.metrics(TR.scored(estimator.fit(rows.where("user_id % 2 = 0")), rows.where("user_id % 2 = 1"))).first()
        assert got["accuracy"] > 0.95


def test_registered_search_is_the_whole_one(spark, monkeypatch):
    from saleslens.catalog import QUERIES

    seen = {}
    whole = TR.boosting.held_out_scores

    def recorded(data, settings, folds):
        seen.update(settings=settings, folds=folds)
        return whole(data, [TR.boosting.Setting(trees=1, depth=1, seed=i) for i in range(len(settings))], folds)

    monkeypatch.setattr(TR.boosting, "held_out_scores", recorded)
    out = QUERIES["m07_random_search"](spark, "/root/testdata/sf0.001").collect()
    assert seen["folds"] == 5 and seen["settings"] == TR.drawn_settings()
    assert len(out) == 250 and len({(r.trees, r.depth, r.rate, r.rows, r.columns) for r in out}) == 50 and len({r.fold for r in out}) == 5


def test_search_against_separate_fits(spark):
    from saleslens.plans import boosting as B

    df = spark.range(200).select(
        F.col("id").cast("string").alias("user_id"), ((F.col("id") * 7 % 10 + F.rand(1) * 6) > 7).cast("double").alias("label"),
        (F.col("id") % 5).cast("int").alias("fold"), (F.col("id") * 7 % 10).alias("x"), F.rand(2).alias("z")).cache()
    settings = [B.Setting(trees=3), B.Setting(trees=6), B.Setting(trees=4, depth=2, rows=0.5)]
    found = TR.random_search(df, ["x", "z"], settings)
    got = {(r["setting"], r["fold"]): r["roc_auc"] for r in found.collect()}
    data = B.binned(df, ["x", "z"], fold="fold")
    for s, setting in enumerate(settings):
        for fold in (0, 3):
            alone = E.areas(B.scored(B.fit(data, setting, fold), df.where(F.col("fold") == fold))).first()["roc_auc"]
            assert got[s, fold] == pytest.approx(alone)
    means = TR.search_means(found).collect()
    assert [r["roc_auc"] for r in means] == sorted((sum(got[s, f] for f in range(5)) / 5 for s in range(3)), reverse=True)


def test_scores_of_a_search_are_written_by_training_only(spark, monkeypatch):
    df = spark.range(60).select(F.col("id").cast("string").alias("user_id"), (F.col("id") % 2).cast("double").alias("label"),
                                (F.col("id") % 5).cast("int").alias("fold"), (F.col("id") % 7).alias("x"))
    written = []
    monkeypatch.setattr(TR, "durable", lambda table: written.append(table.columns) or table)
    assert TR.random_search(df, ["x"], [TR.boosting.Setting(trees=2)]).count() == 5
    assert written == []


def test_exchange_keeps_the_values_of_each_feature(spark):
    df = spark.range(700).select(F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("user_id"),
                                 F.col("id").alias("x"), (F.col("id") * 2).alias("y"), (F.col("id") % 4).alias("group"))
    rows = TR.exchanged(df, ["x", "y"], rows_per_bucket=64).toPandas()
    for f in ("", "x", "y"):
        own = rows[rows.feature == f]
        assert sorted(own.x) == list(range(700)) and sorted(own.y) == list(range(0, 1400, 2)) and len(own) == 700
    assert (rows[rows.feature == ""].y == 2 * rows[rows.feature == ""].x).all()
    assert (rows[rows.feature == "x"].y != 2 * rows[rows.feature == "x"].x).all()  # every row has the value of another one
    assert (rows[rows.feature == "x"].y % 8 // 2 == rows[rows.feature == "x"].group).all()
    assert TR.exchanged(df.limit(1), ["x"]).count() == 2 and TR.exchanged(df.limit(0), ["x"]).count() == 0


def test_exchange_has_one_shuffle_whatever_the_features(spark):
    df = spark.range(100).select("id", *[F.rand(i).alias(f"f{i}") for i in range(12)])
    for n in (1, 12):
        plan = TR.exchanged(df, [f"f{i}" for i in range(n)], rows_per_bucket=10)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_training_rows_fill_every_core(tables, spark, monkeypatch):
    from saleslens.plans import bundle

    class Seen(Exception):
        pass

    class Fake:
        def fit(self, rows):
            raise Seen(rows.groupBy(F.spark_partition_id()).count().count())

    monkeypatch.setattr(bundle, "pipeline", lambda names, estimator: Fake())
    with pytest.raises(Seen) as seen:
        bundle.final_model(FE.default_base(*tables))
    assert seen.value.args[0] == spark.sparkContext.defaultParallelism


def test_folds_fill_every_core(matrix, spark, monkeypatch):
    seen = []

    class Fake:
        def fit(self, rows):
            seen.append(rows.groupBy(F.spark_partition_id()).count().count())

    monkeypatch.setattr(TR, "scored", lambda model, rows, key: rows)
    TR.out_of_fold(Fake(), TR.assembled(matrix, TR.feature_names(matrix)), folds=2)
    assert seen == [spark.sparkContext.defaultParallelism] * 2


def test_exchanged_rows_are_scored_without_a_copy(spark, monkeypatch):
    written = []
    monkeypatch.setattr(TR, "durable", lambda df: written.append(df.columns) or df)
    df = spark.range(50).select(F.col("id").cast("string").alias("user_id"), (F.col("id") % 2).cast("double").alias("label"), F.col("id").alias("x"))
    got = TR.permutation_importance(lambda t: t.select("feature", "label", F.col("x").cast("double").alias("score")), df, ["x"])
    assert got.count() == 1 and ["feature", "label", "score"] not in written


def test_exchanged_rows_come_from_every_core(spark, monkeypatch):
    df = spark.range(4000).select(F.col("id").cast("string").alias("user_id"), F.col("id").alias("x"), F.col("id").alias("y"))

    def tasks():
        rows = TR.exchanged(df, ["x", "y"], rows_per_bucket=20)
        assert rows.count() == 12000 and rows.where("feature = 'x'").agg(F.sum("x")).first()[0] == 7998000
        return rows.groupBy(F.spark_partition_id()).count().count()

    assert tasks() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(TR, "ROWS_PER_TASK", 1000)
    assert tasks() == 12
