"""Splits, metrics, curves, training, scoring and the streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from saleslens import schemas as S
from saleslens.catalog.base import Tables, over, query, rounded
from saleslens.catalog.profiling import general
from saleslens.operators import evaluation as E
from saleslens.plans import attribution as AT
from saleslens.plans import boosting as BO
from saleslens.plans import scoring as SC
from saleslens.plans import training as TR
from saleslens.session import durable, scratch

HASH_SQL = "(id * 7919 + 42) % 1000003"


def _hash():
    """An order both engines can compute; the library's own default is a 64-bit hash."""
    return (F.col("id") * 7919 + 42) % 1000003


def _hash_bucket():
    return F.floor(_hash() / 1000)


@query("m19_class_balance", over("scored") + "SELECT label, count(*) AS n FROM scored GROUP BY label")
def balance(spark, sf_dir):
    return E.class_balance(Tables(spark, sf_dir).scored)


RANKED = f"""r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH_SQL}, id) AS rank,
 count(*) OVER (PARTITION BY label) AS n FROM scored)"""


@query("m04_stratified_split", over("scored", more=RANKED) + """
SELECT id, score, label, rank <= floor(n * 0.3::DOUBLE + 0.5) AS is_test FROM r""")
def split(spark, sf_dir):
    return E.stratified_split(Tables(spark, sf_dir).scored, "id", order_key=_hash(), bucket=_hash_bucket())


@query("m05_stratified_folds", over("scored", more=RANKED) + """
SELECT id, score, label, CAST((rank - 1) % 5 AS INTEGER) AS fold FROM r""")
def folds(spark, sf_dir):
    return E.stratified_folds(Tables(spark, sf_dir).scored, "id", order_key=_hash(), bucket=_hash_bucket())


CELLS = """count(*) FILTER (score < {t} AND label = 0) AS tn, count(*) FILTER (score >= {t} AND label = 0) AS fp,
 count(*) FILTER (score < {t} AND label = 1) AS fn, count(*) FILTER (score >= {t} AND label = 1) AS tp"""


@query("m09_confusion", over("scored") + "SELECT " + CELLS.format(t=0.5) + " FROM scored")
def confusion(spark, sf_dir):
    return E.confusion(Tables(spark, sf_dir).scored)


@query("m10_metrics", over("scored", more=f"c AS (SELECT {CELLS.format(t=0.5)} FROM scored)") + """
SELECT round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, round(tp::DOUBLE / (tp + fp), 6) AS precision,
 round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1_score FROM c""")
def metrics(spark, sf_dir):
    return rounded(E.metrics(Tables(spark, sf_dir).scored), 6)


REPORT = """m AS (SELECT *, tn::DOUBLE / (tn + fn) AS p0, tn::DOUBLE / (tn + fp) AS r0, 2.0 * tn / (2 * tn + fn + fp) AS f0,
 tp::DOUBLE / (tp + fp) AS p1, tp::DOUBLE / (tp + fn) AS r1, 2.0 * tp / (2 * tp + fp + fn) AS f1,
 tn + fp AS n0, tp + fn AS n1, tn + fp + tp + fn AS n FROM c)"""
REPORT_ROWS = """SELECT {k} '0' AS clase, p0 AS precision, r0 AS recall, f0 AS f1, n0 AS support FROM m
UNION ALL SELECT {k} '1', p1, r1, f1, n1 FROM m
UNION ALL SELECT {k} 'accuracy', (tp + tn)::DOUBLE / n, (tp + tn)::DOUBLE / n, (tp + tn)::DOUBLE / n, n FROM m
UNION ALL SELECT {k} 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM m
UNION ALL SELECT {k} 'weighted avg', (p0 * n0 + p1 * n1) / n, (r0 * n0 + r1 * n1) / n, (f0 * n0 + f1 * n1) / n, n FROM m"""
ROUNDED_ROWS = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


@query("m11_classification_report", over("scored", more=f"c AS (SELECT {CELLS.format(t=0.5)} FROM scored), {REPORT}") + f"""
SELECT clase, {ROUNDED_ROWS}, support FROM ({REPORT_ROWS.format(k='')})""")
def report(spark, sf_dir):
    return rounded(E.classification_report(Tables(spark, sf_dir).scored), 6)


@query("m15_compared_thresholds", over("scored", more=f"""
c AS (SELECT 0.5::DOUBLE AS threshold, {CELLS.format(t=0.5)} FROM scored
 UNION ALL SELECT 0.23885836::DOUBLE, {CELLS.format(t='0.23885836::DOUBLE')} FROM scored), {REPORT}""") + f"""
SELECT threshold, tn, fp, fn, tp, clase, {ROUNDED_ROWS}, support FROM ({REPORT_ROWS.format(k='threshold, tn, fp, fn, tp,')})""")
def compared(spark, sf_dir):
    return rounded(E.compare_thresholds(Tables(spark, sf_dir).scored, [0.5, S.MODEL_THRESHOLD]), 6,
                   "precision", "recall", "f1")


CURVE = """s AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY score),
w AS (SELECT *, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp,
 CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n FROM s)"""


@query("w06_cumulative_hits", over("scored", more=CURVE) + """
SELECT score AS threshold, tp, fp, p AS tp_all, n AS fp_all FROM w""")
def cumulative(spark, sf_dir):
    return E.cumulative(Tables(spark, sf_dir).scored).select("threshold", "tp", "fp", "tp_all", "fp_all")


@query("m12_pr_curve", over("scored", more=CURVE) + """
SELECT score AS threshold, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / p, 6) AS recall FROM w""")
def pr(spark, sf_dir):
    return rounded(E.pr_curve(Tables(spark, sf_dir).scored), 6, "precision", "recall")


@query("m13_roc_curve", over("scored", more=CURVE) + """
SELECT score AS threshold, round(fp::DOUBLE / n, 6) AS fpr, round(tp::DOUBLE / p, 6) AS tpr FROM w""")
def roc(spark, sf_dir):
    return rounded(E.roc_curve(Tables(spark, sf_dir).scored), 6, "fpr", "tpr")


@query("m12_m13_areas", over("scored", more=CURVE + """,
l AS (SELECT *, tp - pos AS tp0, fp - neg AS fp0 FROM w)""") + """
SELECT round(sum((fp - fp0)::DOUBLE * (tp + tp0) / 2) / any_value(p) / any_value(n), 6) AS roc_auc,
 round(sum(pos::DOUBLE / p * (tp::DOUBLE / (tp + fp) + CASE WHEN tp0 + fp0 = 0 THEN 1 ELSE tp0::DOUBLE / (tp0 + fp0) END) / 2), 6) AS pr_auc FROM l""")
def areas(spark, sf_dir):
    return rounded(E.areas(Tables(spark, sf_dir).scored), 6)


@query("m14_best_threshold", over("scored", more=CURVE) + """
SELECT score AS threshold, round(2.0 * tp / (tp + fp + p), 6) AS f1 FROM w ORDER BY 2.0 * tp / (tp + fp + p) DESC, score LIMIT 1""")
def best(spark, sf_dir):
    return rounded(E.best_threshold(Tables(spark, sf_dir).scored), 6, "f1")


TOP = """SELECT CAST(ceil(count(*) * {f}::DOUBLE) AS BIGINT) AS k, count(*) FILTER (label = 1 AND place <= ceil(n * {f}::DOUBLE)) AS positivos,
 round(count(*) FILTER (label = 1 AND place <= ceil(n * {f}::DOUBLE))::DOUBLE / ceil(any_value(n) * {f}::DOUBLE), 6) AS precision
FROM (SELECT label, count(*) OVER () AS n, row_number() OVER (ORDER BY {s} DESC, {h}, id) AS place FROM scored)"""


@query("m20_precision_at_top", over("scored") + TOP.format(f=0.2, h=HASH_SQL, s="score"))
def at_top(spark, sf_dir):
    return rounded(E.precision_at_top(Tables(spark, sf_dir).scored, "id", 0.2, order_key=_hash(), bucket=_hash_bucket()), 6)


@query("m20_precision_at_top_tied", over("scored") + TOP.format(f=0.2, h=HASH_SQL, s="round_even(score, 1)"))
def at_top_tied(spark, sf_dir):
    tied = Tables(spark, sf_dir).scored.withColumn("score", F.rint(F.col("score") * 10) / 10)
    return rounded(E.precision_at_top(tied, "id", 0.2, order_key=_hash(), bucket=_hash_bucket()), 6)


# -- training -----------------------------------------------------------------------------


def _matrix(spark, sf_dir):
    """Boosted-tree matrix with the product columns that give the target away left out."""
    from saleslens.plans.features import LEAKY_IN_MATRIX
    from saleslens.plans.matrices import boosted_matrix

    return boosted_matrix(general(spark, sf_dir)).drop(*LEAKY_IN_MATRIX)


# The features of the matrix, in its order.
MATRIX_FEATURES = [
    "age", "income_range", "risk_profile", "occupation", "age_range_sturges", "checking_account", "savings_account", "credit_card",
    "investment", "antiguedad_cliente", "n_meses_activos", "recencia_transaccion", "entertainment_count", "food_count", "health_count",
    "shopping_count", "supermarket_count", "transport_count", "travel_count", "categoria_favorita_monto", "total_spend_fav",
    "transacciones_promedio_mensual", "variacion_mensual_promedio", "variacion_mensual_promedio_pct", "fecha_primer_producto_ts",
    "fecha_segundo_producto_ts", "mes_mas_compras_ts", "mes_mayor_monto_ts",
]


def _features(matrix):
    return TR.feature_names(matrix)


def _assembled(spark, sf_dir):
    matrix = _matrix(spark, sf_dir)
    names = _features(matrix)
    return durable(TR.assembled(matrix, names)), names


def _key_hash():
    return (F.col("user_id").cast("long") * 7919 + 42) % 1000003


def _split(df):
    marked = durable(E.stratified_split(df, "user_id", order_key=_key_hash(), bucket=F.floor(_key_hash() / 1000)))
    return marked.where("NOT is_test").drop("is_test"), marked.where("is_test").drop("is_test")


def _valid(scores):
    """Scores as SQL can state them: there is one for each row, and it is a probability."""
    return scores.withColumn("score_valid", F.coalesce(F.col("score").between(0, 1), F.lit(False))).drop("score")


LABELLED = over("demographics", "flags", more="""
labelled AS (SELECT user_id, CAST(coalesce(insurance, FALSE) AS INTEGER)::DOUBLE AS label FROM demographics LEFT JOIN flags USING (user_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY (user_id::BIGINT * 7919 + 42) % 1000003, user_id) AS rank,
 count(*) OVER (PARTITION BY label) AS n FROM labelled)""")
TEST_ROWS = LABELLED + "SELECT user_id, label, TRUE AS score_valid FROM r WHERE rank <= floor(n * 0.3::DOUBLE + 0.5)"


@query("m01_boosted_trees_on_test_rows", TEST_ROWS)
def boosted(spark, sf_dir):
    train, test = _split(_assembled(spark, sf_dir)[0])
    return _valid(TR.scored(TR.boosted_trees().fit(train), test))


@query("m02_m06_balanced_logistic_out_of_fold", LABELLED + """
SELECT user_id, label, CAST((rank - 1) % 5 AS INTEGER) AS fold, TRUE AS score_valid FROM r""")
def logistic(spark, sf_dir):
    df, _ = _assembled(spark, sf_dir)
    return _valid(TR.out_of_fold(TR.balanced_logistic(), TR.class_weights(df), order_key=_key_hash(),
                                 bucket=F.floor(_key_hash() / 1000)))


@query("m03_random_forest_on_test_rows", TEST_ROWS)
def forest(spark, sf_dir):
    train, test = _split(_assembled(spark, sf_dir)[0])
    return _valid(TR.scored(TR.random_forest().fit(train), test))


FOLDED = LABELLED.rstrip() + ", folded AS (SELECT user_id, label, CAST((rank - 1) % 5 AS INTEGER) AS fold FROM r)\n"
FOLD_SIZES = FOLDED + "SELECT fold, count(*) AS n, count(*) FILTER (label = 1) AS positives, TRUE AS metrics_valid{more} FROM folded GROUP BY fold"


def _folds():
    return {"order_key": _key_hash(), "bucket": F.floor(_key_hash() / 1000)}


def _between(columns):
    """Metrics as SQL can state them: they are parts of one."""
    return F.coalesce(reduce(lambda a, b: a & b, [F.col(c).between(0, 1) for c in columns]), F.lit(False))


def _valid_metrics(folds):
    names = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "pr_auc"]
    return folds.withColumn("metrics_valid", _between(names)).drop(*names)


@query("m05_cross_validated_metrics", FOLD_SIZES.format(more=""))
def cross_validated(spark, sf_dir):
    """Metrics of every fold beside its sizes; ``cross_validated`` averages them."""
    df, _ = _assembled(spark, sf_dir)
    return _valid_metrics(TR.fold_metrics(durable(TR.out_of_fold(TR.balanced_logistic(), TR.class_weights(df), **_folds()))))


def _folded(spark, sf_dir):
    """Matrix with label and folds that SQL can state, and its features."""
    matrix = _matrix(spark, sf_dir)
    names = _features(matrix)
    ready = matrix.select("user_id", F.coalesce(F.col("insurance").cast("int").cast("double"), F.lit(0.0)).alias("label"), *names)
    return durable(E.stratified_folds(ready, "user_id", order_key=_key_hash(), bucket=F.floor(_key_hash() / 1000))), names


def _grid(name, space=TR.SEARCH_SPACE):
    return f"(VALUES {', '.join(f'({v}::{"INTEGER" if isinstance(v, int) else "DOUBLE"})' for v in space[name])}) {name}_({name})"


@query("m07_random_search", FOLDED.rstrip() + f""",
grid AS (SELECT *, row_number() OVER (ORDER BY trees, depth, rate, rows, columns) - 1 AS i FROM {', '.join(map(_grid, TR.SEARCH_SPACE))}),
drawn AS (SELECT *, row_number() OVER (ORDER BY md5(i || ':42')) - 1 AS setting FROM grid),
sizes AS (SELECT fold, count(*) AS n, count(*) FILTER (label = 1) AS positives FROM folded GROUP BY fold)
SELECT CAST(setting AS INTEGER) AS setting, trees, depth, rate, rows, columns, fold, n, positives, TRUE AS roc_auc_valid
FROM drawn, sizes WHERE setting < 50""")
def search(spark, sf_dir):
    """50 of 243 settings on 5 folds; the area of each is checked to be one."""
    folded, names = _folded(spark, sf_dir)
    found = TR.random_search(folded, names, TR.drawn_settings(n=50))
    return found.withColumn("roc_auc_valid", F.coalesce(F.col("roc_auc").between(0, 1), F.lit(False))).drop("roc_auc")


BEST_SPACE = TR.SEARCH_SPACE | {"trees": [100], "rows": [1.0]}


@query("m07_best_setting", "WITH grid AS (SELECT *, row_number() OVER (ORDER BY depth, rate, columns) - 1 AS i FROM "
       + ", ".join(_grid(n, BEST_SPACE) for n in BEST_SPACE) + """)
SELECT CAST(row_number() OVER (ORDER BY md5(i || ':42')) - 1 AS INTEGER) AS setting, trees, depth, rate, rows, columns, TRUE AS roc_auc_valid
FROM grid QUALIFY setting < 9""")
def best_setting(spark, sf_dir):
    """The mean area over the folds of nine settings of 100 trees with all rows drawn; ``search_means`` ranks them."""
    folded, names = _folded(spark, sf_dir)
    means = TR.search_means(TR.random_search(folded, names, TR.drawn_settings(BEST_SPACE, n=9)))
    return means.withColumn("roc_auc_valid", _between(["roc_auc"])).drop("roc_auc")


@query("m01_second_order_trees_on_test_rows", TEST_ROWS)
def second_order(spark, sf_dir):
    folded, names = _folded(spark, sf_dir)
    train, test = _split(folded.drop("fold"))
    return _valid(BO.scored(BO.fit(BO.binned(train, names), BO.Setting()), test).drop("margin"))


@query("m01_m06_second_order_out_of_fold", FOLDED + "SELECT user_id, label, fold, TRUE AS score_valid FROM folded")
def second_order_out_of_fold(spark, sf_dir):
    folded, names = _folded(spark, sf_dir)
    scores = BO.held_out_scores(BO.binned(folded, names, fold="fold"), [BO.Setting()], 5)
    return _valid(scores.drop("setting"))


@query("m08_boosted_learning_curve", FOLDED.rstrip() + """,
sizes AS (SELECT unnest([0.1, 0.325, 0.55, 0.775, 1.0]::DOUBLE[]) AS size)
SELECT size, f AS fold, count(*) FILTER (fold = f) AS n, CASE WHEN size = 1 THEN count(*) FILTER (fold <> f) END AS train_rows_of_all,
 TRUE AS nested, TRUE AS areas_valid FROM folded, sizes, range(5) t(f) GROUP BY size, f""")
def boosted_curve(spark, sf_dir):
    folded, names = _folded(spark, sf_dir)
    curve = TR.boosted_learning_curve(folded, names, BO.Setting())
    before = F.lag("train_rows", 1, 0).over(Window.partitionBy("fold").orderBy("size"))
    valid = F.coalesce(F.col("train_auc").between(0, 1) & F.col("validation_auc").between(0, 1), F.lit(False))
    return curve.select("size", F.col("fold").cast("bigint").alias("fold"), "n", F.when(F.col("size") == 1, F.col("train_rows")).alias("train_rows_of_all"),
                        (F.col("train_rows") > before).alias("nested"), valid.alias("areas_valid"))


@query("m08_learning_curve", FOLDED.rstrip() + """,
sizes AS (SELECT unnest([0.1, 0.325, 0.55, 0.775, 1.0]::DOUBLE[]) AS size),
trained AS (SELECT size, f, count(*) AS n FROM folded, sizes, range(5) t(f)
 WHERE fold <> f AND ((user_id::BIGINT * 104729 + 7) % 1000003) / 1000003.0::DOUBLE < size GROUP BY size, f)
SELECT size, avg(n) AS train_rows, TRUE AS areas_valid FROM trained GROUP BY size""")
def curve(spark, sf_dir):
    df, _ = _assembled(spark, sf_dir)
    part = (F.col("user_id").cast("long") * 104729 + 7) % 1000003 / 1000003.0
    found = TR.learning_curve(TR.balanced_logistic(), TR.class_weights(df), part=part, **_folds())
    return found.withColumn("areas_valid", _between(["train_auc", "validation_auc"])).drop("train_auc", "validation_auc")


def _values(names):
    return "(VALUES " + ", ".join(f"('{n}')" for n in names) + ") v(feature)"


@query("m16_feature_importance", f"SELECT feature, TRUE AS importance_valid, TRUE AS adds_up FROM {_values(MATRIX_FEATURES)}")
def importance(spark, sf_dir):
    """Importance of every feature in a forest; they are parts of one."""
    df, names = _assembled(spark, sf_dir)
    found = durable(TR.importances(TR.random_forest().fit(df), names))
    whole = abs(found.agg(F.sum("importance")).first()[0] - 1) < 1e-9
    return found.select("feature", F.col("importance").between(0, 1).alias("importance_valid"), F.lit(whole).alias("adds_up"))


@query("m16_boosted_importance", f"SELECT feature, TRUE AS importance_valid, TRUE AS adds_up FROM {_values(MATRIX_FEATURES)}")
def boosted_importance(spark, sf_dir):
    """Mean gain of the splits on each feature, as parts of one."""
    folded, names = _folded(spark, sf_dir)
    found = BO.fit(BO.binned(folded, names), BO.Setting()).importances()
    whole = abs(sum(found.values()) - 1) < 1e-9
    return spark.createDataFrame([(f, 0 <= v <= 1, whole) for f, v in found.items()], "feature string, importance_valid boolean, adds_up boolean")


@query("m17_permutation_importance", f"SELECT feature, TRUE AS loss_valid FROM {_values(MATRIX_FEATURES)}")
def permutation(spark, sf_dir):
    """Loss of area with each feature exchanged between rows; an area is at most one, so no loss is more."""
    matrix = durable(_matrix(spark, sf_dir))
    names = _features(matrix)
    model = TR.balanced_logistic().fit(TR.class_weights(TR.assembled(matrix, names)))
    found = TR.permutation_importance(lambda t: TR.scored(model, TR.assembled(t, names, key="feature"), key="feature"), matrix, names)
    return found.select("feature", F.coalesce(F.col("auc_loss").between(-1, 1), F.lit(False)).alias("loss_valid"))


@query("m17_exchanged_rows", over("demographics", more="""
p AS (SELECT count(*) AS n, CAST(sum(age) AS BIGINT) AS ages FROM demographics)""") + f"""
SELECT feature, n, ages FROM p, (SELECT '' AS feature UNION ALL VALUES ('age'), ('income_range'), ('risk_profile'), ('occupation')) f""")
def exchanged_rows(spark, sf_dir):
    """Every feature is exchanged between all rows and keeps its values, so its sum."""
    people = Tables(spark, sf_dir).demographics
    return TR.exchanged(people, ["age", "income_range", "risk_profile", "occupation"]).groupBy("feature").agg(
        F.count("*").alias("n"), F.sum("age").alias("ages"))


@query("m17_contributions", over("demographics") + f"SELECT user_id, {len(MATRIX_FEATURES)} AS features, TRUE AS adds_up FROM demographics")
def contributions(spark, sf_dir):
    """Exact contributions of every feature to the margin of every customer; with the base they add up to it."""
    folded, names = _folded(spark, sf_dir)
    model = BO.fit(BO.binned(folded, names), BO.Setting())
    total = F.aggregate("contributions", F.col("base"), lambda a, x: a + x)
    return AT.contributions(model, folded).select(
        "user_id", F.size("contributions").alias("features"), (F.abs(total - F.col("margin")) < 1e-9).alias("adds_up"))


@query("m17_mean_contributions", f"SELECT feature, TRUE AS valid FROM {_values(MATRIX_FEATURES)}")
def mean_contributions(spark, sf_dir):
    folded, names = _folded(spark, sf_dir)
    model = BO.fit(BO.binned(folded, names), BO.Setting())
    return AT.mean_contributions(model, folded).select("feature", (F.col("mean_contribution") >= 0).alias("valid"))


@query("m21_without_features", FOLD_SIZES.format(more=f", {len(MATRIX_FEATURES) - 2} AS features"))
def without(spark, sf_dir):
    matrix = durable(_matrix(spark, sf_dir))
    return _valid_metrics(TR.without_features(TR.random_forest(), matrix, ["n_meses_activos", "risk_profile"], **_folds()))


@query("m18_c08_c09_scored_and_merged", over("demographics") + """
SELECT user_id, TRUE AS probability_valid, TRUE AS target_follows, TIMESTAMP '2024-02-01' AS created_at FROM demographics""")
def merged(spark, sf_dir):
    """Train, save, load, score every customer, merge into the stored predictions."""
    matrix = durable(_matrix(spark, sf_dir))
    names = _features(matrix)
    weighted = TR.class_weights(TR.ready(matrix, names))
    model = TR.pipeline(names, TR.balanced_logistic()).fit(weighted)
    folder = scratch(spark)
    TR.save_model(model, S.SERVICE_THRESHOLD, folder)
    loaded, threshold = TR.load_model(folder)
    stored = Tables(spark, sf_dir).clients.select(
        "user_id", F.lit(0.5).alias("probability"), F.lit(False).alias("is_target"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    return _judged(SC.score_and_merge(loaded, matrix, stored, threshold, as_of="2024-02-01"), threshold)


def _judged(predictions, threshold):
    return predictions.select(
        "user_id", F.coalesce(F.col("probability").between(0, 1), F.lit(False)).alias("probability_valid"),
        F.col("is_target").eqNullSafe(F.col("probability") >= threshold).alias("target_follows"), "created_at")


@query("m14_m18_c08_final_model_saved", over("demographics") + """
SELECT user_id, TRUE AS probability_valid, TRUE AS target_follows, TRUE AS as_before_saving, TIMESTAMP '2024-02-01' AS created_at
FROM demographics""")
def final(spark, sf_dir):
    """The default features with their moments and dictionaries, 100 trees and the best threshold, saved and loaded."""
    from saleslens.plans.bundle import final_model, load_bundle
    from saleslens.plans.features import default_base

    t, folder = Tables(spark, sf_dir), scratch(spark)
    base = durable(default_base(t.demographics, t.products, t.transactions))
    bundle, _ = final_model(base)
    bundle.save(folder)
    loaded = load_bundle(folder)
    before = bundle.score(base, "2024-02-01").select("user_id", F.col("probability").alias("_before"))
    both = durable(loaded.score(base, "2024-02-01").join(before, "user_id"))
    same = both.select("user_id", F.col("_before").eqNullSafe(F.col("probability")).alias("as_before_saving"))
    return _judged(both, loaded.threshold).join(same, "user_id")


# -- streams --------------------------------------------------------------------------------


def _event_stream(spark, sf_dir):
    from saleslens.sources.adapters import table

    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("t02_streamed_contact_counts", over("contacts") + """
SELECT CAST(contacted_at AS DATE) AS date, coalesce(outcome, 'other') AS outcome, count(*) AS n FROM contacts GROUP BY 1, 2""")
def streamed_counts(spark, sf_dir):
    from saleslens.sources.adapters import contacts_from
    from saleslens.streaming.contacts import contact_counts

    counts = contact_counts(contacts_from(_event_stream(spark, sf_dir)))
    running = counts.writeStream.format("memory").queryName("streamed_contact_counts").outputMode(
        "complete").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table("streamed_contact_counts")


@query("t02_late_contacts", over("contacts", more="""
m AS (SELECT max(contacted_at) AS top FROM contacts WHERE id % 3 <> 0)""") + """
SELECT CAST(contacted_at AS DATE) AS date, coalesce(outcome, 'other') AS outcome,
 id % 3 = 0 AND contacted_at < top - INTERVAL 7 DAYS AS late, count(*) AS n FROM contacts, m GROUP BY 1, 2, 3""")
def late_contacts(spark, sf_dir):
    """A third of the contacts comes in a second run; those over a week behind are counted as late."""
    from saleslens.streaming.contacts import count_contacts, counted

    contacts, folder = Tables(spark, sf_dir).contacts, scratch(spark)
    for part in (F.col("id") % 3 != 0, F.col("id") % 3 == 0):
        contacts.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(contacts.schema).parquet(f"{folder}/in")
        count_contacts(stream, f"{folder}/out", f"{folder}/log", "7 days").awaitTermination()
    return counted(spark, f"{folder}/out")


STREAM_SQL = over("clients", "changes", more="""
latest AS (SELECT client_id, first(new_status ORDER BY changed_at DESC, new_status DESC) AS new_status
 FROM changes WHERE new_status <> 'archived' GROUP BY client_id)""") + """
SELECT id, coalesce(new_status, status) AS status FROM clients LEFT JOIN latest ON id = client_id"""


@query("t01_streamed_status_changes", STREAM_SQL)
def streamed_changes(spark, sf_dir):
    from saleslens.sources.adapters import changes_from
    from saleslens.streaming.contacts import apply_status_stream

    folder = scratch(spark)
    clients = Tables(spark, sf_dir).clients

    def before(batch: int):
        return clients if batch == 0 else spark.read.parquet(f"{folder}/out/clients/batch={batch - 1}")

    started = apply_status_stream(changes_from(_event_stream(spark, sf_dir)), before, f"{folder}/out", f"{folder}/log")
    started.awaitTermination()
    last = started.lastProgress["batchId"]
    return spark.read.parquet(f"{folder}/out/clients/batch={last}").select("id", "status")


@query("t01_keyed_status", STREAM_SQL)
def keyed_status(spark, sf_dir):
    """The changes come in three runs, out of order and the second part twice; state keeps the latest of each client."""
    from saleslens.streaming.status import current_clients, keep_status

    t, folder = Tables(spark, sf_dir), scratch(spark)
    changes = t.changes
    part = F.pmod(F.xxhash64(*changes.columns), F.lit(3))
    for i in (2, 0, 0, 1):
        changes.where(part == i).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(changes.schema).parquet(f"{folder}/in")
        keep_status(stream, f"{folder}/out", f"{folder}/log").awaitTermination()
    return current_clients(t.clients, f"{folder}/out").select("id", "status")
