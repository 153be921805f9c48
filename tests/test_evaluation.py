import numpy as np
import pytest

from saleslens.operators import evaluation as E


def table(spark, scores, labels):
    return spark.createDataFrame(
        [(i, float(s), int(y)) for i, (s, y) in enumerate(zip(scores, labels))], "id long, score double, label int")


def one(df):
    return df.first().asDict()


@pytest.fixture
def tied(spark):
    rng = np.random.default_rng(5)
    scores, labels = np.round(rng.random(300), 1), rng.integers(0, 2, 300)
    return table(spark, scores, labels), scores, labels


def brute_auc(scores, labels):
    p, n = scores[labels == 1], scores[labels == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n])


def test_area_counts_ties_as_half(tied):
    df, scores, labels = tied
    assert one(E.areas(df))["roc_auc"] == pytest.approx(brute_auc(scores, labels))


def test_areas_per_group_in_one_pass(tied):
    df, scores, labels = tied
    half = np.arange(300) % 2
    got = {r["g"]: r["roc_auc"] for r in E.areas(df.selectExpr("*", "CAST(id % 2 AS int) AS g"), by=["g"]).collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(brute_auc(scores[half == g], labels[half == g]))


def test_perfect_ranking_and_single_class(spark):
    good = table(spark, [0.9, 0.8, 0.2, 0.1], [1, 1, 0, 0])
    assert one(E.areas(good)) == {"roc_auc": 1.0, "pr_auc": 1.0}
    assert one(E.best_threshold(good)) == {"threshold": 0.8, "f1": 1.0}
    assert one(E.areas(table(spark, [0.9, 0.1], [1, 1])))["roc_auc"] is None


def test_nothing_predicted(spark):
    df = table(spark, [0.1, 0.2, 0.3], [1, 0, 1])
    assert one(E.metrics(df)) == {"accuracy": pytest.approx(1 / 3), "precision": 0.0, "recall": 0.0, "f1_score": 0.0}
    assert one(E.confusion(df)) == {"tn": 1, "fp": 0, "fn": 2, "tp": 0}


def test_best_threshold_takes_the_lowest_on_ties(tied):
    df, scores, labels = tied
    def f1(t):
        said = scores >= t
        return 2 * (said & (labels == 1)).sum() / (said.sum() + (labels == 1).sum())
    best = max(sorted(set(scores)), key=lambda t: (f1(t), -t))
    got = one(E.best_threshold(df))
    assert got["threshold"] == best and got["f1"] == pytest.approx(f1(best))


def test_report_totals(tied):
    df, scores, labels = tied
    got = {r["clase"]: r for r in E.classification_report(df).collect()}
    assert got["0"]["support"] + got["1"]["support"] == got["accuracy"]["support"] == 300
    said = scores >= 0.5
    assert got["1"]["precision"] == pytest.approx(labels[said].mean())
    assert got["weighted avg"]["recall"] == pytest.approx(got["accuracy"]["precision"])
    at_two = E.compare_thresholds(df, [0.5, 0.9])
    assert at_two.count() == 10 and at_two.where("threshold = 0.5 AND clase = '1'").first()["precision"] == got["1"]["precision"]


@pytest.mark.parametrize("fraction", [0.05, 0.2, 1.0])
def test_precision_at_top_is_within_what_ties_allow(tied, fraction):
    df, scores, labels = tied
    got = one(E.precision_at_top(df, "id", fraction))
    k = int(np.ceil(300 * fraction))
    cut = np.sort(scores)[::-1][k - 1]
    sure, open_rows = labels[scores > cut].sum(), (scores == cut)
    missing = k - (scores > cut).sum()
    low = sure + max(0, missing - (labels[open_rows] == 0).sum())
    high = sure + min(missing, labels[open_rows].sum())
    assert got["k"] == k and low <= got["positivos"] <= high


def test_no_scores(spark):
    assert one(E.precision_at_top(table(spark, [], []), "id"))["k"] == 0
