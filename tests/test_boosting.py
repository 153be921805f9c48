"""Boosted trees against a plain version, both ways of training, contributions against all subsets."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleslens.plans import attribution as A
from saleslens.plans import boosting as B

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    """Rows with ties, missing values and a constant column; the label follows a and the sign of b."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        a, b, c = round(float(rng.normal()), 1), float(rng.integers(-4, 5)), (None if i % 7 == 0 else float(rng.random()))
        p = 1 / (1 + math.exp(-(2 * a + (b > 1) * 1.5 + (c is None) - 0.5)))
        rows.append((f"u{i}", float(rng.random() < p), i % 5, a, b, c if i % 11 else float("nan"), 1.0))
    return spark.createDataFrame(rows, "user_id string, label double, fold int, a double, b double, c double, d double").repartition(3).cache()


@pytest.fixture(scope="module")
def data(table):
    return B.binned(table, FEATURES, fold="fold", block_rows=40, max_bins=16)


def plain_tree(rows, labels, hashes, margins, cuts, setting, number):
    """Nested dictionaries; every split is tried by going through the rows."""
    one = 2.0 ** -24
    p = [1 / (1 + math.exp(-m)) for m in margins]
    g = [round((q - y) / one) * one for q, y in zip(p, labels)]
    h = [round(max(q * (1 - q), one) / one) * one for q in p]
    used = [i for i in range(len(rows)) if B.drawn_rows(setting, number, hashes)[i]]
    columns = B.drawn_columns(setting, number, len(cuts)).tolist()

    def score(members):
        return sum(g[i] for i in members) ** 2 / (sum(h[i] for i in members) + setting.l2)

    def grow(members, depth):
        best = (setting.least_gain, None)
        for f in columns if depth < setting.depth else ():
            for cut in cuts[f]:
                for missing_left in (False, True):
                    left = [i for i in members if (missing_left if math.isnan(rows[i][f]) else rows[i][f] <= cut)]
                    right = [i for i in members if i not in set(left)]
                    if min(sum(h[i] for i in left), sum(h[i] for i in right)) < setting.least_hessian:
                        continue
                    gain = score(left) + score(right) - score(members)
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, cut, missing_left, left, right))
        value = -sum(g[i] for i in members) / (sum(h[i] for i in members) + setting.l2) * setting.rate
        if best[1] is None:
            return {"value": value}
        f, cut, missing_left, left, right = best[1]
        return {"f": f, "cut": cut, "missing_left": missing_left, "left": grow(left, depth + 1), "right": grow(right, depth + 1), "value": value}

    return grow(used, 0)


def plain_value(tree, row):
    while "f" in tree:
        x = row[tree["f"]]
        tree = tree["left"] if (tree["missing_left"] if math.isnan(x) else x <= tree["cut"]) else tree["right"]
    return tree["value"]


def same_tree(tree, node, plain, cuts):
    if "f" not in plain:
        return tree.feature[node] == -1 and tree.value[node] == pytest.approx(plain["value"], abs=1e-9)
    f = plain["f"]
    # All splits between the same two values are one; bins say which.
    return (tree.feature[node] == f and cuts[f][tree.bin[node]] == plain["cut"] if tree.bin[node] < len(cuts[f]) else False) and \
        bool(tree.missing_left[node]) == plain["missing_left"] and same_tree(tree, 2 * node + 1, plain["left"], cuts) and same_tree(tree, 2 * node + 2, plain["right"], cuts)


def values_of(table):
    rows = table.select("user_id", "label", "fold", F.xxhash64("user_id").alias("h"), *FEATURES).collect()
    nan = float("nan")
    return rows, np.array([[nan if r[f] is None else r[f] for f in FEATURES] for r in rows])


@pytest.mark.parametrize("setting", [B.Setting(trees=4, depth=3, rate=0.3, columns=0.8), B.Setting(trees=3, depth=2, rows=0.6, columns=1.0, seed=7)])
def test_trees_against_a_plain_version(table, data, setting):
    model = B.fit(data, setting)
    rows, values = values_of(table)
    hashes = np.array([r["h"] for r in rows]).view(np.uint64)
    margins, labels, cuts = [0.0] * len(rows), [r["label"] for r in rows], data.layout.cuts
    for number, tree in enumerate(model.trees):
        plain = plain_tree(values, labels, hashes, margins, cuts, setting, number)
        assert same_tree(tree, 0, plain, cuts), number
        margins = [m + plain_value(plain, v) for m, v in zip(margins, values)]
    assert model.margins(values) == pytest.approx(margins, abs=1e-8)


def test_passes_give_the_trees_of_tasks(data, monkeypatch):
    monkeypatch.setattr(B, "PENDING", 2)  # so that margins are written between
    plans = [B.Plan(B.Setting(trees=5, depth=3, rows=0.7, columns=0.5), -1), B.Plan(B.Setting(trees=3, depth=4, rate=0.1), 2)]
    for one, other in zip(B.fit_all(data, plans), B.fit_all(data, plans, in_task_cells=0)):
        assert len(one.trees) == len(other.trees)
        for s, t in zip(one.trees, other.trees):
            assert all((getattr(s, n) == getattr(t, n)).all() for n in s.__dict__)


def test_features_counted_together_give_the_sums_of_each(data):
    rng, layout, n = np.random.default_rng(3), data.layout, 20_000
    bins = np.asfortranarray(np.stack([rng.integers(0, m + 1, n) for m in layout.missing], axis=1).astype(np.uint8))
    at, g, h = rng.integers(-1, 3, n), rng.integers(-2**24, 2**24, n).astype(float), rng.integers(1, 2**22, n).astype(float)
    assert len(layout.joint) < len(FEATURES)
    for rows in (slice(None), slice(0, 50)):  # together, and one by one where joint bins are more than the rows
        got = B.histogram(layout, bins[rows], layout.joined(bins[rows]), at[rows], 3, g[rows], h[rows], np.array([0, 2, 3]))
        for k, weight in enumerate((g[rows], h[rows])):
            for node in range(3):
                for f, m in enumerate(layout.missing):
                    want = [weight[(at[rows] == node) & (bins[rows][:, f] == b)].sum() if f != 1 else 0 for b in range(m + 1)]
                    assert got[k, node, layout.first[f]:layout.first[f + 1]].tolist() == want


def test_only_drawn_features_share_a_count(data, monkeypatch):
    rng, layout, n, counts = np.random.default_rng(4), data.layout, 20_000, []
    bins = np.asfortranarray(np.stack([rng.integers(0, m + 1, n) for m in layout.missing], axis=1).astype(np.uint8))
    at, g, h = np.zeros(n, int), rng.integers(-2**24, 2**24, n).astype(float), rng.integers(1, 2**22, n).astype(float)
    bincount = np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: (counts.append(len(a[0])), bincount(*a, **k))[1])
    for columns in ([0, 2], [1, 3], [0, 1], [2, 3]):  # any two fit together, whichever others are not drawn
        counts.clear()
        B.histogram(layout, bins, layout.joined(bins), at, 1, g, h, np.array(columns))
        assert counts == [n, n], columns


def test_runs_of_rows_add_up(data, monkeypatch):
    rng, layout, n = np.random.default_rng(6), data.layout, 5_000
    bins = np.asfortranarray(np.stack([rng.integers(0, m + 1, n) for m in layout.missing], axis=1).astype(np.uint8))
    g, h, columns, longest = rng.integers(-2**24, 2**24, n).astype(float), rng.integers(1, 2**22, n).astype(float), np.arange(4), []
    bincount = np.bincount
    for at, nodes in ((np.zeros(n, int), 1), (rng.integers(-1, 1, n), 1), (rng.integers(-1, 3, n), 3)):
        whole = B.histogram(layout, bins, layout.joined(bins), at, nodes, g, h, columns)
        with monkeypatch.context() as m:
            m.setattr(B, "NEAR_ROWS", 500)
            m.setattr(B, "JOINT_BINS", 100)
            m.setattr(B, "FEW_JOINT_BINS", 50)
            m.setattr(np, "bincount", lambda *a, **k: (longest.append(len(a[0])), bincount(*a, **k))[1])
            assert (B.histogram(layout, bins, layout.joined(bins), at, nodes, g, h, columns) == whole).all()
    assert max(longest) < n / 4  # never over all rows at once


def test_levels_stepped_by_table_and_node_by_node(data, monkeypatch):
    block = B._whole(data)
    tree = B.fit(data, B.Setting(trees=1, depth=6, columns=1.0, least_hessian=0.1)).trees[0]
    assert tree.missing_left.any() and (tree.feature[31:63] >= 0).sum() > 4  # some nodes of the last level are split, others are not
    monkeypatch.setattr(B, "NEAR_ROWS", 70)
    by_node = tree.places(block.bins, data.layout.missing)
    monkeypatch.setattr(B, "FEW_NODES", 0)
    assert (tree.places(block.bins, data.layout.missing) == by_node).all()


def test_rows_are_counted_at_the_lighter_child_only(data, monkeypatch):
    counted, plain = [], B.histogram

    def histogram(layout, bins, joined, at, *rest):
        counted.append((at >= 0).sum())
        return plain(layout, bins, joined, at, *rest)

    monkeypatch.setattr(B, "histogram", histogram)
    block = B._whole(data)
    list(B._grow_all(data.layout, block, data.layout.joined(block.bins), B.Plan(B.Setting(trees=4, depth=3), -1)))
    assert counted[0] == 300 and all(n < 300 for i, n in enumerate(counted) if i % 3) and sum(counted) < 4 * 3 * 300 * 0.75


def test_held_out_scores_are_those_of_separate_fits(table, data):
    settings = [B.Setting(trees=2, depth=2), B.Setting(trees=5, depth=2), B.Setting(trees=3, depth=3, rate=0.1, rows=0.5)]
    got = B.held_out_scores(data, settings, 5).collect()
    again = B.held_out_scores(data, settings, 5, in_task_cells=0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert len(got) == len(settings) * 300
    model = B.fit(data, settings[1], fold=3)
    want = {r["user_id"]: r["score"] for r in B.scored(model, table.where("fold = 3")).collect()}
    assert {r["user_id"]: r["score"] for r in got if r["setting"] == 1 and r["fold"] == 3} == pytest.approx(want)


def test_scores_of_the_rows_trained_on(data):
    plans = [B.Plan(B.Setting(trees=2), 1, (2,), part, both=True) for part in (0.3, 1.0)]
    got = B.scores_of(data, plans).groupBy("plan", "trained").count().collect()
    n = {(r["plan"], r["trained"]): r["count"] for r in got}
    assert n[0, False] == n[1, False] == 60 and n[1, True] == 240 and 40 < n[0, True] < 110


def test_saved_and_loaded(table, data, tmp_path):
    model = B.fit(data, B.Setting(trees=7, depth=4, rows=0.8))
    B.save(model, str(tmp_path))
    loaded = B.load(str(tmp_path))
    assert loaded.setting == model.setting
    assert B.scored(loaded, table).exceptAll(B.scored(model, table)).isEmpty()


def test_the_model_learns(table, data):
    scores = B.scored(B.fit(data, B.Setting(trees=50)), table).toPandas()
    assert scores[scores.label == 1].score.mean() > scores[scores.label == 0].score.mean() + 0.4
    assert sum(B.fit(data, B.Setting(trees=5)).importances().values()) == pytest.approx(1)


def test_odd_tables(spark, table):
    schema = table.schema
    empty = B.binned(spark.createDataFrame([], schema), FEATURES)
    model = B.fit(empty, B.Setting(trees=2))
    assert B.scored(model, table).where("score <> 0.5").count() == 0
    one_class = B.binned(table.withColumn("label", F.lit(1.0)), FEATURES)
    assert all(s > 0.9 for s in B.scored(B.fit(one_class, B.Setting(trees=100)), table).toPandas().score)
    nothing = table.withColumns({f: F.lit(None).cast("double") for f in FEATURES})
    flat = B.fit(B.binned(nothing, FEATURES), B.Setting(trees=3))
    assert all((t.feature == -1).all() for t in flat.trees)
    assert B.scored(flat, nothing).select("score").distinct().count() == 1


# -- contributions ----------------------------------------------------------------------------------


def by_subsets(tree, bins, missing, n):
    """Shapley values of one row over all sets of features."""
    def mean(known, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        children = (2 * node + 1, 2 * node + 2)
        if f in known:
            left = tree.missing_left[node] if bins[f] == missing[f] else bins[f] <= tree.bin[node]
            return mean(known, children[0 if left else 1])
        return sum(mean(known, c) * tree.hessian[c] / tree.hessian[node] for c in children)

    out = []
    for f in range(n):
        rest = [x for x in range(n) if x != f]
        out.append(sum(math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (mean({*s, f}) - mean(set(s)))
                       for k in range(n) for s in combinations(rest, k)))
    return out


def test_contributions_against_all_subsets(table, data):
    model = B.fit(data, B.Setting(trees=6, depth=4, columns=1.0))
    _, values = values_of(table)
    bins, missing = model.layout.binned(values[:25]), model.layout.missing
    for tree in model.trees:
        got = A.tree_contributions(tree, bins, missing)
        for row, b in zip(got, bins):
            assert row.tolist() == pytest.approx(by_subsets(tree, b, missing, len(FEATURES)), abs=1e-10)


def test_contributions_are_reckoned_once_for_rows_on_the_same_sides(table, data, monkeypatch):
    model = B.fit(data, B.Setting(trees=3, depth=4, columns=1.0))
    bins, missing = model.layout.binned(values_of(table)[1]), model.layout.missing
    reckoned, plain = [], A.tree_contributions

    def tree_contributions(tree, some, missing):
        reckoned.append(len(some))
        return plain(tree, some, missing)

    monkeypatch.setattr(A, "tree_contributions", tree_contributions)
    for tree in model.trees:
        out = np.ones(bins.shape)
        A.add_contributions(tree, bins, missing, out)
        assert out == pytest.approx(1 + plain(tree, bins, missing), abs=1e-12)
    assert max(reckoned) < len(bins) / 2


def test_contributions_add_up(table, data):
    model = B.fit(data, B.Setting(trees=30))
    rows = A.contributions(model, table).collect()
    assert len(rows) == 300
    margins = {r["user_id"]: r["margin"] for r in B.scored(model, table).collect()}
    for r in rows:
        assert r["base"] + sum(r["contributions"]) == pytest.approx(margins[r["user_id"]], abs=1e-9)
    means = {r["feature"]: r["mean_contribution"] for r in A.mean_contributions(model, table).collect()}
    assert means["d"] == 0 and max(means, key=means.get) == "a"
    first = A.contributions(model, table).select(F.avg(F.abs(A.of_feature(model, "b")))).first()[0]
    assert first == pytest.approx(means["b"])
    assert {r["mean_contribution"] for r in A.mean_contributions(model, table.limit(0)).collect()} == {0.0}
