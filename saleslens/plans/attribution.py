"""Exact contributions of features to the margins of boosted trees, row by row.

A feature's contribution to a tree is its Shapley value in the game where a set of features is known and
the others are averaged over the training rows that reach each branch. Only the features on the way to a
leaf matter to that leaf. Known features send a row to a leaf or not, unknown ones pass the part of
the cover that goes that way; the sum over all sets of one size is a coefficient of a polynomial, the
product of one factor for each feature. So the work for a leaf is the cube of its depth, whatever the
number of sets, and all rows of a batch go through it at once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslens.plans.boosting import Boosted, Tree, matrix_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ways(tree: Tree) -> Iterator[tuple[int, list[tuple[int, int, bool]]]]:
    """Every leaf with the splits on the way to it: (node, its child on the way, whether that is the left one)."""
    def down(node: int, path: list) -> Iterator:
        if tree.feature[node] < 0:
            yield node, path
            return
        for child, left in ((2 * node + 1, True), (2 * node + 2, False)):
            yield from down(child, [*path, (node, child, left)])

    yield from down(0, [])


def expected(tree: Tree) -> float:
    """Mean value of the training rows, by cover."""
    total = tree.hessian[0]
    return float(sum(tree.value[leaf] * tree.hessian[leaf] for leaf, _ in ways(tree)) / total) if total else float(tree.value[0])


def tree_contributions(tree: Tree, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Contribution of every feature to the value of the tree, for every row."""
    out = np.zeros(bins.shape)
    for leaf, path in ways(tree):
        known: dict[int, np.ndarray] = {}
        part: dict[int, float] = {}
        for node, child, left in path:
            f = int(tree.feature[node])
            goes_left = np.where(bins[:, f] == missing[f], tree.missing_left[node], bins[:, f] <= tree.bin[node])
            known[f] = known.get(f, True) & (goes_left if left else ~goes_left)
            part[f] = part.get(f, 1.0) * tree.hessian[child] / tree.hessian[node]
        d, value = len(part), tree.value[leaf]
        weights = [factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)]
        for f in part:
            # Coefficient s: the sum over all sets of s other features of what reaches the leaf.
            sums = [np.ones(len(bins))]
            for other in part:
                if other != f:
                    kept = [s * part[other] for s in sums] + [0.0]
                    for s in range(len(sums)):
                        kept[s + 1] = kept[s + 1] + sums[s] * known[other]
                    sums = kept
            out[:, f] += value * (known[f] - part[f]) * sum(w * s for w, s in zip(weights, sums, strict=True))
    return out


def add_contributions(tree: Tree, bins: np.ndarray, missing: np.ndarray, out: np.ndarray) -> None:
    """Add the contributions of a tree to those of every row. Rows that take the same side at every split have the same ones, reckoned once."""
    splits = np.flatnonzero(tree.feature >= 0).tolist()
    if not splits or not len(bins):
        return
    sides = np.packbits(np.stack([tree.goes_right(node, bins, missing) for node in splits], axis=1), axis=1)
    same = sides.ravel() if sides.shape[1] == 1 else sides.view(f"V{sides.shape[1]}").ravel()
    _, row, which = np.unique(same, return_index=True, return_inverse=True)
    found = tree_contributions(tree, bins[row], missing)
    for f in set(tree.feature[splits].tolist()):
        out[:, f] += found[:, f][which]


def contributions(model: Boosted, df: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, base, contributions as array<double> in the order of the model's features, margin) of every row.

    Base and contributions add up to the margin. Null and NaN are missing values, as in training.
    """
    base = sum(map(expected, model.trees))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        missing = model.layout.missing
        for batch in batches:
            bins = model.layout.binned(np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(model.layout.features))], axis=1))
            out, margin = np.zeros(bins.shape), np.zeros(len(bins))
            for tree in model.trees:
                add_contributions(tree, bins, missing, out)
                margin += tree.values(bins, missing)
            offsets = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
            yield pa.record_batch([batch.column(0), pa.array(np.full(len(out), base)), pa.ListArray.from_arrays(offsets, out.ravel()), pa.array(margin)],
                                  names=[key, "base", "contributions", "margin"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *matrix_columns(model.layout.features)).mapInArrow(
        run, f"`{key}` {kind}, base double, contributions array<double>, margin double")


def of_feature(model: Boosted, feature: str) -> Column:
    """The contribution of one feature, from the column ``contributions``."""
    return F.col("contributions")[model.layout.features.index(feature)]


def mean_contributions(model: Boosted, df: DataFrame, key: str = "user_id") -> DataFrame:
    """Mean absolute contribution of every feature over all rows, largest first; 0 for a table without rows."""
    n = len(model.layout.features)
    means = contributions(model, df, key).agg(*[F.coalesce(F.avg(F.abs(F.col("contributions")[i])), F.lit(0.0)).alias(f"m{i}") for i in range(n)])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean_contribution")) for i, f in enumerate(model.layout.features)])
    return means.select(F.explode(rows).alias("r")).select("r.*").orderBy(F.desc("mean_contribution"), "feature")
