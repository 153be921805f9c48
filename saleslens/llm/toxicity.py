"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

With grades 0 to K - 1 and ordered thresholds, P(grade > k) = sigmoid(w · x - threshold[k]): one
weight vector is shared by all thresholds. The expected severity is the sum of these probabilities.

Features are hashed: each distinct word of a text, and openings of words, as some languages build
long compounds. The fit uses those features whose presence depends on the label beyond chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import forget_others, letter_table, lower_ascii, text_chunks, text_or_empty, word_bounds, word_hashes

#: Feature slots; the weights are of this size at every corpus size.
SLOTS = 1 << 20
#: Labelled rows of each class that the fit may use, and bytes of each of their texts' features.
PER_CLASS = 6000
OPENINGS = (4, 6)
REJECT = 0.5


def features(data: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct features of each text: words in lower case, and openings of longer words."""
    low = lower_ascii(data)
    starts, ends, firsts = word_bounds(low, offsets, letter_table())
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    rows, slot = [row], [word_hashes(low, starts, ends)]
    for k in OPENINGS:
        long = ends - starts > k
        rows.append(row[long])
        slot.append(word_hashes(low, starts[long], starts[long] + k) * np.uint64(2 * k + 1))
    both = np.unique(np.concatenate(rows) * slots + (np.concatenate(slot) % np.uint64(slots)).astype(np.int64))
    return both // slots, both % slots


@dataclass
class OrdinalModel:
    weights: np.ndarray  # one for each feature slot, shared by all thresholds
    thresholds: np.ndarray  # ascending, one less than there are grades

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for every row and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -60, 60)))


def fit_ordinal(rows: np.ndarray, slots: np.ndarray, grades: np.ndarray, n_grades: int, n_slots: int = SLOTS,
                penalty: float = 2e-4, rounds: int = 300, rate: float = 0.3) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty, classes weighted evenly, by Adam. Ties and constant features are harmless.

    (rows, slots) are the features of each labelled row, ``grades`` its grade. Thresholds stay in
    order because the model learns the first one and the logarithms of the gaps.
    """
    n = len(grades)
    used, at = np.unique(slots, return_inverse=True)
    w, cut, gaps = np.zeros(len(used)), np.array([0.0]), np.zeros(max(0, n_grades - 2))
    share = np.bincount(grades, minlength=n_grades)
    cost = (n / np.maximum(share, 1) / n_grades)[grades]
    target = (grades[:, None] > np.arange(n_grades - 1)[None, :]).astype(float)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, cut, gaps)]
    for t in range(1, rounds + 1):
        thresholds = cut[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        z = np.bincount(rows, weights=w[at], minlength=n)
        above = 1 / (1 + np.exp(np.clip(thresholds[None, :] - z[:, None], -60, 60)))
        edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        p = np.maximum(edges[np.arange(n), grades] - edges[np.arange(n), grades + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
        down, up = slope[np.arange(n), grades], slope[np.arange(n), grades + 1]
        dz = -(down - up) / p * cost / n
        dcut = np.zeros(n_grades - 1)
        np.add.at(dcut, np.clip(grades - 1, 0, None), np.where(grades > 0, down / p * cost / n, 0))
        np.add.at(dcut, np.clip(grades, None, n_grades - 2), np.where(grades < n_grades - 1, -up / p * cost / n, 0))
        dgaps = np.array([dcut[k + 1:].sum() * np.exp(gaps[k]) for k in range(len(gaps))])
        grads = [np.bincount(at, weights=dz[rows], minlength=len(used)) + penalty * w, np.array([dcut.sum()]), dgaps]
        for p_, g, m in zip((w, cut, gaps), grads, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            p_ -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8)
    del target
    weights = np.zeros(n_slots, np.float32)
    weights[used] = w
    return OrdinalModel(weights, cut[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def _part(of: F.Column, sizes: dict[int, int], most: int) -> F.Column:
    """True for about ``most`` of the rows of each class ``y``, by a hash."""
    unit = 1 << 53
    out = F.lit(False)
    for y, n in sizes.items():
        out = out | ((F.col("y") == y) & (F.pmod(of, F.lit(unit)) < int(unit * min(1.0, most / n))))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most about ``per_class`` labelled documents of each class, with their texts, taken by a hash of id and text.

    A first draw of ids bounds what is joined, a second one the documents that the join gives: an id may have
    several rows with texts of their own. Rows alike in id, label and text are one.
    """
    clean = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null").distinct()
    ids = {r.y: r["count"] for r in clean.groupBy("y").count().collect()}
    few = clean.filter(_part(F.xxhash64("doc_id", F.lit(17)), ids, 4 * per_class))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(few), "doc_id").withColumn(  # 4 * per_class ids of a class, about
        "h", F.xxhash64("doc_id", "text", F.lit(29)))
    kinds = {r.y: r["count"] for r in rows.select("y", "h").distinct().groupBy("y").count().collect()}
    return rows.filter(_part(F.col("h"), kinds, per_class)).dropDuplicates(["doc_id", "y", "text"]).sortWithinPartitions("h", "doc_id", "y").select(
        "doc_id", "text", "y")


def informative(slots: np.ndarray, rows: np.ndarray, positive: np.ndarray, n_slots: int = SLOTS) -> np.ndarray:
    """True for features whose presence and the label are dependent: G² above twice the logarithm of their number."""
    n, n1 = len(positive), max(1, int(positive.sum()))
    both = np.bincount(slots, minlength=n_slots).astype(float)
    one = np.bincount(slots[positive[rows] == 1], minlength=n_slots).astype(float)
    g = np.zeros(n_slots)
    for seen, share in ((one, n1 / n), (both - one, 1 - n1 / n)):
        for have, total in ((seen, both), ((n1 if share == n1 / n else n - n1) - seen, n - both)):
            with np.errstate(divide="ignore", invalid="ignore"):
                part = have * np.log(have / (total * share))
            g += 2 * np.where(have > 0, part, 0)
    return (both >= 3) & (g > 2 * np.log(max(2, int((both >= 3).sum()))) + 4)


def graded(rows: np.ndarray, slots: np.ndarray, toxic: np.ndarray, n_grades: int, n_slots: int = SLOTS) -> np.ndarray:
    """Grades out of yes-or-no labels: 0 for clean texts, and for toxic ones the rank of their evidence.

    The evidence of a toxic text is the number of its features that no clean labelled text has and
    at least three toxic ones share; equal parts of the toxic texts get grades 1, 2, ... in its order,
    ties the lower one.
    """
    seen = np.bincount(slots[toxic[rows] == 0], minlength=n_slots) > 0
    shared = np.bincount(slots[toxic[rows] == 1], minlength=n_slots) >= 3
    evidence = np.bincount(rows, weights=(shared & ~seen)[slots], minlength=len(toxic))
    grades = toxic.astype(np.int64)
    if n_grades > 2 and toxic.any():
        cuts = np.quantile(evidence[toxic == 1], np.arange(1, n_grades - 1) / (n_grades - 1))
        grades[toxic == 1] += np.searchsorted(cuts, evidence[toxic == 1])
    return grades


def fit(docs: DataFrame, labels: DataFrame, n_grades: int = 3, label: str = "toxic", per_class: int = PER_CLASS) -> OrdinalModel:
    """Fit on a sample of at most about ``per_class`` labelled rows of each label; features are made by the executors.

    Labels with more than two values are the grades themselves. Without labels, or with one class
    only, nothing can be learnt: all texts then have severity zero.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1)
            for lo, hi, data, offsets in text_chunks(batch.column(0)):
                row, slot = features(data, offsets)
                split = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(split), pa.array(slot.astype(np.int32)))
                yield pa.record_batch([y.slice(lo, hi - lo), listed], names=["y", "slots"])

    sample = labelled_sample(docs, labels, label, per_class).select("text", "y").mapInArrow(run, "y int, slots array<int>").toArrow()
    y = sample.column("y").to_numpy()
    if len(np.unique(y)) < 2:
        return OrdinalModel(np.zeros(SLOTS, np.float32), np.full(n_grades - 1, 50.0))
    listed = sample.column("slots").combine_chunks()
    rows = np.repeat(np.arange(len(y)), np.diff(listed.offsets.to_numpy()))
    slots = listed.flatten().to_numpy().astype(np.int64)
    tells = informative(slots, rows, (y == y.max()).astype(np.int64))[slots]
    rows, slots = rows[tells], slots[tells]
    grades = y.astype(np.int64) - int(y.min()) if len(np.unique(y)) > 2 else graded(rows, slots, (y == y.max()).astype(np.int64), n_grades)
    return fit_ordinal(rows, slots, grades, int(grades.max()) + 1)


def severity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected_severity of every row. Null and empty texts have no feature and the severity that the thresholds give alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    weights, thresholds = model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(weights, thresholds)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                row, slot = features(data, offsets)
                z = np.bincount(row, weights=own.weights[slot], minlength=hi - lo)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(own.above(z).sum(axis=1))], names=["doc_id", "expected_severity"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, expected_severity double")


def judged(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """doc_id, expected_severity, severity (nearest grade), toxic (expected severity at least ``reject``) of every row."""
    x = F.col("expected_severity")
    return severity(docs, model).select("doc_id", "expected_severity", F.round(x).cast("int").alias("severity"), (x >= reject).alias("toxic"))


def below(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """The rows whose text has an expected severity below ``reject``, with all columns. Each row is judged by its own text, whatever its id."""
    place = docs.columns.index("text")
    weights, thresholds = model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        own = OrdinalModel(weights, thresholds)
        for batch in batches:
            kept = np.ones(batch.num_rows, bool)
            for lo, hi, data, offsets in text_chunks(batch.column(place).cast(pa.string())):
                row, slot = features(data, offsets)
                z = np.bincount(row, weights=own.weights[slot], minlength=hi - lo)
                kept[lo:hi] = own.above(z).sum(axis=1) < reject
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
