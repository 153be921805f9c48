"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own character and word statistics and those of
its neighbours; transitions tie consecutive lines together. The forward-backward marginals, weighted
by the length of the lines, give the share of good text, which a logistic curve turns into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import letter_table, lower_ascii, text_chunks, text_or_empty, word_bounds, word_hashes
from saleslens.llm.toxicity import labelled_sample

#: Labelled documents of each class that the fit may use, whole.
PER_CLASS = 2000
PREDICT = 0.7
OWN = 11  # statistics of a line


def line_statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics of every line, its length in bytes, and the first line of each text. An empty text is one empty line."""
    size = len(data)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    # a line break at the very end of a text begins a line with the next text; equal starts are then two lines
    text = np.sort(np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1]))
    firsts = np.searchsorted(text, np.arange(len(offsets)))
    ends = np.append(starts[1:], size)
    ends = np.minimum(ends, offsets[text + 1])
    length = np.maximum(ends - starts, 0)

    def share(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag)))
        return (total[ends] - total[starts]) / np.maximum(length, 1)

    upper = (data >= 65) & (data <= 90)
    letter = upper | (data >= 97) & (data <= 122) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    space = (data == 32) | (data >= 9) & (data <= 13)
    stop = (data == 46) | (data == 44)
    mark = ~letter & ~digit & ~space & ~stop
    low = lower_ascii(data)
    w0, w1, _ = word_bounds(low, starts_of(starts, size), letter_table())
    of = np.searchsorted(starts, w0, "right") - 1
    h = word_hashes(low, w0, w1)
    n = np.bincount(of, minlength=len(starts)).astype(float)
    same = np.bincount(of[1:], weights=(h[1:] == h[:-1]) & (of[1:] == of[:-1]), minlength=len(starts)) if len(h) > 1 else np.zeros(len(starts))
    order = np.lexsort((h, of))
    fresh = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1]))) if len(h) else np.zeros(0, bool)
    distinct = np.bincount(of[order][fresh], minlength=len(starts)) if len(h) else np.zeros(len(starts))
    stats = np.stack([
        np.log1p(length) / 8, share(mark), share(upper), share(digit), share(space), share(stop),
        share(data == 124) * 5, share((data == 33) | (data == 36) | (data == 37) | (data == 35) | (data == 38) | (data == 42)) * 2,
        same / np.maximum(n, 1), distinct / np.maximum(n, 1), (length == 0).astype(float)], axis=1)
    return stats, length, firsts


def starts_of(starts: np.ndarray, size: int) -> np.ndarray:
    return np.append(starts, size)


def inputs(stats: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A constant, the statistics of each line and their squares, of the line before and of the line after (zero at the ends of a text)."""
    n = len(stats)
    first = np.zeros(n, bool)
    first[firsts[:-1]] = True
    last = np.zeros(n, bool)
    last[firsts[1:] - 1] = True
    before = np.concatenate([np.zeros((1, OWN)), stats[:-1]]) if n else stats
    after = np.concatenate([stats[1:], np.zeros((1, OWN))]) if n else stats
    return np.concatenate([np.ones((n, 1)), stats, np.sqrt(stats), np.where(first[:, None], 0, before), np.where(last[:, None], 0, after)], axis=1)


def _log_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def by_place(firsts: np.ndarray) -> Iterator[np.ndarray]:
    """Lines that are first in their text, then second, and so on; texts in the order of their length."""
    n = np.diff(firsts)
    order = np.argsort(-n, kind="stable")
    longest = n[order]
    for k in range(int(longest[0]) if len(n) else 0):
        yield firsts[order[:np.searchsorted(-longest, -k, "left")]] + k


def forward_backward(emit: np.ndarray, step: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, expected transitions (2 by 2), and the logarithm of the partition sum over all texts.

    ``emit`` is the score of good against bad of each line, ``step`` the scores of transitions.
    """
    places = list(by_place(firsts))
    scores = np.stack([np.zeros(len(emit)), emit], axis=1)
    ahead = scores.copy()
    for at in places[1:]:
        before = ahead[at - 1]
        ahead[at] += np.stack([_log_plus(before[:, 0] + step[0, y], before[:, 1] + step[1, y]) for y in (0, 1)], axis=1)
    behind = np.zeros_like(scores)
    for at in reversed(places[1:]):
        after = behind[at] + scores[at]
        behind[at - 1] = np.stack([_log_plus(after[:, 0] + step[y, 0], after[:, 1] + step[y, 1]) for y in (0, 1)], axis=1)
    both = ahead + behind
    total = _log_plus(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    moves = np.zeros((2, 2))
    inner = np.concatenate(places[1:]) if len(places) > 1 else np.zeros(0, np.int64)
    for a in (0, 1):
        for b in (0, 1):
            moves[a, b] = np.exp(ahead[inner - 1, a] + step[a, b] + scores[inner, b] + behind[inner, b] - total[inner]).sum()
    return good, moves, float(total[firsts[:-1]].sum()) if len(firsts) > 1 else 0.0


@dataclass
class LineField:
    weights: np.ndarray
    step: np.ndarray
    slope: float  # of the logistic curve over the length-weighted share of good text
    level: float

    def scores(self, stats: np.ndarray, length: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        share = self.share(stats, length, firsts)
        return 1 / (1 + np.exp(np.clip(-(self.slope * share + self.level), -60, 60)))

    def share(self, stats: np.ndarray, length: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        if len(firsts) < 2:
            return np.zeros(0)
        good, _, _ = forward_backward(inputs(stats, firsts) @ self.weights, self.step, firsts)
        weight = length + 1.0
        return np.add.reduceat(good * weight, firsts[:-1]) / np.add.reduceat(weight, firsts[:-1])


def fit_field(stats: np.ndarray, length: np.ndarray, firsts: np.ndarray, y: np.ndarray, rounds: int = 250, rate: float = 0.1, penalty: float = 1e-4) -> LineField:
    """Conditional likelihood with every line labelled as its document, classes weighted evenly, by Adam.

    The curve over the share of good text is a logistic regression on the same documents.
    """
    x = inputs(stats, firsts)
    n = np.diff(firsts)
    line_y = np.repeat(y, n).astype(float)
    parts = []
    for c in (0, 1):
        rows = np.flatnonzero(y == c)
        lines = np.concatenate([np.arange(firsts[i], firsts[i + 1]) for i in rows])
        parts.append((x[lines], line_y[lines], np.concatenate(([0], np.cumsum(n[rows]))), len(lines)))
    w, step = np.zeros(x.shape[1]), np.zeros((2, 2))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, step)]
    for t in range(1, rounds + 1):
        dw, ds = penalty * w, penalty * step
        for xs, ys, fs, count in parts:
            good, moves, _ = forward_backward(xs @ w, step, fs)
            dw = dw + xs.T @ (good - ys) / count
            inner = np.ones(count, bool)
            inner[fs[:-1]] = False
            at = np.flatnonzero(inner)
            seen = np.zeros((2, 2))
            np.add.at(seen, (ys[at - 1].astype(int), ys[at].astype(int)), 1)
            ds = ds + (moves - seen) / count
        for p_, g, m in zip((w, step), (dw, ds), moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            p_ -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8)
    field = LineField(w, step, 1.0, 0.0)
    share = field.share(stats, length, firsts)
    cost = (len(y) / np.maximum(np.bincount(y, minlength=2), 1) / 2)[y]
    a, b = 4.0, -2.0
    for _ in range(60):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * share + b, -30, 30)))
        r, s = cost * (p - y), cost * p * (1 - p) + 1e-9
        ga, gb = (r * share).sum() + 1e-3 * a, r.sum() + 1e-3 * b
        haa, hab, hbb = (s * share * share).sum() + 1e-3, (s * share).sum(), s.sum() + 1e-3
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return LineField(w, step, float(a), float(b))


def held_out() -> F.Column:
    """True for the documents whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> LineField:
    """Fit on at most about ``per_class`` labelled documents of each class that are not held out, on all their lines.

    Executors make the statistics of the lines. Without two classes nothing can be learnt, and every score is one half.
    """
    own = labels.filter(~held_out())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(0)):
                stats, length, firsts = line_statistics(data, offsets)
                lines = [slice(a, b) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
                yield pa.record_batch([batch.column(1).slice(lo, hi - lo), pa.array([stats[k].tobytes() for k in lines], pa.binary()),
                                       pa.array([length[k].tobytes() for k in lines], pa.binary())], names=["y", "stats", "length"])

    sample = labelled_sample(docs, own, label, per_class).select("text", "y").mapInArrow(run, "y int, stats binary, length binary").toArrow()
    y = sample.column("y").to_numpy()
    if len(np.unique(y)) < 2:
        return LineField(np.zeros(4 * OWN + 1), np.zeros((2, 2)), 0.0, 0.0)
    stats = np.frombuffer(b"".join(sample.column("stats").to_pylist()), np.float64).reshape(-1, OWN)
    parts = sample.column("length").to_pylist()
    length = np.frombuffer(b"".join(parts), np.int64)
    firsts = np.concatenate(([0], np.cumsum([len(p) // 8 for p in parts])))
    return fit_field(stats, length, firsts, (y == y.max()).astype(np.int64))


def scored(docs: DataFrame, field: LineField, predict: float = PREDICT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its text alone. Null and empty texts count as one empty line; repeated rows stay."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = (field.weights, field.step, field.slope, field.level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LineField(*parts)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(own.scores(*line_statistics(data, offsets)))], names=["doc_id", "score"])

    return (docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= predict).cast("int").alias("predicted")))
