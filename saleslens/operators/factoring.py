"""Triangular factor of a tall table, merged in a tree, and what follows from it about dependence of columns.

Cross-products lose half of the digits, and a covariance that has lost them can't be inverted. Here every
task reduces its rows to a triangle with as many rows as there are columns, triangles are stacked
and reduced again in groups, and the last few reach the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Functions that run inside tasks are sent by value, so that executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Triangles that one task, and at the end the driver, merges.
FAN_IN = 16
#: What is left of a column after others are taken out counts as nothing below this part of it.
NOTHING = 1e-8
_TRIANGLE = "part long, n long, r binary"


def _reduced(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def triangle(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    """Number of rows without a missing value, and the triangular factor of these rows with a column of ones in front."""
    width = len(columns) + 1

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, r = 0, np.zeros((0, width))
        for batch in batches:
            values = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) for c in batch.columns)])
            n, r = n + len(values), _reduced(np.vstack([r, values]))
        if n:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([r.tobytes()], pa.binary())],
                                  names=["part", "n", "r"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, r = 0, np.zeros((0, width))
        for batch in batches:
            for more, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n, r = n + more, _reduced(np.vstack([r, np.frombuffer(data).reshape(-1, width)]))
        if n:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([r.tobytes()], pa.binary())],
                                  names=["part", "n", "r"])

    values = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    parts, count = df.select(*values).dropna().mapInArrow(reduce, _TRIANGLE), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        parts = parts.repartition(count, "part").mapInArrow(merge, _TRIANGLE)
        if count <= FAN_IN:
            break
        count = -(-count // FAN_IN)
    n, r = 0, np.zeros((0, width))
    for row in sorted(parts.collect(), key=lambda x: x["part"]):  # FAN_IN triangles at most
        n, r = n + row["n"], _reduced(np.vstack([r, np.frombuffer(row["r"]).reshape(-1, width)]))
    return n, np.vstack([r, np.zeros((max(0, width - len(r)), width))])


def inflation(n: int, r: np.ndarray) -> tuple[list[float | None], float | None]:
    """Variance inflation factor of every column and of the intercept.

    A column that others make up has an infinite factor, a constant one none; the intercept's is
    infinite where columns make up a constant. Without rows nothing has a factor.
    """
    p = r.shape[1] - 1
    # QR of the reduced rows once more, so that the column of ones is the first one whatever was stacked.
    r = np.linalg.qr(r, mode="r")
    if n == 0 or r[0, 0] == 0:
        return [None] * p, None
    centred, sums = r[1:, 1:], r[0, 1:]
    spread, size = np.linalg.norm(centred, axis=0), np.linalg.norm(r[:, 1:], axis=0)
    varies = spread > NOTHING * 1e-4 * size
    out: list[float | None] = [None] * p
    at = np.flatnonzero(varies)
    if not len(at):
        return out, None if p and (size == 0).all() else float("inf") if p else 1.0
    _, s, v = np.linalg.svd(centred[:, at] / spread[at])
    s = np.append(s, np.zeros(len(at) - len(s)))
    known = s > NOTHING * s[0]
    lost, kept = v[~known], v[known]
    dependent = (np.abs(lost) > 1e-6).any(axis=0) if len(lost) else np.zeros(len(at), bool)
    inverse = (kept / s[known, None]).T
    for j, column in enumerate(at):
        out[column] = float("inf") if dependent[j] else max(1.0, float(inverse[j] @ inverse[j]))
    level = sums[at] / spread[at]
    constant = (size[~varies] > 0).any() or (len(lost) > 0 and (np.abs(lost @ level) > 1e-6 * np.linalg.norm(level)).any())
    return out, float("inf") if constant else 1.0 + float(np.sum((level @ inverse) ** 2))
