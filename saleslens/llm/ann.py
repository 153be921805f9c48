"""Approximate nearest neighbours by shifted space-filling curves.

Each of several curves projects the vectors to a few dimensions, shifts them and orders them along a
Hilbert curve. Spark sorts every curve by range partitions; a row's place in the order is its block
and its number there. A query looks through the blocks within a window around its own place on every
curve, the best candidates of all windows are merged, and they are ranked by their exact inner
product on the original vectors.

Equal vectors are one place on the curves: the row with the smallest vec_id stands for them in the
search, and the groups found are taken apart into their rows afterwards.

The window is fitted: for a bounded sample of queries, true neighbours are found by brute force and
the window is made wide enough for the wanted recall. Neighbours that are close lie close on the
curves and need narrow windows at every size. Where vectors have no structure (neighbours hardly
nearer than others), the window, a share of the table, grows with it; nothing is cut off to avoid that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saleslens.llm.common import stored

#: Curves, dimensions of each projection and bits of each dimension; rows in a block, which is as
#: wide as the window within these bounds.
CURVES, DIMENSIONS, BITS, BLOCK, MOST_IN_BLOCK = 12, 4, 12, 512, 65_536
#: Queries that fit the window, and the recall it is to have on them.
FITTED, WANTED = 200, 0.95
SEED = 11


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of rows of non-negative integers of so many bits (Skilling's transform)."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > 1:
        p = q - one
        for i in range(n):
            set_ = (x[i] & q) != 0
            t = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << one | (x[i] >> np.uint64(b)) & one
    return out.view(np.int64)


def projections(width: int, curves: int, dimensions: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """For every curve an orthonormal projection and a shift (in cells of the unit cube)."""
    rng = np.random.default_rng(seed)
    planes = []
    for _ in range(curves):
        q, _ = np.linalg.qr(rng.normal(size=(width, min(width, dimensions))))
        planes.append(q)
    return np.stack(planes), rng.random((curves, min(width, dimensions)))


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v: the rows that take part, with vectors as doubles. Null, zero and unfinished vectors do not; of a repeated vec_id the smallest vector does."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
            .filter(~bad).filter(F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v")))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def ordered(rows: DataFrame, width: int, curves: int, dimensions: int, bits: int) -> DataFrame:
    """curve, place, vec_id, v: every row once on every curve, with its place in the order there."""
    planes, shifts = projections(width, curves, dimensions)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            for c in range(curves):
                # coordinates of unit vectors spread like 1 / sqrt(width); half of the cube is room for the shift
                at = np.clip(0.25 + unit @ planes[c] * np.sqrt(width) / 16, 0, 0.5) + shifts[c] / 2
                key = hilbert((at * ((1 << bits) - 1)).astype(np.int64), bits)
                yield pa.record_batch([pa.array(np.full(len(x), c, np.int32)), pa.array(key), batch.column(0)], names=["curve", "key", "vec_id"])

    keyed = rows.mapInArrow(keys, "curve int, key long, vec_id long")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(tasks, "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers the rows of each curve inside the partition."""
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(curves, np.int64)
        for batch in batches:
            c = batch.column(0).to_numpy()
            inside = np.zeros(len(c), np.int64)
            for k in np.unique(c):
                mine = np.flatnonzero(c == k)
                inside[mine] = seen[k] + np.arange(len(mine))
                seen[k] += len(mine)
            yield pa.record_batch([batch.column(0), pa.array(np.full(len(c), part, np.int32)), pa.array(inside), batch.column(2)], names=["curve", "part", "inside", "vec_id"])

    placed = stored(ranged.mapInArrow(number, "curve int, part int, inside long, vec_id long"))
    # a row for each partition and curve it has rows of: partitions + curves rows in all
    before = placed.groupBy("curve", "part").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (placed.join(before.select("curve", "part", "before"), ["curve", "part"])
            .select("curve", "vec_id", (F.col("before") + F.col("inside")).alias("place"))
            .join(rows, "vec_id").select("curve", "place", "vec_id", "v"))


def best_of(queries: pa.Table, rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score, slack of all rows that may be among the k best for a query, apart from itself.

    The last bits of a product depend on the order of addition; no order takes it further from ``score`` than ``slack``.
    """
    q, v = _matrix(queries.column("v")), _matrix(rows.column("v"))
    qi, vi = queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
    out = []
    q_norm, v_norm = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    for lo in range(0, len(q), 256):
        s = np.einsum("ij,kj->ik", q[lo:lo + 256], v, optimize=True)
        s[vi[None, :] == qi[lo:lo + 256, None]] = -np.inf
        slack = 4 * np.finfo(float).eps * v.shape[1] * q_norm[lo:lo + 256, None] * v_norm[None, :]
        m = min(k, s.shape[1])
        least = -np.partition(slack - s, m - 1, axis=1)[:, m - 1]
        a, b = np.nonzero((s + slack >= least[:, None]) & np.isfinite(s))
        out.append((qi[lo + a], vi[b], s[a, b], slack[a, b]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))


def scan(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the best of all rows for a bounded set of queries, by brute force; candidates of every task."""
    held = queries.select("vec_id", "v").toArrow()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and held.num_rows:
                a, b, s, _ = best_of(held, pa.table([batch.column(0), batch.column(1)], names=["vec_id", "v"]), k)
                yield pa.record_batch([pa.array(a), pa.array(b), pa.array(s)], names=["query_id", "vec_id", "score"])

    return rows.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double")


def ranked(candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query's candidates, each counted once; ties to the smaller vec_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = candidates.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def within_reach(candidates: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id: each query's candidates that may be among its k best once scores are exact, however many there are."""
    once = candidates.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("slack").alias("slack"))
    low, own = F.col("score") - F.col("slack"), Window.partitionBy("query_id")
    placed = once.withColumn("low", low).withColumn("n", F.row_number().over(own.orderBy(F.desc("low"))))
    least = F.max(F.when(F.col("n") == k, F.col("low"))).over(own)
    return placed.withColumn("least", least).filter("least is null or score + slack >= least").select("query_id", "vec_id")


def exact(candidates: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """The candidates' scores as sums in the order of the components, in double precision."""
    product = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return (candidates.join(rows.select("vec_id", "v"), "vec_id")
            .join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "query_id")
            .select("query_id", "vec_id", product.alias("score")))


def fit_window(index: DataFrame, queries: DataFrame, rows: DataFrame, k: int, fitted: int, wanted: float) -> int:
    """Places to each side that a window needs so that the wanted share of true neighbours lies in some curve's window.

    Measured on at most ``fitted`` queries against all rows.
    """
    n = queries.count()
    some = queries.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fitted / max(1, n)))).limit(fitted)
    true = stored(ranked(scan(some, rows, k), k).select("query_id", "vec_id"))
    own = index.join(true.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_semi").select(
        "curve", F.col("vec_id").alias("query_id"), F.col("place").alias("at"))
    theirs = index.join(true.select("vec_id").distinct(), "vec_id", "left_semi").select("curve", "vec_id", "place")
    apart = (true.join(own, "query_id").join(theirs, ["curve", "vec_id"])
             .groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("place") - F.col("at"))).alias("d")))
    got = [r.d for r in apart.select("d").collect()]  # fitted * k numbers at most
    return int(np.quantile(got, wanted)) + 1 if got else 1


def grouped(rows: DataFrame, most: int) -> DataFrame:
    """group, vec_id, v: the ``most`` smallest vec_ids of each group of equal vectors; group is the smallest of all."""
    same = Window.partitionBy("v")
    first = rows.withColumn("n", F.row_number().over(same.orderBy("vec_id"))).filter(F.col("n") <= most)
    return first.withColumn("group", F.min("vec_id").over(same)).select("group", "vec_id", "v")


def nearest(table: DataFrame, every: int = 20, k: int = 20, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS,
            block: int = BLOCK, fitted: int = FITTED, wanted: float = WANTED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row whose vec_id is divisible by ``every``.

    Rows are candidates of all queries but their own. Equal vectors are different candidates; a
    vec_id that occurs several times counts once, with the smallest of its vectors. Vectors of a length other than the
    commonest take no part, as no inner product with them is defined. An empty table gives no rows.
    """
    rows = stored(usable(table))
    head = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if head is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == head.w)
    members = stored(grouped(rows, k + 1))
    groups = members.filter(F.col("vec_id") == F.col("group")).select("vec_id", "v")
    asking = stored(rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
                    .join(groups.withColumnRenamed("vec_id", "group"), "v").select("query_id", "group"))
    queries = stored(groups.join(asking.select(F.col("group").alias("vec_id")).distinct(), "vec_id", "left_semi"))
    index = stored(ordered(groups, head.w, curves, dimensions, bits))
    reach = fit_window(index, queries, groups, k, fitted, wanted)
    block = min(max(block, reach), MOST_IN_BLOCK)
    place = F.col("place")
    index = index.withColumn("block", F.floor(place / block))
    asked = index.join(queries.select("vec_id"), "vec_id", "left_semi").select(*(F.col(c).alias(c) for c in ("curve", "vec_id", "v")), F.explode(F.sequence(
        F.floor(F.greatest(place - reach, F.lit(0)) / block), F.floor((place + reach) / block))).alias("block"))

    def look(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            a, b, s, slack = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        else:
            a, b, s, slack = best_of(left, right, k)
        return pa.table([pa.array(a), pa.array(b), pa.array(s), pa.array(slack)], names=["query_id", "vec_id", "score", "slack"])

    found = asked.groupBy("curve", "block").cogroup(index.select("curve", "block", "vec_id", "v").groupBy("curve", "block")).applyInArrow(
        look, "query_id long, vec_id long, score double, slack double")
    # copies of the query are its neighbours too; k other groups hold k rows at least
    near = within_reach(found, k).union(queries.select(F.col("vec_id").alias("query_id"), "vec_id"))
    best = ranked(exact(near, queries, groups), k + 1).select("query_id", F.col("vec_id").alias("group"), "score")
    each = ranked(best.join(members.select("group", "vec_id"), "group"), k + 1).select(F.col("query_id").alias("group"), "vec_id", "score")
    # one row more than k, as a query's own row is among them at most once
    return ranked(asking.join(each, "group").filter("vec_id <> query_id"), k)
