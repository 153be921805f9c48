"""Shared helpers: durable tables, and texts of a batch as flat numpy arrays.

The text helpers see a batch of texts as one array of UTF-8 bytes with offsets. Words and their
64-bit hashes come out of a few array passes, so that Python cost does not grow per word.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.session import scratch

#: Bytes of text that one array pass covers; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 20
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Later steps depend on those files only, so a lost executor costs no recomputation. Shuffle
    files of the job are let go as soon as it has ended.
    """
    spark = df.sparkSession
    path, before = scratch(spark), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Python tasks get a few megabytes of text at a time, unless the session has a size of its own."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_digest(rows: DataFrame, columns: list[str]) -> tuple[Column, Column]:
    """128 bits over the named columns, where a null is a value of its own. Maps, which have no order, are left out."""
    parts = [x for c in columns if "map<" not in rows.schema[c].dataType.simpleString() for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def worker_memo(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    return sys.__dict__.setdefault("_saleslens_memo", {}).setdefault(name, {})


def forget_others(*kept: str) -> None:
    """For the begin of a task: drop what other operators remember in this worker, and hand free memory back to the system.

    A worker lives on from stage to stage, so its memory would be the sum of what all of them keep.
    """
    import ctypes

    memo = sys.__dict__.get("_saleslens_memo", {})
    for name in [n for n in memo if n not in (*kept, "powers")]:
        del memo[name]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library, which has no such call


def chunks(lengths: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows with about ``most`` bytes each, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def flat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset:]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of bounded pieces of a column of texts."""
    data, offsets = flat_texts(column)
    for lo, hi in chunks(np.diff(offsets)):
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]


def space_table() -> np.ndarray:
    """True for the bytes that separate words: space and 09 to 0D."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def letter_table() -> np.ndarray:
    """True for every byte that is not an ASCII letter, digit or part of a longer character."""
    out = np.ones(256, bool)
    for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        out[lo:hi] = False
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every text (with the total at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    held = worker_memo("powers")
    have = held.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            held[base] = have
    return have[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each word: a polynomial over the bytes, mixed."""
    base = int(_RADIX)
    inverse = pow(base, -1, 1 << 64)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, len(data)), out=prefix[1:])
    return mixed((prefix[ends] - prefix[starts]) * _powers(inverse, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def grams(hashes: np.ndarray, n: int, radix: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words (empty if there are fewer)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = len(hashes) - n + 1
    out, done, span, part = None, 0, 1, hashes
    while True:  # runs of 1, 2, 4, ... words, added up to n
        if n & span:
            piece = part[done:done + total] * np.uint64(pow(radix, done, 1 << 64))
            out = piece if out is None else out + piece
            done += span
        if done == n:
            return mixed(out)
        part = part[:-span] + part[span:] * np.uint64(pow(radix, span, 1 << 64))
        span *= 2


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b) of integers.

    Each round every node takes the smallest label among itself and its neighbours and then the
    label of that label, so that long chains need few rounds. Labels and edges stay distributed
    and each round is written to the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .filter("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("component")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m")))
        stepped = (labels.join(near, "node", "left")
                   .select("node", F.col("component").alias("old"), F.least("component", "m").alias("to")))
        jumped = (stepped.join(labels.select(F.col("node").alias("to"), F.col("component").alias("far")), "to", "left")
                  .select("node", "old", F.least("to", "far").alias("component")))
        jumped = stored(jumped)
        changed = jumped.filter("old <> component").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
