"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints within Hamming distance 2r share a value within distance r of both. So every
distinct fingerprint emits all values in its ball of radius r; equal values meet in one bucket of
the shuffle. All fingerprints that share a value are within 2r of each other, hence each such group
needs links to its smallest member only. Links are verified, thinned to stars, and components are
found on them.

A value and the flips that lead to it fill 64 bits: the bucket holds the leading bits, the rest is
packed with the number of the flips, and a task sends one array for each group of buckets. The
groups are worked off in slices, so that the shuffle of one slice is gone before the next begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saleslens.llm.common import connected, flat_texts, row_digest, stored

SHINGLE = 4
RADIUS = 2
_ODD = 0x9E3779B97F4A7C15
#: Values that a group of buckets is to hold, and slices that the shuffle is cut into.
PER_GROUP, SLICES = 1_000_000, 8


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash over word shingles: a bit is set if it is in over half of the shingles' XXH64 (seed 42)."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist(), strict=False)]
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[lo:lo + (1 << 16)], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_texts(batch.column(1))
            whole = data.tobytes()
            out = np.array([fingerprint(whole[a:b], shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def flips(radius: int) -> np.ndarray:
    """Masks of all changes of up to ``radius`` bits; the place in this array is the number of the flips."""
    masks = [0]
    for n in range(1, radius + 1):
        masks += [reduce(lambda a, b: a | 1 << b, bits, 0) for bits in combinations(range(64), n)]
    return np.array(masks, np.uint64)


def _pairs_of_bucket(packed: np.ndarray, bucket: int, bits: int, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (smallest, other) among the fingerprints that share a value of the bucket."""
    code = np.uint64(max(1, int(len(masks) - 1).bit_length()))
    packed = np.sort(packed)
    rest = packed >> code
    new = np.concatenate(([True], rest[1:] != rest[:-1]))
    group = np.cumsum(new) - 1
    several = (np.bincount(group) > 1)[group]
    if not several.any():
        none = np.zeros(0, np.uint64)
        return none, none
    packed, rest, group = packed[several], rest[several], group[several]
    value = (np.uint64(bucket << (64 - bits)) | rest) * np.uint64(pow(_ODD, -1, 1 << 64))
    fp = value ^ masks[(packed & np.uint64((1 << int(code)) - 1)).astype(np.int64)]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.minimum.reduceat(fp, first)
    a = np.repeat(least, np.diff(np.append(first, len(fp))))
    apart = np.bitwise_count(a ^ fp)
    keep = (a != fp) & (apart <= 2 * RADIUS)
    both = np.unique(np.stack([a[keep], fp[keep]], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (smallest of the component, other) that join the same nodes as the links given, one for each other node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, x, label[y])
        np.minimum.at(least, y, label[x])
        least = least[least]
        if (least == label).all():
            break
        label = least
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def links(distinct: DataFrame, radius: int = RADIUS, per_group: int = PER_GROUP, slices: int = SLICES) -> DataFrame:
    """Links (a, b) between different fingerprints ``fp`` that join those at distance 2 * radius or less, directly or by way of others.

    Verified links of a group of buckets are replaced by stars around the smallest fingerprint of
    each component there. Groups that see the same dense cluster then give the same links, and a
    cluster of n fingerprints has a few times n of them, not one for each pair.

    A value has 64 - bits significant bits in its bucket, which leaves the low ``bits`` free for the
    number of the flips. Fingerprints are dealt to buckets after an odd multiplication, which spreads
    similar ones and can be undone. Groups of buckets grow in number with the table.
    """
    masks = flips(radius)
    code = max(1, int(len(masks) - 1).bit_length())
    total = distinct.count() * len(masks)
    group_bits = max(int(slices).bit_length(), (total // per_group).bit_length())
    bits = max(code, group_bits)
    per = 1 << (bits - group_bits)  # buckets in a group

    def emit(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for lo in range(0, len(all_fps), 512):
                    fps = all_fps[lo:lo + 512]
                    value = ((fps[:, None] ^ masks[None, :]) * np.uint64(_ODD)).ravel()
                    mine = np.flatnonzero((value >> np.uint64(64 - group_bits)) % np.uint64(slices) == np.uint64(turn))
                    value, number = value[mine], (mine % len(masks)).astype(np.uint64)
                    bucket = (value >> np.uint64(64 - bits)).astype(np.int64)
                    packed = (value & np.uint64((1 << (64 - bits)) - 1)) << np.uint64(code) | number
                    order = np.argsort(bucket, kind="stable")
                    packed, bucket = packed[order], bucket[order]
                    group = bucket // per
                    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
                    ends = np.append(starts[1:], len(group))
                    sizes = [np.bincount(bucket[a:b] % per, minlength=per).astype(np.int32).tobytes() for a, b in zip(starts, ends, strict=True)]
                    blobs = [packed[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                    yield pa.record_batch([pa.array(group[starts]), pa.array(sizes, pa.binary()), pa.array(blobs, pa.binary())],
                                          names=["group", "sizes", "packed"])
        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; one group is in memory at a time."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def done() -> pa.RecordBatch:
            found = []
            for j in range(per):
                part = np.concatenate([packed[ends[j] - size[j]:ends[j]] for packed, size, ends in held])
                if len(part):
                    found.append(_pairs_of_bucket(part, now * per + j, bits, masks))
            a, b = _stars(*(np.concatenate(x) for x in zip(*found, strict=True)))
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            for group, sizes, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != now and held:
                    yield done()
                    held = []
                now = group
                size = np.frombuffer(sizes, np.int32).astype(np.int64)
                held.append((np.frombuffer(packed, np.uint64), size, np.cumsum(size)))
        if held:
            yield done()

    found = []
    for turn in range(slices):
        sent = distinct.select("fp").mapInArrow(emit(turn), "group long, sizes binary, packed binary")
        met = sent.repartition("group").sortWithinPartitions("group").mapInArrow(meet, "a long, b long")
        found.append(stored(met.distinct()))
    return reduce(DataFrame.union, found).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row.

    Null and empty texts have fingerprint zero and are linked like any other. Equal fingerprints are
    one node, so copies are never paired with each other. Repeated rows keep their place in the
    result; a row without doc_id has no identity and gets a null component if it stands alone.
    """
    fps = stored(fingerprints(docs))
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected(links(nodes))
    labelled = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = labelled.join(smallest, "component").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest id, among equal ids that with the smallest digest of id and text.

    Rows without doc_id come last, so one of them stays only where its component has no id. Of rows
    alike in id and text one stays.
    """
    keyed = docs.withColumns(dict(zip(("__k1", "__k2"), row_digest(docs, ["doc_id", "text"]), strict=True)))
    own = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), "__k1", "__k2")
    found = near_duplicates(keyed.select(own.alias("doc_id"), "text")).filter(F.col("doc_id") == F.col("component_id"))
    kept = stored(found.groupBy(F.col("doc_id.__k1").alias("__k1"), F.col("doc_id.__k2").alias("__k2")).agg(F.count("*").alias("__n")))
    once = keyed.join(kept.filter("__n = 1").select("__k1", "__k2"), ["__k1", "__k2"], "left_semi").select(docs.columns)
    if not kept.filter("__n > 1").head(1):
        return once
    first = Window.partitionBy("__k1", "__k2").orderBy(*row_digest(docs, [c for c in docs.columns if c not in ("doc_id", "text")]))
    several = keyed.join(kept.filter("__n > 1").select("__k1", "__k2"), ["__k1", "__k2"], "left_semi")
    return once.union(several.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(docs.columns))
