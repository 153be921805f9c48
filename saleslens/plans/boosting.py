"""Boosted trees with second-order gains over binned features, many models in the same passes.

Features are cut into bins once. A tree grows level by level from sums of gradients and hessians per
node and bin; columns are drawn once per tree, rows by a hash of their key, missing values go to the
better side of each split. Gradients are whole multiples of ``QUANTUM``, so sums are exact: a model does
not depend on the order of rows, on the number of tasks, or on which of two ways it was trained:

- ``in passes``: one job for each level sums the histograms of all models over all rows at once. Tasks hold
  blocks of rows; what they send on is keyed by model and node and summed and split by the receivers,
  so the driver sees one row for each node that was split.
- ``in tasks``: a binned table of ``IN_TASK_CELLS`` cells at most, which is checked, is broadcast and each task
  grows whole models. A search over a small table is thousands of levels, and a job for each would
  cost more than the work in it.

Settings that differ in the number of trees alone are prefixes of one model, which is trained once.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.session import durable

# Functions that run inside tasks are sent by value, so that executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins of a feature at most, rows of a block at most, cells of a table that may be broadcast.
MAX_BINS, BLOCK_ROWS, IN_TASK_CELLS = 64, 1 << 16, 1 << 25
#: Joint bins of features that are counted together at most, and where nodes are many for the rows in them.
JOINT_BINS, FEW_JOINT_BINS = 1 << 13, 1 << 11
#: Rows that are taken at a time, so that what is reckoned of them stays near the core; nodes up to which a level is stepped node by node.
NEAR_ROWS, FEW_NODES = 1 << 15, 16
#: Trees that are applied anew in every pass before the margins are written, for training in passes.
PENDING = 8
QUANTUM = 2.0 ** -24
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Setting:
    """What a model is trained with. ``rows`` and ``columns`` are the parts drawn for each tree."""

    trees: int = 100
    depth: int = 3
    rate: float = 0.2
    rows: float = 1.0
    columns: float = 0.7
    l2: float = 1.0
    least_hessian: float = 1.0
    least_gain: float = 1e-6
    seed: int = 42


# -- draws ------------------------------------------------------------------------------------------

def _near(n: int, run: int | None = None) -> Iterator[slice]:
    """Rows in runs, of ``NEAR_ROWS`` by default."""
    run = run or NEAR_ROWS
    return (slice(lo, min(lo + run, n)) for lo in range(0, n, run))


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit numbers from any."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _stream(setting: Setting, tree: int, purpose: int) -> np.uint64:
    return np.uint64(((setting.seed * 4 + purpose) * 1_000_003 + tree + 1) * int(_MIX[2]) & (1 << 64) - 1)


def drawn_rows(setting: Setting, tree: int, hashes: np.ndarray) -> np.ndarray:
    """Which rows a tree sees. A smaller part is within a larger one."""
    if setting.rows >= 1:
        return np.ones(len(hashes), bool)
    out, stream = np.empty(len(hashes), bool), _stream(setting, tree, 1)
    most = np.uint64(math.ceil(setting.rows * 2.0 ** 53))
    for near in _near(len(hashes)):
        np.less(mixed(hashes[near] + stream) >> np.uint64(11), most, out=out[near])
    return out


def drawn_columns(setting: Setting, tree: int, n: int) -> np.ndarray:
    """The features a tree may split on."""
    kept = max(1, int(setting.columns * n))
    order = np.argsort(mixed(np.arange(n, dtype=np.uint64) * _MIX[2] + _stream(setting, tree, 2)), kind="stable")
    return np.sort(order[:kept])


# -- bins -------------------------------------------------------------------------------------------

@dataclass
class Layout:
    """Where the bins of each feature lie in one long row: its values' bins first, that of missing values last."""

    features: list[str]
    cuts: list[np.ndarray]

    def __post_init__(self) -> None:
        self.missing = np.array([len(c) + 1 for c in self.cuts])
        self.first = np.concatenate(([0], np.cumsum(self.missing + 1)))
        self.total = int(self.first[-1])
        self.feature = np.repeat(np.arange(len(self.cuts)), self.missing + 1)
        self.bin = np.arange(self.total) - self.first[self.feature]
        #: A split after the last value's bin, or after the bin of missing values, would leave nothing on one side.
        self.splits = self.bin < (self.missing - 1)[self.feature]
        self.joint = self.grouped(range(len(self.cuts)))

    def grouped(self, features: Sequence[int], most: int = JOINT_BINS) -> list[list[int]]:
        """Features that are counted together. The sums per bin of each follow from those per joint bin."""
        groups: list[list[int]] = []
        for f in sorted(features, key=lambda f: -self.missing[f]):
            room = next((j for j in groups if self.joint_bins([*j, f]) <= most), None)
            if room is None:
                groups.append([f])
            else:
                room.append(f)
        return groups

    def joint_bins(self, features: Sequence[int]) -> int:
        return math.prod((self.missing[features] + 1).tolist())

    def joined(self, bins: np.ndarray) -> Joined:
        return Joined(self, bins)

    def binned(self, values: np.ndarray) -> np.ndarray:
        """Bins of a matrix of values; a value is in the first bin whose cut it does not exceed, NaN is missing."""
        out = np.zeros(values.shape, np.uint8, order="F")
        for j, cuts in enumerate(self.cuts):
            column = values[:, j]
            out[:, j] = np.where(np.isnan(column), len(cuts) + 1, np.searchsorted(cuts, column))
        return out


class Joined:
    """Joint bins of rows, reckoned for those features that are asked for."""

    def __init__(self, layout: Layout, bins: np.ndarray) -> None:
        self.layout, self.bins, self.columns = layout, bins, ()
        self.groups: dict[int, list[list[int]]] = {}
        self.lines: dict[int, list[np.ndarray]] = {}
        self.room: dict[str, np.ndarray] = {}

    def space(self, name: str, kind: type) -> np.ndarray:
        """The same memory in every tree, for a number per row."""
        if name not in self.room or self.room[name].dtype != kind:
            self.room[name] = np.empty(len(self.bins), kind)
        return self.room[name]

    def grouped(self, columns: Sequence[int], most: int) -> list[list[int]]:
        """The groups that the columns are counted in, of ``most`` joint bins; 0 for each by itself."""
        if self.columns != (columns := tuple(columns)):
            self.columns, self.groups, self.lines = columns, {0: [[f] for f in columns]}, {}
        if most not in self.groups:
            self.groups[most] = self.layout.grouped(columns, most)
        return self.groups[most]

    def of(self, columns: Sequence[int], most: int) -> list[np.ndarray]:
        """The joint bin of every row, a line for each group."""
        groups = self.grouped(columns, most)
        if most not in self.lines:
            self.lines[most] = [self.line(features) for features in groups]
        return self.lines[most]

    def cost(self, columns: Sequence[int], most: int, rows: int, nodes: int) -> float:
        """Of counting some rows in such groups, about: rows and joint bins that are gone through, and lines that are not reckoned yet."""
        groups = self.grouped(columns, most)
        return len(groups) * (rows + (most not in self.lines and most > 0) * len(self.bins) / 4) + nodes * sum(map(self.layout.joint_bins, groups))

    def line(self, features: Sequence[int]) -> np.ndarray:
        if len(features) == 1:
            return self.bins[:, features[0]]
        out = np.empty(len(self.bins), np.uint16)
        for near in _near(len(out)):
            line = self.bins[near, features[0]].astype(np.uint16)
            for f in features[1:]:
                line *= np.uint16(self.layout.missing[f] + 1)
                line += self.bins[near, f]
            out[near] = line
        return out


def layout_of(table: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> Layout:
    """Cuts at quantiles of each feature, all in one pass; a value that takes more than a bin's share has one of its own."""
    if not 2 <= max_bins <= 254:
        raise ValueError("2 to 254 bins")
    parts = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins)])
    values = table.select(F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("place", "value"))
    # Each feature is a group, so that the sketches of the tasks are merged in as many tasks as there are features.
    found = dict(values.where(~F.isnan("value")).groupBy("place").agg(F.percentile_approx("value", parts, F.lit(100_000))).collect())
    return Layout(list(features), [np.unique(np.array(found.get(i) or [], float)) for i in range(len(features))])


@dataclass
class Binned:
    """Blocks of binned rows as a table, and how many rows there are."""

    blocks: DataFrame
    layout: Layout
    rows: int
    key: str

    @property
    def cells(self) -> int:
        return self.rows * len(self.layout.features)


@dataclass
class Block:
    """Some rows: keys (left out where nothing is scored), hashes of keys, labels, folds and bins, a feature's side by side."""

    keys: pa.Array | None
    hashes: np.ndarray
    labels: np.ndarray
    folds: np.ndarray
    bins: np.ndarray
    margins: dict[int, np.ndarray] = field(default_factory=dict)

    def packed(self) -> bytes:
        """All but the keys."""
        return pickle.dumps((self.hashes, self.labels, self.folds, self.bins, self.margins), protocol=5)

    def packed_keys(self) -> bytes:
        return pickle.dumps(self.keys.to_pylist(), protocol=5)

    @classmethod
    def unpacked(cls, data: bytes, keys: bytes | None = None) -> Block:
        return cls(None if keys is None else pa.array(pickle.loads(keys)), *pickle.loads(data))

    @classmethod
    def joined(cls, blocks: Sequence[Block]) -> Block:
        arrays = [np.concatenate([getattr(b, n) for b in blocks]) for n in ("hashes", "labels", "folds", "bins")]
        return cls(pa.concat_arrays([b.keys for b in blocks]), *arrays)


BLOCKS = "block binary, keys binary, rows long"


def binned(table: DataFrame, features: Sequence[str], key: str = "user_id", label: str = "label", fold: str | None = None,
           max_bins: int = MAX_BINS, block_rows: int = BLOCK_ROWS) -> Binned:
    """Cut the features of a table into bins and pack its rows into blocks. Null and NaN are missing values."""
    layout = layout_of(table, features, max_bins)
    columns = [F.col(key), F.xxhash64(key).alias("_hash"), F.col(label).cast("double").alias("_label"),
               (F.lit(0) if fold is None else F.col(fold)).cast("int").alias("_fold"),
               *[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"_f{i}") for i, f in enumerate(features)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            hashes, labels, folds = (t.column(i).to_numpy() for i in (1, 2, 3))
            values = np.stack([t.column(4 + i).to_numpy() for i in range(len(layout.features))], axis=1)
            block = Block(t.column(0).combine_chunks(), hashes.view(np.uint64), labels, folds, layout.binned(values))
            return pa.record_batch([pa.array([block.packed()], pa.binary()), pa.array([block.packed_keys()], pa.binary()), pa.array([t.num_rows], pa.int64())],
                                   names=["block", "keys", "rows"])

        held, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, block_rows):
                part = batch.slice(lo, block_rows)
                if held and n + part.num_rows > block_rows:
                    yield made(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield made(held)

    blocks = durable(table.select(*columns).mapInArrow(run, BLOCKS))
    return Binned(blocks, layout, blocks.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], key)


# -- trees ------------------------------------------------------------------------------------------

@dataclass
class Tree:
    """A tree in heap order: node i has the children 2i + 1 and 2i + 2. A feature of -1 is a leaf, or no node where the cover is 0."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    gradient: np.ndarray
    hessian: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), *(np.zeros(n) for _ in range(4)))

    def split(self, active: np.ndarray, found: dict[str, np.ndarray], setting: Setting) -> np.ndarray:
        """Note the splits of the active nodes; returns the children that could be split further."""
        gained = found["gain"] > setting.least_gain
        nodes = active[gained]
        self.feature[nodes], self.bin[nodes] = found["feature"][gained], found["bin"][gained]
        self.missing_left[nodes], self.gain[nodes] = found["missing_left"][gained], found["gain"][gained]
        left, right = 2 * nodes + 1, 2 * nodes + 2
        for own, part in (("gradient", "g"), ("hessian", "h")):
            sums = getattr(self, own)
            sums[left] = found[part][gained]
            sums[right] = sums[nodes] - sums[left]
        children = np.sort(np.concatenate([left, right]))
        return children[self.hessian[children] >= 2 * setting.least_hessian]

    def finished(self, setting: Setting) -> Tree:
        self.value[:] = -self.gradient / (self.hessian + setting.l2) * setting.rate
        return self

    def arrays(self) -> tuple[np.ndarray, ...]:
        """The tree as plain arrays, to be sent."""
        return tuple(self.__dict__.values())

    @property
    def depth(self) -> int:
        return (len(self.feature) + 1).bit_length() - 2

    def start(self, n: int) -> np.ndarray:
        """Places of rows at the root."""
        return np.zeros(n, np.uint8 if self.depth <= 8 else np.int64)

    def step(self, place: np.ndarray, level: int, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """Places of rows in the next level from those in this one; below a leaf they go on to the left."""
        first = 2 ** level - 1
        nodes = np.flatnonzero(self.feature[first:2 * first + 1] >= 0)
        if len(nodes) > FEW_NODES and bins.flags.f_contiguous:
            return self.step_by_table(place, level, bins, missing)
        out = place * 2
        for near in _near(len(place)) if len(nodes) else ():
            at, right = place[near], np.zeros(len(place[near]), bool)
            for j in nodes.tolist():
                goes = self.goes_right(first + j, bins[near], missing)
                if level:
                    goes &= at == j
                right |= goes
            out[near] += right
        return out

    def step_by_table(self, place: np.ndarray, level: int, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """The same for many nodes: each row's bin is looked up in the column of its node, its side in a table of nodes and bins."""
        nodes, values = slice(2 ** level - 1, 2 ** (level + 1) - 1), np.arange(256)
        feature = np.maximum(self.feature[nodes], 0)
        right = (values > self.bin[nodes, None]) & (self.feature[nodes, None] >= 0)
        right &= ~(self.missing_left[nodes, None] & (values == missing[feature][:, None]))
        sides, starts, flat, out = right.view(np.uint8).ravel(), feature.astype(np.int64) * len(bins), bins.T.reshape(-1), place * 2
        for near in _near(len(place)):
            where = starts.take(place[near], mode="clip")
            where += np.arange(near.start, near.stop)
            row = place[near].astype(np.uint16 if len(feature) <= 256 else np.int64)
            row *= 256
            row += flat.take(where, mode="clip")
            out[near] += sides.take(row, mode="clip")
        return out

    def goes_right(self, node: int, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
        f = self.feature[node]
        right = bins[:, f] > int(self.bin[node])
        if self.missing_left[node]:
            right &= bins[:, f] != int(missing[f])
        return right

    def ends(self) -> np.ndarray:
        """The leaf that each place of the last level belongs to."""
        place, node = np.arange(2 ** self.depth), np.zeros(2 ** self.depth, np.int64)
        for level in range(self.depth):
            node = np.where(self.feature[node] >= 0, 2 * node + 1 + (place >> self.depth - 1 - level & 1), node)
        return node

    def places(self, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
        place = self.start(len(bins))
        for level in range(self.depth):
            place = self.step(place, level, bins, missing)
        return place

    def leaves(self, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
        return self.ends()[self.places(bins, missing)]

    def values(self, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
        return self.value[self.ends()][self.places(bins, missing)]


def gradients(margin: np.ndarray, labels: np.ndarray, room: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the logistic loss, in whole quanta."""
    g, h = room or (np.empty(len(margin)), np.empty(len(margin)))
    for near in _near(len(margin), NEAR_ROWS // 4):
        p, one, two = -margin[near], g[near], h[near]
        np.exp(p, out=p)
        p += 1
        np.divide(1, p, out=p)
        np.subtract(p, labels[near], out=one)
        one *= 1 / QUANTUM
        np.rint(one, out=one)
        np.subtract(1, p, out=two)
        two *= p
        np.maximum(two, QUANTUM, out=two)
        two *= 1 / QUANTUM
        np.rint(two, out=two)
    return g, h


def histogram(layout: Layout, bins: np.ndarray, joined: Joined, at: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Quanta of gradient and hessian per node (``at`` numbers the nodes, -1 is none) and bin, as whole numbers; 0 for other than the ``columns``.

    Several features are counted in one go by their joint bins, unless these are so many that it is cheaper to look at the rows more often.
    All groups are counted over a run of rows before the next, so that weights and places are near.
    """
    columns, n = columns.tolist(), int(np.count_nonzero(at >= 0))
    most = min((JOINT_BINS, FEW_JOINT_BINS, 0), key=lambda most: joined.cost(columns, most, n, nodes))
    groups, lines = joined.grouped(columns, most), joined.of(columns, most) if most else [bins[:, f] for f in columns]
    sizes = [layout.joint_bins(features) for features in groups]
    counted = [np.zeros((2, nodes * size)) for size in sizes]
    run = NEAR_ROWS  # longer where few rows are counted, or many bins
    while run < len(at) and run * n < 2 * nodes * max(sizes) * len(at):
        run *= 2
    for near in _near(len(at), run):
        number, weights, some = at[near], (g[near], h[near]), None
        if n < len(at):
            some = np.flatnonzero(number >= 0)
            number, weights = number.take(some, mode="clip"), [w.take(some, mode="clip") for w in weights]
        if nodes > 1:
            number = number.astype(np.int64)
        for size, line, sums in zip(sizes, lines, counted, strict=True):
            values = line[near] if some is None else line[near].take(some, mode="clip")
            if nodes > 1:
                place = number * size
                place += values
            else:
                place = values.astype(np.int64)
            for k, weight in enumerate(weights):
                sums[k] += np.bincount(place, weight, nodes * size)
    out = np.zeros((2, nodes, layout.total), np.int64)
    for features, sums in zip(groups, counted, strict=True):
        sums = sums.reshape(2 * nodes, -1)
        for f in features:
            # Before its turn a feature is the first axis that is left; it is summed over what follows, then summed away.
            sums = sums.reshape(2 * nodes, layout.missing[f] + 1, -1)
            out[:, :, layout.first[f]:layout.first[f + 1]] = sums.sum(axis=2).reshape(2, nodes, -1)
            sums = sums.sum(axis=1)
    return out


def best_splits(layout: Layout, sums: np.ndarray, columns: np.ndarray, setting: Setting) -> dict[str, np.ndarray]:
    """The best split of each node from its sums: gain, feature, bin, side of missing values, sums of the left child; also the node's own.

    On ties the first feature counts, then the first bin, then missing values on the right.
    """
    some = np.isin(layout.feature, columns)
    feature, bins = layout.feature[some], layout.bin[some]
    ends = np.cumsum(layout.missing[columns] + 1)
    own = np.repeat(np.arange(len(columns)), layout.missing[columns] + 1)
    g, h = sums[:, :, some] * QUANTUM
    total_g, total_h = (x[:, :ends[0]].sum(axis=1) for x in (g, h))

    def left(x: np.ndarray) -> np.ndarray:
        run = np.cumsum(x, axis=1)
        run = run - np.concatenate([np.zeros((len(x), 1)), run[:, ends[:-1] - 1]], axis=1)[:, own]
        return np.stack([run, run + x[:, ends - 1][:, own]], axis=2)

    gl, hl = left(g), left(h)
    gr, hr = total_g[:, None, None] - gl, total_h[:, None, None] - hl
    l2 = setting.l2
    with np.errstate(divide="ignore", invalid="ignore"):  # places that are no splits are left out below
        gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - (total_g * total_g / (total_h + l2))[:, None, None]
    # The last bin of values may be split off from missing values alone.
    allowed = bins < layout.missing[feature]
    gain = np.where(allowed[None, :, None] & (hl >= setting.least_hessian) & (hr >= setting.least_hessian), gain, -np.inf)
    best = gain.reshape(len(gain), -1).argmax(axis=1)
    row, place, side = np.arange(len(gain)), best // 2, best % 2
    return {"gain": gain[row, place, side], "feature": feature[place], "bin": bins[place], "missing_left": side == 1,
            "g": gl[row, place, side], "h": hl[row, place, side], "node_g": total_g, "node_h": total_h}


def grown(layout: Layout, bins: np.ndarray, joined: Joined, hashes: np.ndarray, labels: np.ndarray, setting: Setting, tree: int, margin: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree grown on rows that are all at hand, and the place of each row among its ends.

    ``joined``, ``hashes`` and ``labels`` are of the rows to train on, which come first; others only follow the splits.
    Of two children the lighter one is counted; the sums of the other are what it leaves of their parent's.
    """
    n = len(labels)
    g, h = gradients(margin[:n], labels, (joined.space("g", float), joined.space("h", float)))
    numbers = np.int16 if setting.depth < 15 else np.int64
    left_out = None if setting.rows >= 1 else drawn_rows(setting, tree, hashes).astype(numbers) - numbers(1)  # -1 takes a row out of any node
    columns = drawn_columns(setting, tree, len(layout.features))
    out, active, above = Tree.empty(setting.depth), np.zeros(1, np.int64), np.zeros(0, np.int64)
    place, sums = out.start(len(bins)), np.zeros((2, 0, layout.total), np.int64)
    for level in range(setting.depth):
        other = active - 1 + 2 * (active % 2)  # a left child has an odd number
        weight, beside = out.hessian[active], out.hessian[other] if level else np.inf
        rest = np.isin(other, active) & ((weight > beside) | ((weight == beside) & (active % 2 == 0)))
        counted, parents = active[~rest], sums
        number, at = np.full(2 ** level, -1, numbers), joined.space("at", numbers)
        number[counted - (2 ** level - 1)] = np.arange(len(counted))
        for near in _near(n):
            number.take(place[near], out=at[near], mode="clip")
            if left_out is not None:
                at[near] |= left_out[near]
        sums = np.zeros((2, len(active), layout.total), np.int64)
        sums[:, ~rest] = histogram(layout, bins[:n], joined, at, len(counted), g, h, columns)
        sums[:, rest] = parents[:, np.searchsorted(above, (active[rest] - 1) // 2)] - sums[:, np.searchsorted(active, other[rest])]
        found = best_splits(layout, sums, columns, setting)
        if level == 0:
            out.gradient[0], out.hessian[0] = found["node_g"][0], found["node_h"][0]
        above, active = active, out.split(active, found, setting)
        place = out.step(place, level, bins, layout.missing)
        if not len(active):
            place *= 2 ** (setting.depth - 1 - level)
            break
    return out.finished(setting), place


# -- models -----------------------------------------------------------------------------------------

@dataclass
class Boosted:
    """A trained model: its trees, the bins of its features, and the margin it starts from."""

    layout: Layout
    trees: list[Tree]
    setting: Setting

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Log odds of rows of feature values."""
        bins, out = self.layout.binned(values), np.zeros(len(values))
        for tree in self.trees:
            out += tree.values(bins, self.layout.missing)
        return out

    def importances(self) -> dict[str, float]:
        """Mean gain of the splits on each feature, as parts of one."""
        f, gain = (np.concatenate([getattr(t, n)[t.feature >= 0] for t in self.trees] or [np.zeros(0)]) for n in ("feature", "gain"))
        n = len(self.layout.features)
        total, count = np.bincount(f.astype(int), gain, n), np.bincount(f.astype(int), minlength=n)
        mean = total / np.maximum(count, 1)
        return dict(zip(self.layout.features, (mean / (mean.sum() or 1)).tolist(), strict=True))


def matrix_columns(features: Sequence[str]) -> list:
    return [F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"_f{i}") for i, f in enumerate(features)]


def scored(model: Boosted, df: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, label and fold where there are, margin, score) of every row."""
    kept = [key, *[c for c in ("label", "fold") if c in df.columns]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(len(kept) + i).to_numpy(zero_copy_only=False) for i in range(len(model.layout.features))], axis=1)
            margin = model.margins(values)
            yield pa.record_batch([*batch.columns[:len(kept)], pa.array(margin), pa.array(1 / (1 + np.exp(-margin)))], names=[*kept, "margin", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)
    return df.select(*kept, *matrix_columns(model.layout.features)).mapInArrow(run, f"{schema}, margin double, score double")


@dataclass(frozen=True)
class Plan:
    """A model to train: its setting, the fold held out (-1 for none), the tree counts at which held-out rows are scored, the
    part of the other rows it is trained on, and whether these are scored too."""

    setting: Setting
    fold: int
    stops: tuple[int, ...] = ()
    part: float = 1.0
    both: bool = False

    def trained(self, block: Block) -> np.ndarray:
        """The rows to train on. A smaller part is within a larger one."""
        others = block.folds != self.fold
        if self.part < 1:
            others &= (mixed(block.hashes ^ _MIX[2]) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 < self.part
        return others


SCORES = "plan int, trees int, user_id string, label double, trained boolean, score double"


def _scores(number: int, trees: int, block: Block, plan: Plan, margin: np.ndarray) -> pa.RecordBatch:
    trained = plan.trained(block)
    rows = np.flatnonzero((block.folds == plan.fold) | (trained & plan.both))
    return pa.record_batch([
        pa.array(np.full(len(rows), number, np.int32)), pa.array(np.full(len(rows), trees, np.int32)), block.keys.take(pa.array(rows)).cast(pa.string()),
        pa.array(block.labels[rows]), pa.array(trained[rows]), pa.array(1 / (1 + np.exp(-margin[rows])))],
        names=["plan", "trees", "user_id", "label", "trained", "score"])


# -- training in tasks --------------------------------------------------------------------------------

def _whole(data: Binned) -> Block:
    """All blocks at the driver, in the order of the hashes of their keys. Only for tables within ``IN_TASK_CELLS``."""
    block = Block.joined([Block.unpacked(r["block"], r["keys"]) for r in data.blocks.select("block", "keys").toLocalIterator()])
    order = np.argsort(block.hashes, kind="stable")
    return Block(block.keys.take(pa.array(order)), block.hashes[order], block.labels[order], block.folds[order], np.asfortranarray(block.bins[order]))


def _dealt(spark: SparkSession, plans: Sequence[Plan]) -> DataFrame:
    """One task for each plan, the longest ones first."""
    order = sorted(range(len(plans)), key=lambda i: -plans[i].setting.trees * (1 + plans[i].setting.depth) * (1 + plans[i].setting.rows))
    return spark.range(0, len(plans), 1, len(plans)).select(F.array(*[F.lit(i) for i in order])[F.col("id").cast("int")].alias("plan"))


def _grow_all(layout: Layout, block: Block, joined: Joined, plan: Plan) -> Iterator[tuple[int, Tree, np.ndarray | None]]:
    """Number, tree, and where the plan stops the margins after it, of all trees of a plan in turn."""
    trained = plan.trained(block)
    order = np.concatenate([np.flatnonzero(trained), np.flatnonzero(~trained)])  # rows to train on first
    n = int(trained.sum())
    bins, hashes, labels = joined.bins.T.take(order, axis=1).T, block.hashes[order[:n]], block.labels[order[:n]]
    joined, margin = layout.joined(bins[:n]), np.zeros(len(order))
    for t in range(plan.setting.trees):
        tree, place = grown(layout, bins, joined, hashes, labels, plan.setting, t, margin)
        values, stops = tree.value[tree.ends()], None
        for near in _near(len(margin)):
            margin[near] += values.take(place[near], mode="clip")
        if t + 1 in plan.stops:
            stops = np.empty(len(margin))
            stops[order] = margin
        yield t + 1, tree, stops


def _fit_in_tasks(data: Binned, plans: Sequence[Plan]) -> list[list[Tree]]:
    spark, layout = data.blocks.sparkSession, data.layout
    shared = spark.sparkContext.broadcast(_whole(data).packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block.unpacked(shared.value)
        joined = layout.joined(block.bins)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                trees = [tree.arrays() for _, tree, _ in _grow_all(layout, block, joined, plans[number])]
                yield pa.record_batch([pa.array([number], pa.int32()), pa.array([pickle.dumps(trees)], pa.binary())], names=["plan", "trees"])

    found = {r["plan"]: [Tree(*t) for t in pickle.loads(r["trees"])] for r in _dealt(spark, plans).mapInArrow(run, "plan int, trees binary").collect()}
    return [found[i] for i in range(len(plans))]


def _score_in_tasks(data: Binned, plans: Sequence[Plan]) -> DataFrame:
    spark, layout = data.blocks.sparkSession, data.layout
    whole = _whole(data)
    shared = spark.sparkContext.broadcast((whole.packed(), whole.packed_keys()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block.unpacked(*shared.value)
        joined = layout.joined(block.bins)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                plan = plans[number]
                for t, _, margin in _grow_all(layout, block, joined, plan):
                    if t in plan.stops:
                        yield _scores(number, t, block, plan, margin)

    return durable(_dealt(spark, plans).mapInArrow(run, SCORES))


# -- training in passes -------------------------------------------------------------------------------

@dataclass
class _State:
    """A model between two passes: trees whose values are not in the stored margins yet, the tree that grows, and its active nodes."""

    pending: list[Tree]
    growing: Tree
    number: int = 0
    active: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    @staticmethod
    def packed(states: dict[int, _State]) -> bytes:
        return pickle.dumps({m: ([t.arrays() for t in s.pending], s.growing.arrays(), s.number, s.active) for m, s in states.items()}, protocol=5)

    @classmethod
    def unpacked(cls, data: bytes) -> dict[int, _State]:
        return {m: cls([Tree(*t) for t in pending], Tree(*growing), number, active) for m, (pending, growing, number, active) in pickle.loads(data).items()}


def _margin(block: Block, model: int, state: _State, missing: np.ndarray) -> np.ndarray:
    out = block.margins.get(model, np.zeros(len(block.labels)))
    for tree in state.pending:
        out = out + tree.values(block.bins, missing)
    return out


_SPLIT = {"gain": float, "feature": int, "bin": int, "missing_left": bool, "g": float, "h": float, "node_g": float, "node_h": float}


def _level(blocks: DataFrame, layout: Layout, plans: Sequence[Plan], states: dict[int, _State]) -> dict[tuple[int, int], dict]:
    """One pass: the best split of every active node of every model. Sums are exchanged per model and node."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(_State.packed(states))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _State.unpacked(shared.value)
        held = [(b, layout.joined(b.bins)) for batch in batches for b in map(Block.unpacked, batch.column(0).to_pylist())]
        for model, state in now.items() if held else ():
            setting, sums = plans[model].setting, 0
            number = np.full(len(state.growing.feature), -1)
            number[state.active] = np.arange(len(state.active))
            columns = drawn_columns(setting, state.number, len(layout.features))
            for block, joined in held:
                g, h = gradients(_margin(block, model, state, layout.missing), block.labels)
                used = plans[model].trained(block) & drawn_rows(setting, state.number, block.hashes)
                node = state.growing.leaves(block.bins, layout.missing)
                sums = sums + histogram(layout, block.bins, joined, np.where(used, number[node], -1), len(state.active), g, h, columns)
            yield pa.record_batch([
                pa.array(np.full(len(state.active), model, np.int32)), pa.array(state.active.astype(np.int32)),
                pa.array([sums[:, i].tobytes() for i in range(len(state.active))], pa.binary())], names=["model", "node", "sums"])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = {m: s.number for m, s in _State.unpacked(shared.value).items()}
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (model, node), group in groupby(rows, key=lambda r: r[:2]):
            total = sum(np.frombuffer(r[2], np.int64) for r in group)
            setting = plans[model].setting
            found = best_splits(layout, total.reshape(2, 1, -1), drawn_columns(setting, now[model], len(layout.features)), setting)
            yield pa.record_batch([pa.array([model], pa.int32()), pa.array([node], pa.int32()), *[pa.array([k(found[n][0])]) for n, k in _SPLIT.items()]],
                                  names=["model", "node", *_SPLIT])

    sent = blocks.select("block").mapInArrow(send, "model int, node int, sums binary")
    names = {float: "double", int: "long", bool: "boolean"}
    schema = "model int, node int, " + ", ".join(f"{n} {names[k]}" for n, k in _SPLIT.items())
    found = sent.repartition("model", "node").sortWithinPartitions("model", "node").mapInArrow(receive, schema).collect()  # a row for each node
    shared.unpersist()
    return {(r["model"], r["node"]): r.asDict() for r in found}


def _with_margins(blocks: DataFrame, layout: Layout, states: dict[int, _State]) -> DataFrame:
    """The blocks with the values of all pending trees in their margins."""
    shared = blocks.sparkSession.sparkContext.broadcast(_State.packed(states))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _State.unpacked(shared.value)
        for batch in batches:
            for data, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = Block.unpacked(data)
                block.margins = {m: _margin(block, m, s, layout.missing) for m, s in now.items()}
                yield pa.record_batch([pa.array([block.packed()], pa.binary()), pa.array([keys], pa.binary()), pa.array([n], pa.int64())], names=["block", "keys", "rows"])

    return durable(blocks.select("block", "keys", "rows").mapInArrow(run, BLOCKS))


def _scores_now(blocks: DataFrame, layout: Layout, plans: Sequence[Plan], states: dict[int, _State]) -> DataFrame:
    """Scores of the held-out rows of the models given, as they are now."""
    shared = blocks.sparkSession.sparkContext.broadcast(_State.packed(states))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _State.unpacked(shared.value)
        for batch in batches:
            for data, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = Block.unpacked(data, keys)
                for m, s in now.items():
                    yield _scores(m, s.number, block, plans[m], _margin(block, m, s, layout.missing))

    return durable(blocks.select("block", "keys").mapInArrow(run, SCORES))


def _in_passes(data: Binned, plans: Sequence[Plan], keep: bool) -> tuple[list[list[Tree]], DataFrame | None]:
    """Train all plans, a level of the current tree of each in one pass. With ``keep`` the trees are returned, else the scores."""
    blocks, layout = data.blocks, data.layout
    states = {i: _State([], Tree.empty(p.setting.depth)) for i, p in enumerate(plans) if p.setting.trees}
    trees: list[list[Tree]] = [[] for _ in plans]
    scores = None
    while states:
        for level in range(max(plans[m].setting.depth for m in states)):
            growing = {m: s for m, s in states.items() if len(s.active) and level < plans[m].setting.depth}
            if not growing:
                break
            found = _level(blocks, layout, plans, growing)
            for m, s in growing.items():
                none = {n: 0.0 for n in _SPLIT} | {"gain": -np.inf, "feature": -1}  # no row was drawn
                rows = [found.get((m, int(node)), none) for node in s.active]
                columns = {n: np.array([r[n] for r in rows], {float: float, int: np.int64, bool: bool}[k]) for n, k in _SPLIT.items()}
                if level == 0:
                    s.growing.gradient[0], s.growing.hessian[0] = columns["node_g"][0], columns["node_h"][0]
                s.active = s.growing.split(s.active, columns, plans[m].setting)
        stopping = {}
        for m, s in states.items():
            done = s.growing.finished(plans[m].setting)
            s.pending.append(done)
            if keep:
                trees[m].append(done)
            s.number += 1
            if s.number in plans[m].stops:
                stopping[m] = s
        if stopping:
            now = _scores_now(blocks, layout, plans, stopping)
            scores = now if scores is None else scores.unionByName(now)
        states = {m: s for m, s in states.items() if s.number < plans[m].setting.trees}
        if any(len(s.pending) >= PENDING for s in states.values()):
            blocks = _with_margins(blocks, layout, states)
            for s in states.values():
                s.pending = []
        for m, s in states.items():
            s.growing, s.active = Tree.empty(plans[m].setting.depth), np.zeros(1, np.int64)
    return trees, scores


# -- entry points -------------------------------------------------------------------------------------

def fit(data: Binned, setting: Setting, fold: int = -1, in_task_cells: int = IN_TASK_CELLS) -> Boosted:
    """Train one model on all rows but those of ``fold``."""
    return fit_all(data, [Plan(setting, fold)], in_task_cells)[0]


def fit_all(data: Binned, plans: Sequence[Plan], in_task_cells: int = IN_TASK_CELLS) -> list[Boosted]:
    """Train several models at once, for example one for each fold."""
    trees = _fit_in_tasks(data, plans) if 0 < data.cells <= in_task_cells else _in_passes(data, plans, keep=True)[0]
    return [Boosted(data.layout, t, p.setting) for t, p in zip(trees, plans, strict=True)]


def scores_of(data: Binned, plans: Sequence[Plan], in_task_cells: int = IN_TASK_CELLS) -> DataFrame:
    """plan (its place in the list), trees, user_id, label, trained, score, at the stops of each plan. Scores are written once."""
    scores = _score_in_tasks(data, plans) if 0 < data.cells <= in_task_cells else _in_passes(data, plans, keep=False)[1]
    return data.blocks.sparkSession.createDataFrame([], SCORES) if scores is None else scores


def held_out_scores(data: Binned, settings: Sequence[Setting], folds: int, in_task_cells: int = IN_TASK_CELLS) -> DataFrame:
    """setting (its place in the list), fold, user_id, label, score: every row by every setting's model that has not seen its fold."""
    shared: dict[Setting, set[int]] = {}
    for s in settings:
        shared.setdefault(replace(s, trees=0), set()).add(s.trees)
    plans = [Plan(replace(s, trees=max(stops)), i, tuple(sorted(stops))) for s, stops in shared.items() for i in range(folds)]
    place = {s: i * folds for i, s in enumerate(shared)}
    wanted = data.blocks.sparkSession.createDataFrame(
        [(i, fold, place[replace(s, trees=0)] + fold, s.trees) for i, s in enumerate(settings) for fold in range(folds)],
        "setting int, fold int, plan int, trees int")
    return scores_of(data, plans, in_task_cells).join(F.broadcast(wanted), ["plan", "trees"]).select(  # settings x folds rows
        "setting", "fold", "user_id", "label", "score")


# -- models as tables ----------------------------------------------------------------------------------

NODES = "tree int, node int, feature int, bin int, missing_left boolean, gradient double, hessian double, gain double, value double"
CUTS = "place int, feature string, cuts array<double>"
SETTINGS = "trees int, depth int, rate double, rows double, columns double, l2 double, least_hessian double, least_gain double, seed int"


def save(model: Boosted, folder: str) -> None:
    """Nodes, cuts and setting as small tables in a folder; an earlier model there is replaced."""
    spark = SparkSession.active()
    nodes = [(t, int(n), *(a[n].item() for a in tree.arrays())) for t, tree in enumerate(model.trees) for n in np.flatnonzero((tree.hessian > 0) | (tree.feature >= 0) | (np.arange(len(tree.feature)) == 0))]
    cuts = [(i, f, c.tolist()) for i, (f, c) in enumerate(zip(model.layout.features, model.layout.cuts, strict=True))]
    for name, rows, schema in (("nodes", nodes, NODES), ("cuts", cuts, CUTS), ("setting", [tuple(model.setting.__dict__.values())], SETTINGS)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def load(folder: str) -> Boosted:
    """A saved model. Its size is that of its trees, not of any data."""
    spark = SparkSession.active()
    setting = Setting(**spark.read.schema(SETTINGS).parquet(f"{folder}/setting").first().asDict())
    cuts = sorted(spark.read.schema(CUTS).parquet(f"{folder}/cuts").collect())
    trees: dict[int, Tree] = {}
    for r in spark.read.schema(NODES).parquet(f"{folder}/nodes").collect():
        tree = trees.setdefault(r["tree"], Tree.empty(setting.depth))
        for array, value in zip(tree.arrays(), r[2:], strict=True):
            array[r["node"]] = value
    return Boosted(Layout([r["feature"] for r in cuts], [np.array(r["cuts"], float) for r in cuts]), [trees[i] for i in sorted(trees)], setting)
