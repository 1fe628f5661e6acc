"""Random forests of two classes on row blocks.

The rules are those of MLlib's forest: every tree draws each row a Poisson(1) number of times and
every node its own features, a split has the largest fall of the weighted Gini impurity with at
least ``minInstancesPerNode`` drawn rows on both sides, sibling leaves of one class are merged,
and a score is the mean of the trees' leaf shares of class 1.  At most 32 bins a feature, cut at
quantiles of all rows.  The drawn numbers are this module's own, so trees are not MLlib's.

Rows are binned once and kept as blocks in the shared checkpoint folder.  Nodes of more than
``ROWS_PER_PIECE`` drawn rows are split level by level: tasks count classes per (node, feature,
bin) over their blocks, merging tasks add up a tree's counts and pick its splits, the driver gets
a split a node.  The rows of every smaller node are shuffled to one task, which finishes the
subtree.  Trees are taken in rounds of ``PAIRS_PER_ROUND`` rows x trees, which bounds what a round
shuffles.  Finished trees stay in the checkpoint folder; scoring sends shards of them to slices of
rows.  Counts are integers, so trees do not depend on the order in which rows come.

Several settings are grown together (``fit_forests``), each forest being the one it would be alone:
rows are drawn by tree and features by the node's path, so a forest of fewer or shallower trees is
part of the larger one, and trees that differ in the least rows a side are one until they split
some node differently; from there each has its own nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from driftkit.operators.boosting import bin_cuts
from driftkit.session import cut_lineage

ROWS_PER_BLOCK = 32_768
ROWS_PER_PIECE = 250_000
ROWS_PER_SLICE = 1 << 18
ROWS_AT_ONCE = 16_384  # a walk's values stay in the core's cache
STEPS_AT_ONCE = 4      # of a walk, before rows in leaves are left out
PAIRS_PER_ROUND = 1 << 27
SHARD_BYTES = 1 << 26
NODES_AT_ONCE = 1024
MAX_BIN = 32
LEAST_GAIN = 1e-12
PARAMS = {"numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy"}
BLOCKS = "block long, codes binary"
SUMS = "plant int, sums binary"
SPLITS = "plant int, kind int, node int, feature int, cut int, left0 long, left1 long, right0 long, right1 long"
ROWS = "plant int, node int, codes binary, times binary"
PIECES = "plant int, kind int, node int, feature binary, cut binary, child binary, counts binary"
TREES = "tree int, kind int, feature binary, cut binary, child binary, shares binary, importance binary"
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)]).astype(np.float32)


def subset_size(strategy: str, width: int, trees: int) -> int:
    """Features that a node draws, by MLlib's names."""
    if strategy == "auto":
        strategy = "sqrt" if trees > 1 else "all"
    named = {"all": width, "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(width))), "onethird": math.ceil(width / 3)}
    if strategy in named:
        return named[strategy]
    return min(width, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * width)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that look random for each 64 bits (the last step of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def root_key(seed: int, tree: int) -> np.ndarray:
    return mixed(mixed(np.array([seed % (1 << 64)], np.uint64)) + np.uint64(tree))


def child_keys(keys: np.ndarray) -> np.ndarray:
    """Left, right for each node."""
    return mixed(keys[:, None] + np.array([0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A], np.uint64)).ravel()


@dataclass
class Rules:
    """What every node is split by."""

    weights: np.ndarray  # of the two classes
    depth: int
    least: int           # drawn rows on either side
    drawn: int           # features a node draws
    bins: int

    def splittable(self, counts: np.ndarray, depth: int) -> np.ndarray:
        return (counts > 0).all(axis=1) & (counts.sum(axis=1) >= 2 * self.least) & (depth < self.depth)

    def subsets(self, keys: np.ndarray, width: int) -> np.ndarray:
        """Features of each node, ascending."""
        if self.drawn >= width:
            return np.tile(np.arange(width), (len(keys), 1))
        return np.sort(mixed(keys[:, None] ^ mixed(np.arange(1, width + 1, dtype=np.uint64))).argsort(axis=1)[:, :self.drawn], axis=1)


def class_sums(codes: np.ndarray, rows: np.ndarray, at: np.ndarray, times: np.ndarray, subsets: np.ndarray, bins: int) -> np.ndarray:
    """Drawn rows per (node, drawn feature, bin, class); ``rows`` are offsets in the codes
    (twice the bin, plus the class), ``at`` their nodes."""
    nodes, drawn = subsets.shape
    size, first = nodes * bins * 2, at * (bins * 2)
    sums = np.empty((drawn, nodes, bins, 2))
    for k in range(drawn):
        cell = subsets[:, k].take(at)
        cell += rows
        sums[k] = np.bincount(first + codes.take(cell), times, size).reshape(nodes, bins, 2)
    return sums.transpose(1, 0, 2, 3)


def impurity(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted Gini impurity times the weight."""
    a, b = counts[..., 0] * weights[0], counts[..., 1] * weights[1]
    return 2 * a * b / np.maximum(a + b, 1e-300)


def best_splits(sums: np.ndarray, subsets: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node (feature, cut, left and right counts) of the largest gain, ties to the earlier
    feature and then the smaller cut; feature -1 where no split is allowed or gains."""
    below = np.cumsum(sums, axis=2)
    left, whole = below[:, :, :-1], below[:, 0, -1]
    right = whole[:, None, None] - left
    fits = (left.sum(axis=-1) >= rules.least) & (right.sum(axis=-1) >= rules.least)
    rest = np.where(fits, impurity(left, rules.weights) + impurity(right, rules.weights), np.inf).reshape(len(sums), -1)
    at, nodes = rest.argmin(axis=1), np.arange(len(sums))
    slot, cut = np.divmod(at, sums.shape[2] - 1)
    gains = (impurity(whole, rules.weights) - rest[nodes, at]) / np.maximum(whole @ rules.weights, 1e-300) > LEAST_GAIN
    found = left[nodes, slot, cut]
    return np.where(gains, subsets[nodes, slot], -1), cut + 1, found, whole - found


@dataclass
class Nodes:
    """A binary tree, children after their parents: those of i are child[i] and child[i] + 1."""

    feature: np.ndarray  # -1: leaf
    cut: np.ndarray      # rows whose bin is below go left
    child: np.ndarray
    counts: np.ndarray   # drawn rows of the two classes

    KINDS = {"feature": np.int16, "cut": np.uint8, "child": np.int32, "counts": np.int64}

    @classmethod
    def of(cls, feature, cut, child, counts) -> "Nodes":
        return cls(*(np.asarray(x, kind) for x, kind in zip((feature, cut, child), cls.KINDS.values())), np.asarray(counts, np.int64).reshape(-1, 2))

    def levels(self) -> list[np.ndarray]:
        out, at = [], np.array([0])
        while len(at):
            out.append(at)
            left = self.child[at[self.feature[at] >= 0]]
            at = np.stack([left, left + 1], axis=1).ravel()
        return out

    def merged(self, feature: np.ndarray, levels: Sequence[np.ndarray], weights: np.ndarray) -> None:
        """Sibling leaves of one class become one leaf, from the lowest up, in ``feature``."""
        likely = self.counts[:, 1] * weights[1] > self.counts[:, 0] * weights[0]
        for level in reversed(levels):
            inner = level[feature[level] >= 0]
            left = self.child[inner]
            feature[inner[(feature[left] < 0) & (feature[left + 1] < 0) & (likely[left] == likely[left + 1])]] = -1

    def compacted(self) -> "Nodes":
        """The nodes that the root leads to."""
        order = np.concatenate(self.levels())
        place = np.zeros(len(self.feature), np.int32)
        place[order] = np.arange(len(order))
        return Nodes(self.feature[order], self.cut[order], np.where(self.feature[order] >= 0, place[self.child[order]], 0).astype(np.int32), self.counts[order])

    def pruned(self, weights: np.ndarray) -> "Nodes":
        feature = self.feature.copy()
        self.merged(feature, self.levels(), weights)
        return Nodes(feature, self.cut, self.child, self.counts).compacted()

    def at_depth(self, most: int, weights: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the tree that ends at ``most`` levels: class 1 shares (every node has that of the leaf
        it lies in) and falls of the impurity per feature, as a share."""
        feature, levels = self.feature.copy(), self.levels()
        for level in levels[most:]:
            feature[level] = -1
        self.merged(feature, levels[:most], weights)
        weighed = self.counts * weights
        share = weighed[:, 1] / np.maximum(weighed.sum(axis=1), 1e-300)
        for level in levels[:-1]:
            under = level[(self.feature[level] >= 0) & (feature[level] < 0)]
            for side in (0, 1):
                feature[self.child[under] + side] = -1
                share[self.child[under] + side] = share[under]
        inner = np.flatnonzero(feature >= 0)
        own, left = impurity(self.counts, weights), self.child[inner]
        total = np.bincount(feature[inner], own[inner] - own[left] - own[left + 1], width)
        return share, total / (total.sum() or 1.0)


class Walk:
    """Rows on their way down a tree."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> None:
        inner = feature >= 0  # a leaf leads to itself
        self.feature, self.cut = np.where(inner, feature, 0).astype(np.intp), np.where(inner, 2 * cut.astype(np.int64), 255).astype(np.uint8)
        self.child, self.inner = np.where(inner, child, np.arange(len(feature))).astype(np.intp), inner

    def ends(self, codes: np.ndarray, rows: np.ndarray, stops: Sequence[int] = ()) -> Iterator[np.ndarray]:
        """The nodes that rows are in after each of ``stops`` steps, then those they end in."""
        at, going, done, stops = np.zeros(len(rows), np.intp), None, 0, list(stops)
        while True:
            while stops and stops[0] == done:
                stops.pop(0)
                yield at
            going = np.flatnonzero(self.inner.take(at)) if going is None else going[self.inner.take(at[going])]
            if not len(going):
                break
            whole = len(going) == len(at)
            here, own = (at, rows) if whole else (at[going], rows[going])
            for _ in range(min(STEPS_AT_ONCE, stops[0] - done) if stops else STEPS_AT_ONCE):
                here = self.child.take(here) + (codes.take(own + self.feature.take(here)) >= self.cut.take(here))
                done += 1
            if whole:
                at = here
            else:
                at[going] = here
        for _ in range(len(stops) + 1):
            yield at


def route(nodes: "Nodes", codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The node that each row ends in."""
    walk = Walk(nodes.feature, nodes.cut, nodes.child)
    return np.concatenate([np.zeros(0, np.intp), *[next(walk.ends(codes, rows[i:i + ROWS_AT_ONCE])) for i in range(0, len(rows), ROWS_AT_ONCE)]])


def grow_alike(codes: np.ndarray, width: int, times: np.ndarray, depth: int, key: np.ndarray, kinds: Sequence[Rules]) -> list[Nodes]:
    """The whole subtree of these rows, its root at ``depth``, by each of several rules that differ in
    depth and least rows (ascending).  A node is common to the rules that split all above it alike."""
    rows, times, first = np.arange(len(times)) * width, times.astype(float), kinds[0]
    counts, sizes, keys = np.bincount(codes[rows] & 1, times, 2)[None], np.array([len(times)]), key
    alive, out, made = np.ones((1, len(kinds)), bool), [], 1
    while len(counts):  # rows are kept in the order of the level's nodes
        open_ = alive & np.stack([r.splittable(counts, depth) for r in kinds], axis=1)
        some = open_.any(axis=1)
        if not some.all():
            own = np.repeat(some, sizes)
            rows, times = rows[own], times[own]
        nodes = np.flatnonzero(some)
        sizes, open_, whole = sizes[nodes], open_[nodes], counts[nodes]
        ends, at = np.concatenate([[0], np.cumsum(sizes)]), np.repeat(np.arange(len(nodes)), sizes)
        feature, cut, left = np.full((len(kinds), len(nodes)), -1), np.zeros((len(kinds), len(nodes)), np.int64), np.zeros((len(kinds), len(nodes), 2))
        for i in range(0, len(nodes), NODES_AT_ONCE):
            part = slice(i, min(i + NODES_AT_ONCE, len(nodes)))
            subsets, own = first.subsets(keys[nodes[part]], width), slice(ends[i], ends[part.stop])
            sums = class_sums(codes, rows[own], at[own] - i, times[own], subsets, first.bins)
            feature[:, part], cut[:, part], left[:, part] = splits_alike(sums, subsets, whole[part], open_[part], kinds)
        level = np.zeros((3, len(kinds), len(counts)), np.int64)
        level[0] = -1
        pair, made_here, parts, number = np.full((len(kinds), len(nodes)), -1), 0, [], np.arange(len(nodes))
        for k in range(len(kinds)):
            new = feature[k] >= 0
            for j in range(k):
                like = new & (feature[j] == feature[k]) & (cut[j] == cut[k])
                pair[k][like] = pair[j][like]
                new &= ~like
            new = np.flatnonzero(new)
            if len(new):
                pair[k][new] = made_here + np.arange(len(new))
                made_here += len(new)
                parts.append((new, left[k][new], whole[new] - left[k][new], feature[k], 2 * cut[k]))
            split = np.flatnonzero(pair[k] >= 0)
            level[:, k, nodes[split]] = feature[k][split], cut[k][split], made + 2 * pair[k][split]
        out.append((level, counts))
        made += 2 * made_here
        if not made_here:
            break
        alive = np.zeros((2 * made_here, len(kinds)), bool)
        for k in range(len(kinds)):
            own = pair[k][pair[k] >= 0]
            alive[2 * own, k] = alive[2 * own + 1, k] = True
        counts = np.concatenate([np.stack([a, b], axis=1).reshape(-1, 2) for _, a, b, _, _ in parts])
        keys = np.concatenate([child_keys(keys[nodes[new]]) for new, *_ in parts])
        moved, base = [], 0
        for new, _, _, f, c in parts:
            place = np.full(len(nodes), -1)
            place[new] = base + 2 * np.arange(len(new))
            base += 2 * len(new)
            to = place.take(at)
            own = slice(None) if len(new) == len(nodes) else np.flatnonzero(to >= 0)
            here = at[own]
            moved.append((rows[own], times[own], to[own] + (codes.take(rows[own] + f.take(here)) >= c.take(here))))
        rows, times, to = (np.concatenate(x) for x in zip(*moved)) if len(moved) > 1 else moved[0]
        order = np.argsort(to.astype(np.uint16) if base <= 65_536 else to, kind="stable")
        rows, times, sizes, depth = rows[order], times[order], np.bincount(to, minlength=base), depth + 1
    levels, counts = zip(*out)
    feature, cut, child = np.concatenate(levels, axis=2)
    counts = np.concatenate(counts)
    return [Nodes.of(feature[k], cut[k], child[k], counts).compacted() for k in range(len(kinds))]


def splits_alike(sums: np.ndarray, subsets: np.ndarray, whole: np.ndarray, open_: np.ndarray, kinds: Sequence[Rules]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, left counts) per rule and node.  The best split of a rule with fewer least rows
    is the best one wherever it has enough of them on both sides."""
    n = len(subsets)
    feature, cut, left = np.full((len(kinds), n), -1), np.zeros((len(kinds), n), np.int64), np.zeros((len(kinds), n, 2))
    known, f, c, below = np.zeros(n, bool), np.full(n, -1), np.zeros(n, np.int64), np.zeros((n, 2))
    for k, rules in enumerate(kinds):
        side = below.sum(axis=1)
        need = open_[:, k] & (~known | ((f >= 0) & (np.minimum(side, whole.sum(axis=1) - side) < rules.least)))
        at = np.flatnonzero(need)
        if len(at):
            f[at], c[at], below[at], _ = best_splits(sums if len(at) == n else sums[at], subsets[at], rules)
            known[at] = True
        own = open_[:, k]
        feature[k][own], cut[k][own], left[k][own] = f[own], c[own], below[own]
    return feature, cut, left


def grow(bins: np.ndarray, y: np.ndarray, times: np.ndarray, depth: int, rng: np.random.Generator, rules: Rules) -> Nodes:
    """The whole subtree of these rows by one rule."""
    codes = (2 * bins + y[:, None].astype(np.uint8)).astype(np.uint8)
    return grow_alike(codes.ravel(), bins.shape[1], times, depth, root_key(int(rng.integers(1 << 62)), 0), [rules])[0]


class Top:
    """The nodes of a tree that the driver knows: large ones, their leaves, and the roots of pieces."""

    def __init__(self, tree: int, kinds: tuple[int, ...], key: np.ndarray) -> None:
        self.tree, self.kinds = tree, kinds  # the rules that have split all of it alike
        self.feature, self.cut, self.child, self.counts, self.depth, self.keys, self.pieces = [-1], [0], [0], [(0, 0)], [0], [key], []

    def alike(self, kinds: tuple[int, ...]) -> "Top":
        """The same nodes for some of the rules."""
        top = Top(self.tree, kinds, self.keys[0])
        for k in ("feature", "cut", "child", "counts", "depth", "keys", "pieces"):
            setattr(top, k, list(getattr(self, k)))
        return top

    def nodes(self) -> Nodes:
        return Nodes.of(self.feature, self.cut, self.child, self.counts)

    def split(self, node: int, feature: int, cut: int, sides: Sequence[tuple[int, int]]) -> list[int]:
        first = len(self.feature)
        self.feature[node], self.cut[node], self.child[node] = feature, cut, first
        self.counts[node] = tuple(sum(x) for x in zip(*sides))
        for side, key in zip(sides, child_keys(self.keys[node])):
            for own, value in zip((self.feature, self.cut, self.child, self.counts, self.depth, self.keys), (-1, 0, 0, side, self.depth[node] + 1, np.array([key]))):
                own.append(value)
        return [first, first + 1]


def whole_tree(top: Nodes, pieces: dict[int, Nodes]) -> Nodes:
    """``top`` with pieces in the place of their roots."""
    parts, made = [Nodes.of(top.feature.copy(), top.cut.copy(), top.child.copy(), top.counts.copy())], len(top.feature)
    for node, piece in sorted(pieces.items()):
        child = piece.child + np.int32(made - 1)
        parts[0].feature[node], parts[0].cut[node], parts[0].child[node], parts[0].counts[node] = piece.feature[0], piece.cut[0], child[0], piece.counts[0]
        parts.append(Nodes(piece.feature[1:], piece.cut[1:], child[1:], piece.counts[1:]))
        made += len(piece.feature) - 1
    return Nodes(*(np.concatenate([getattr(n, k) for n in parts]) for k in Nodes.KINDS))


def binned(batches: Sequence[pa.RecordBatch], cuts: Sequence[np.ndarray], names: Sequence[str]) -> np.ndarray:
    """Bins by row and feature."""
    table = pa.Table.from_batches(batches)
    return np.stack([np.searchsorted(c, table[x].to_numpy().astype(float), side="right").astype(np.uint8) for c, x in zip(cuts, names)], axis=1)


def blobs(columns: Sequence[np.ndarray]) -> list[pa.Array]:
    return [pa.array([x.tobytes()], pa.binary()) for x in columns]


@dataclass
class ForestModel:
    features: list[str]
    cuts: list[np.ndarray]
    trees: DataFrame     # TREES, in the checkpoint folder
    number: int
    size: int            # bytes of the trees
    kind: int = 0
    depths: tuple[int, ...] = ()  # that the trees' shares are for
    depth: int = 0

    def importances(self) -> np.ndarray:
        own, at = self.trees.filter((F.col("kind") == self.kind) & (F.col("tree") < self.number)), self.depths.index(self.depth)
        total = sum(np.frombuffer(r.importance).reshape(len(self.depths), -1)[at] for r in own.select("tree", "importance").orderBy("tree").collect())
        return total / (total.sum() or 1.0)

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` and the probability of class 1 as ``y_score``, written once."""
        return score_forests([self], df, keep).drop("candidate")


def score_forests(models: Sequence[ForestModel], df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, the place in ``models`` as ``candidate`` and the probability of class 1 as ``y_score``,
    written once; all of one :func:`fit_forests`.  A row goes down a tree once, whatever the depths."""
    cuts, width, grown = models[0].cuts, len(models[0].features), models[0].trees
    names = [f"_x{i}" for i in range(width)]
    kinds = sorted({m.kind for m in models})
    numbers = {k: max(m.number for m in models if m.kind == k) for k in kinds}
    before = {k: sum(numbers[j] for j in kinds if j < k) for k in kinds}
    total = sum(numbers.values())
    slices = max(1, -(-df.count() // ROWS_PER_SLICE))
    cores = df.sparkSession.sparkContext.defaultParallelism
    shards = min(total, max(-(-models[0].size // SHARD_BYTES), -(-4 * cores // slices)))
    firsts = {k: before[k] * shards // total for k in kinds}
    wanted = [(i, m.kind, m.number, m.depth, m.depths.index(m.depth), len(m.depths)) for i, m in enumerate(models)]
    schema = StructType([*df.select(*keep).schema.fields, StructField("candidate", IntegerType()), StructField("y_score", DoubleType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, (kept := table.drop_columns(names)).schema) as out:
                out.write_table(kept)
            columns = [pa.array([TaskContext.get().partitionId()]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), *blobs([2 * binned(held, cuts, names)])]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "kept", "codes"])

    def add_up(rows: pa.Table, trees: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows:
            codes, shard, totals = np.frombuffer(rows["codes"][0].as_buffer(), np.uint8), rows["shard"][0].as_py(), {}
            offsets = np.arange(len(codes) // width) * width
            for t in trees.sort_by([("kind", "ascending"), ("tree", "ascending")]).to_batches(max_chunksize=1):
                own = sorted((w for w in wanted if w[1] == t["kind"][0].as_py() and w[2] > t["tree"][0].as_py()), key=lambda w: w[3])
                walk = Walk(*(np.frombuffer(t[k][0].as_buffer(), kind) for k, kind in (("feature", np.int16), ("cut", np.uint8), ("child", np.int32))))
                shares = np.frombuffer(t["shares"][0].as_buffer()).reshape(own[0][5], -1)
                for i in range(0, len(offsets), ROWS_AT_ONCE):
                    for w, at in zip(own, walk.ends(codes, offsets[i:i + ROWS_AT_ONCE], [w[3] for w in own])):
                        totals.setdefault(w[0], np.zeros(len(offsets)))[i:i + ROWS_AT_ONCE] += shares[w[4]].take(at)
            out = [(rows["slice"][0].as_py(), m, shard, rows["kept"][0].as_py() if shard == firsts[models_kind[m]] else None, x.tobytes()) for m, x in sorted(totals.items())]
        columns = zip(*out) if out else [[]] * 5
        return pa.table([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["slice", "candidate", "shard", "kept", "sums"])

    def merge(parts: pa.Table) -> pa.Table:
        parts, candidate = parts.sort_by("shard"), parts["candidate"][0].as_py()
        kept = pa.ipc.open_stream(next(x for x in parts["kept"] if x.is_valid).as_buffer()).read_all()
        mean = sum(np.frombuffer(x.as_buffer()) for x in parts["sums"]) / wanted[candidate][2]
        return kept.append_column("candidate", pa.array(np.full(len(mean), candidate, np.int32))).append_column("y_score", pa.array(mean))

    models_kind = [m.kind for m in models]
    staged = df.select(*keep, *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(x) for c, x in zip(models[0].features, names)])
    rows = staged.na.fill(float("nan"), names).repartition(slices).mapInArrow(pack, "slice long, kept binary, codes binary")
    rows = rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("kept", F.when(F.col("shard").isin(*firsts.values()), F.col("kept")))
    place = F.element_at(F.create_map(*[F.lit(x) for k in kinds for x in (k, before[k])]), F.col("kind")) + F.col("tree")
    used = F.element_at(F.create_map(*[F.lit(x) for k in kinds for x in (k, numbers[k])]), F.col("kind"))
    trees = grown.drop("importance").filter(F.col("kind").isin(*kinds)).filter(F.col("tree") < used).withColumn("shard", F.floor(place * shards / total).cast("int"))
    trees = trees.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    tasks = min(slices * shards, 4 * cores)
    rows, trees = (x.repartition(tasks, "slice", "shard").groupBy("slice", "shard") for x in (rows, trees))
    sums = rows.cogroup(trees).applyInArrow(add_up, "slice long, candidate int, shard int, kept binary, sums binary")
    return cut_lineage(sums.groupBy("slice", "candidate").applyInArrow(merge, schema))


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    rows: int,
    weights: tuple[float, float] = (1.0, 1.0),
    numTrees: int = 20,
    maxDepth: int = 5,
    minInstancesPerNode: int = 1,
    featureSubsetStrategy: str = "auto",
    seed: int = 42,
) -> ForestModel:
    """``rows`` of ``df`` are what the caller has counted already, ``weights`` those of classes 0 and 1."""
    setting = {"numTrees": numTrees, "maxDepth": maxDepth, "minInstancesPerNode": minInstancesPerNode, "featureSubsetStrategy": featureSubsetStrategy}
    return fit_forests(df, features, label, rows, [setting], weights, seed)[0]


def fit_forests(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    rows: int,
    settings: Sequence[dict],
    weights: tuple[float, float] = (1.0, 1.0),
    seed: int = 42,
) -> list[ForestModel]:
    """:func:`fit_forest` of each of ``settings``, grown together."""
    features = list(features)
    if not features:
        raise ValueError("no features to split on")
    spark, width = df.sparkSession, len(features)
    cuts = bin_cuts(df, features, MAX_BIN - 1)
    bins = max(2, *(len(c) + 1 for c in cuts)) if cuts else 2
    names = [f"_x{i}" for i in range(width)]
    own = [(subset_size(s.get("featureSubsetStrategy", "auto"), width, s.get("numTrees", 20)), s.get("minInstancesPerNode", 1), s.get("maxDepth", 5), s.get("numTrees", 20)) for s in settings]
    kinds = sorted({(drawn, least) for drawn, least, _, _ in own})
    depths = [tuple(sorted({d for *kind, d, _ in own if tuple(kind) == k})) for k in kinds]

    def rules_of(tree: int) -> dict[int, Rules]:
        """The rules that the tree is grown by."""
        deepest = {i: max((d for *kind, d, number in own if tuple(kind) == k and number > tree), default=None) for i, k in enumerate(kinds)}
        return {i: Rules(np.array(weights, float), d, kinds[i][1], kinds[i][0], bins) for i, d in deepest.items() if d is not None}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held, n, ident = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS_PER_BLOCK:
                yield block_of(held, ident)
                held, n, ident = [], 0, ident + 1
        if n:
            yield block_of(held, ident)

    def block_of(held: list[pa.RecordBatch], ident: int) -> pa.RecordBatch:
        y = np.concatenate([b.column("_y").to_numpy(zero_copy_only=False) for b in held]).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([ident]), *blobs([2 * binned(held, cuts, names) + y[:, None]])], names=["block", "codes"])

    def opened(batches: Iterator[pa.RecordBatch], trees: Iterable[int]) -> Iterator[tuple]:
        """Per block and tree: the tree, the block's codes, drawn rows and their times."""
        for batch in batches:
            for ident, codes in zip(batch.column("block").to_pylist(), batch.column("codes")):
                codes = np.frombuffer(codes.as_buffer(), np.uint8)
                for tree in trees:
                    draw, times = np.random.default_rng([seed, tree, ident]).random(len(codes) // width, np.float32), 0
                    for most in POISSON:
                        times = times + (draw >= most).view(np.uint8)
                    drawn = np.flatnonzero(times)
                    yield tree, codes, drawn, times[drawn]

    staged = df.select(F.col(label).cast("double").alias("_y"), *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(x) for c, x in zip(features, names)])
    blocks = cut_lineage(staged.na.fill(float("nan"), names).repartition(max(1, -(-rows // ROWS_PER_BLOCK))).mapInArrow(pack, BLOCKS))
    cores = spark.sparkContext.defaultParallelism
    blocks = blocks.coalesce(2 * cores)

    def by_tree(tops: Sequence[Top], some: Iterable[int]) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for p in some:
            out.setdefault(tops[p].tree, []).append(p)
        return out

    def level_splits(tops: list[Top], open_: dict[int, list[int]], rules: dict[int, dict[int, Rules]]) -> list:
        """The splits of the open nodes of each top, by each of its rules."""
        known, plants = {p: tops[p].nodes() for p in open_}, by_tree(tops, open_)
        owned = {p: (tops[p].tree, tops[p].kinds, np.concatenate([tops[p].keys[node] for node in nodes])) for p, nodes in open_.items()}

        def subsets(plant: int) -> np.ndarray:
            tree, some, keys = owned[plant]
            return rules[tree][some[0]].subsets(keys, width)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for tree, codes, drawn, times in opened(batches, plants):
                for p in plants[tree]:
                    place = np.full(len(known[p].feature), -1)
                    place[open_[p]] = np.arange(len(open_[p]))
                    at = place.take(route(known[p], codes, drawn * width))
                    here = np.flatnonzero(at >= 0)
                    found = class_sums(codes, drawn[here] * width, at[here], times[here].astype(float), subsets(p), bins)
                    sums[p] = sums.get(p, 0.0) + found
            for p, found in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *blobs([found])], names=["plant", "sums"])

        def merge(table: pa.Table) -> pa.Table:
            p, parts = table["plant"][0].as_py(), []
            nodes, (tree, some, _) = open_[p], owned[p]
            total = sum(np.frombuffer(x.as_buffer()) for x in table["sums"]).reshape(len(nodes), -1, bins, 2)
            for k in some:
                feature, cut, left, right = best_splits(total, subsets(p), rules[tree][k])
                columns = [np.full(len(nodes), p, np.int32), np.full(len(nodes), k, np.int32), np.array(nodes, np.int32), feature.astype(np.int32), cut.astype(np.int32)]
                parts.append(pa.table([pa.array(x) for x in (*columns, *[side[:, c].astype(np.int64) for side in (left, right) for c in (0, 1)])], names=[c.split()[0] for c in SPLITS.split(", ")]))
            return pa.concat_tables(parts)

        return blocks.mapInArrow(add_up, SUMS).groupBy("plant").applyInArrow(merge, SPLITS).collect()

    def grown(numbers: list[int]) -> DataFrame:
        """The finished trees of a round."""
        rules = {t: rules_of(t) for t in numbers}
        alike = [[i for i in rules[t] if kinds[i][0] == drawn] for t in numbers for drawn in sorted({kinds[i][0] for i in rules[t]})]
        trees = [t for t in numbers for _ in {kinds[i][0] for i in rules[t]}]
        tops = [Top(t, tuple(some), root_key(seed, t)) for t, some in zip(trees, alike)]
        open_ = {}
        for p, top in enumerate(tops):
            if rows <= ROWS_PER_PIECE or not max(rules[top.tree][k].depth for k in top.kinds):
                top.pieces.append(0)
            else:
                open_[p] = [0]
        while open_:
            found: dict[int, dict[int, list]] = {}
            for s in sorted(level_splits(tops, open_, rules), key=lambda s: (s.plant, s.kind, s.node)):
                found.setdefault(s.plant, {}).setdefault(s.kind, []).append(s)
            open_ = {}
            for p, by_kind in found.items():
                same: dict[tuple, list[int]] = {}
                for k, own_splits in by_kind.items():
                    same.setdefault(tuple((s.node, s.feature, s.cut) for s in own_splits), []).append(k)
                whole = tops[p]
                for i, some in enumerate(same.values()):
                    top = whole.alike(tuple(some))
                    at = p if not i else len(tops)
                    tops[at:at + 1] = [top]
                    least = min((rules[top.tree][k] for k in some), key=lambda r: r.least)
                    deepest = max(rules[top.tree][k].depth for k in some)
                    for s in by_kind[some[0]]:
                        sides = ((s.left0, s.left1), (s.right0, s.right1))
                        if s.feature < 0:
                            top.counts[s.node] = tuple(sum(x) for x in zip(*sides))
                            continue
                        for node in top.split(s.node, s.feature, s.cut, sides):
                            if replace(least, depth=deepest).splittable(np.array([top.counts[node]]), top.depth[node])[0]:
                                (top.pieces if sum(top.counts[node]) <= ROWS_PER_PIECE else open_.setdefault(at, [])).append(node)
        known = {p: top.nodes() for p, top in enumerate(tops)}
        pieces = {p: top.pieces for p, top in enumerate(tops) if top.pieces}
        roots = {p: {node: (top.depth[node], top.keys[node]) for node in top.pieces} for p, top in enumerate(tops)}
        owned, plants = [(top.tree, top.kinds) for top in tops], by_tree(tops, pieces)

        def ship(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for tree, codes, drawn, times in opened(batches, plants):
                for p in plants[tree]:
                    place = np.full(len(known[p].feature), -1)
                    place[pieces[p]] = np.arange(len(pieces[p]))
                    at = place.take(route(known[p], codes, drawn * width))
                    order = np.argsort(at, kind="stable")
                    ends = np.searchsorted(at[order], np.arange(len(pieces[p]) + 1))
                    parts = [(node, order[a:b]) for node, a, b in zip(pieces[p], ends, ends[1:]) if b > a]
                    columns = [[codes.reshape(-1, width).take(drawn[o], axis=0).tobytes() for _, o in parts], [times[o].tobytes() for _, o in parts]]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(parts), pa.int32()), pa.array([node for node, _ in parts], pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names=["plant", "node", "codes", "times"])

        def finish(table: pa.Table) -> pa.Table:
            p, node = table["plant"][0].as_py(), table["node"][0].as_py()
            codes, times = (np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table[c]]) for c in ("codes", "times"))
            (tree, some), (depth, key) = owned[p], roots[p][node]
            some = sorted(some, key=lambda k: rules[tree][k].least)
            found = grow_alike(codes, width, times, depth, key, [rules[tree][k] for k in some])
            parts = [pa.table([pa.array([x], pa.int32()) for x in (p, k, node)] + blobs([getattr(piece, c) for c in Nodes.KINDS]), names=["plant", "kind", "node", *Nodes.KINDS]) for k, piece in zip(some, found)]
            return pa.concat_tables(parts)

        def assemble(table: pa.Table) -> pa.Table:
            p, kind, found = table["plant"][0].as_py(), table["kind"][0].as_py(), {}
            tree = owned[p][0]
            for row in table.to_batches(max_chunksize=1):
                if row["node"][0].as_py() >= 0:
                    found[row["node"][0].as_py()] = Nodes.of(*(np.frombuffer(row[k][0].as_buffer(), kind_) for k, kind_ in Nodes.KINDS.items()))
            weighing, deepest = rules[tree][kind].weights, rules[tree][kind].depth
            nodes = whole_tree(known[p], found)
            for level in nodes.levels()[deepest:]:  # the top is as deep as its deepest rule
                nodes.feature[level] = -1
            nodes = nodes.pruned(weighing)
            shares, falls = zip(*(nodes.at_depth(d, weighing, width) for d in depths[kind]))
            return pa.table([pa.array([tree], pa.int32()), pa.array([kind], pa.int32()), *blobs([nodes.feature, nodes.cut, nodes.child, np.stack(shares), np.stack(falls)])], names=[c.split()[0] for c in TREES.split(", ")])

        tasks = min(4 * cores, sum(len(p) for p in pieces.values()) or 1)
        done = blocks.mapInArrow(ship, ROWS).repartition(tasks, "plant", "node").groupBy("plant", "node").applyInArrow(finish, PIECES)
        every = spark.createDataFrame([(p, k, -1, b"", b"", b"", b"") for p, (_, some) in enumerate(owned) for k in some], PIECES)  # a tree may have no piece
        return cut_lineage(done.unionByName(every).groupBy("plant", "kind").applyInArrow(assemble, TREES))

    at_once, most, trees = max(1, PAIRS_PER_ROUND // max(rows, 1)), max(number for *_, number in own), None
    for first in range(0, most, at_once):
        found = grown(list(range(first, min(first + at_once, most))))
        trees = found if trees is None else trees.unionByName(found)
    size = trees.agg(F.sum(sum(F.octet_length(c) for c in ("feature", "cut", "child", "shares")))).first()[0]
    at = {k: i for i, k in enumerate(kinds)}
    return [ForestModel(features, cuts, trees, number, int(size), at[drawn, least], depths[at[drawn, least]], depth) for drawn, least, depth, number in own]
