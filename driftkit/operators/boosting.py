"""Gradient-boosted trees of the second order, for two classes.

Logistic loss from a base score of the training rows' own positive rate; positives
weigh ``positive_weight``.  Each tree takes a share of the rows and of the features
(``subsample``, ``colsample``, both seeded) and grows level by level: tasks add up
gradients and curvatures per (node, feature, bin) over their blocks of binned rows,
merging tasks add up a feature's sums and find its best cut of each node, and the
driver, which sees nodes x features cuts whatever the number of rows, picks the split
of largest gain

    T(GL)^2 / (HL + l2) + T(GR)^2 / (HR + l2) - T(G)^2 / (H + l2),

T being the shrinkage by l1; a leaf is -rate * T(G) / (H + l2).  Both children need a
curvature of ``min_child_weight``; ties go to the earlier feature, then the smaller cut.

Rows are binned once (at most ``max_bin`` quantile cuts a feature, NULL and NaN in the
last bin) and kept as blocks in the shared checkpoint folder with their margin, which
is written anew every ``MARGINS_EVERY`` trees; in between a task adds the trees since.
A task takes ``BLOCKS_PER_TASK`` blocks, the least that pays for a shuffle to the most that
one holds, by the number of cores; rows are sampled per block, so trees do not depend on it.
Where one task holds all blocks, it grows all trees itself, without a job a level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkit.session import cut_lineage

ROWS_PER_BLOCK = 50_000
BLOCKS_PER_TASK = (8, 32)
MARGINS_EVERY = 10
MERGERS = 8
LEAST_GAIN = 1e-6
BLOCKS = "block long, bins binary, y binary, margin binary"
SUMS = "feature int, sums binary"
CUTS = "feature int, node int, cut int, " + ", ".join(f"{x} double" for x in ("gain", "g", "h", "left_g", "left_h", "right_g", "right_h"))
TREES = "number int, feature binary, cut binary, value binary, gain binary"


class Cut(NamedTuple):
    """A row of ``CUTS``."""

    feature: int
    node: int
    cut: int
    gain: float
    g: float
    h: float
    left_g: float
    left_h: float
    right_g: float
    right_h: float


@dataclass
class Tree:
    """A binary tree in level order: children of i are 2 i + 1 and 2 i + 2."""

    feature: np.ndarray  # -1: leaf
    cut: np.ndarray      # rows whose bin is below go left
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node each row (column of ``bins``) has come to."""
        at = np.zeros(bins.shape[1], np.uint8 if len(self.feature) < 256 else np.int64)
        for node in np.flatnonzero(self.feature >= 0).tolist():  # level order: parents first
            right = bins[self.feature[node]] >= int(self.cut[node])
            at += (at == node) * (at.dtype.type(node + 1) + right)  # to 2 node + 1 or 2 node + 2
        return at


@dataclass
class BoostedModel:
    features: list[str]
    cuts: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def bin(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x, side="right") for c, x in zip(self.cuts, columns)]) if self.cuts else np.zeros((0, 0), np.int64)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return self.base + sum((t.value[t.nodes(bins)] for t in self.trees), np.zeros(bins.shape[1]))

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` and the probability of class 1 as ``y_score``."""
        model = self

        @F.pandas_udf("double")
        def probability(*xs: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-model.margins(model.bin([x.to_numpy(dtype="float64") for x in xs])))))

        return df.select(*keep, probability(*[F.col(f"`{c}`").cast("double") for c in self.features]).alias("y_score"))

    def importances(self) -> np.ndarray:
        """Total gain per feature, as a share."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            np.add.at(total, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        return total / (total.sum() or 1.0)


def bin_cuts(df: DataFrame, features: Sequence[str], max_bin: int) -> list[np.ndarray]:
    """Per feature at most ``max_bin`` cuts at its quantiles (all values, if few)."""
    probs = F.array(*[F.lit(i / max_bin) for i in range(max_bin + 1)])
    known = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in features]
    row = df.agg(*[F.percentile_approx(x, probs, 40 * max_bin).alias(f"q{i}") for i, x in enumerate(known)]).first()
    return [np.unique(np.array(q or [], float))[1:] for q in row]


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_cuts(sums: np.ndarray, l1: float, l2: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node (gain, cut, left sums, whole sums) of the best cut of a feature, from its
    (node, bin) sums of (gradient, curvature); a gain of -inf where none is allowed."""
    worth = lambda s: _shrunk(s[..., 0], l1) ** 2 / (s[..., 1] + l2)
    below = np.cumsum(sums, axis=1)
    left, whole, nodes = below[:, :-1], below[:, -1], np.arange(len(sums))
    if not left.shape[1]:
        return np.full(len(sums), -np.inf), np.zeros(len(sums), int), np.zeros_like(whole), whole
    right = whole[:, None] - left
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), worth(left) + worth(right) - worth(whole)[:, None], -np.inf)
    at = gain.argmax(axis=1)
    return gain[nodes, at], at + 1, left[nodes, at], whole


def fit_boosted(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    rows: int,
    positive_rate: float,
    positive_weight: float = 1.0,
    n_estimators: int = 150,
    max_depth: int = 3,
    learning_rate: float = 0.05,
    subsample: float = 0.9,
    colsample: float = 0.9,
    reg_alpha: float = 0.0,
    reg_lambda: float = 1.0,
    max_bin: int = 256,
    min_child_weight: float = 1.0,
    seed: int = 42,
) -> BoostedModel:
    """``rows`` and ``positive_rate`` of ``df`` are what the caller has counted already."""
    features = list(features)
    if not features:
        raise ValueError("no features to split on")
    rate = min(max(positive_rate, 1e-6), 1 - 1e-6)
    model = BoostedModel(features, bin_cuts(df, features, max_bin), float(np.log(rate / (1 - rate))))
    sizes = [len(c) + 1 for c in model.cuts]
    kind, width = np.uint8 if max(sizes) <= 256 else np.uint16, len(features)
    names = ["block", "bins", "y", "margin"]

    def block_of(ident: int, bins: np.ndarray, y: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (bins.astype(kind), y.astype(np.uint8), margin)]
        return pa.RecordBatch.from_arrays([pa.array([ident]), *blobs], names=names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held, n, ident = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS_PER_BLOCK:
                yield joined(held, ident)
                held, n, ident = [], 0, ident + 1
        if n:
            yield joined(held, ident)

    def joined(held: list[pa.RecordBatch], ident: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        y, *columns = (c.to_numpy().astype(float) for c in table.columns)
        bins = model.bin(columns)
        return block_of(ident, bins, y, np.full(len(y), model.base))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for ident, bins, y, margin in zip(*(batch.column(c).to_pylist() for c in names)):
                margin = np.frombuffer(margin)
                yield ident, np.frombuffer(bins, kind).reshape(width, -1), np.frombuffer(y, np.uint8).astype(float), margin

    staged = df.select(F.col(label).cast("double").alias("_y"), *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"_x{i}") for i, c in enumerate(features)])
    blocks = cut_lineage(staged.na.fill(float("nan")).repartition(max(1, -(-rows // ROWS_PER_BLOCK))).mapInArrow(pack, BLOCKS))
    made = blocks.rdd.getNumPartitions()  # of a checkpoint: known without a job
    least, most = (-(-made // n) for n in reversed(BLOCKS_PER_TASK))
    tasks = min(most, max(least, blocks.sparkSession.sparkContext.defaultParallelism))
    blocks = blocks.coalesce(tasks)

    def summed(batches: Iterable[tuple], tree: Tree, number: int, since: list[Tree], nodes: list[int], picked: list[int]) -> dict[int, np.ndarray]:
        """Gradients and curvatures per (node of ``nodes``, bin) of each feature, of the tree's rows."""
        sums = {f: np.zeros((2, len(nodes) * sizes[f])) for f in picked}
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))
        for ident, bins, y, margin in batches:
            for t in since:
                margin = margin + t.value[t.nodes(bins)]
            p, w = 1 / (1 + np.exp(-margin)), np.where(y == 1, positive_weight, 1.0)
            taken = np.random.default_rng([seed, number, ident]).random(len(y)) < subsample
            at = place[tree.nodes(bins)]
            own = np.flatnonzero(taken & (at >= 0))
            at, weights = at[own], [x[own] for x in (w * (p - y), w * p * (1 - p))]
            for f in picked:
                cell = at * sizes[f] + bins[f].take(own)
                for k, weight in enumerate(weights):
                    sums[f][k] += np.bincount(cell, weight, len(nodes) * sizes[f])
        return sums

    def cuts_of(f: int, flat: np.ndarray, nodes: list[int]) -> tuple:
        gain, cut, left, whole = best_cuts(np.moveaxis(flat.reshape(2, len(nodes), sizes[f]), 0, -1), reg_alpha, reg_lambda, min_child_weight)
        return gain, cut, whole, left, whole - left

    def level_cuts(tree: Tree, number: int, since: list[Tree], nodes: list[int], picked: list[int]) -> list:
        """Per (feature, node of ``nodes``), by feature: the best cut of the tree's rows that have come to the node."""
        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            sums = summed(opened(batches), tree, number, since, nodes, picked)
            yield pa.RecordBatch.from_arrays([pa.array(picked, pa.int32()), pa.array([sums[f].tobytes() for f in picked], pa.binary())], names=["feature", "sums"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for f, blob in zip(batch.column("feature").to_pylist(), batch.column("sums")):
                    total[f] = total.get(f, 0.0) + np.frombuffer(blob.as_buffer())
            for f, flat in total.items():
                gain, cut, *sides = cuts_of(f, flat, nodes)
                columns = [pa.array(np.full(len(nodes), f, np.int32)), pa.array(np.array(nodes, np.int32)), pa.array(cut.astype(np.int32)), pa.array(gain)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x[:, k].copy()) for x in sides for k in (0, 1)]], names=[c.split()[0] for c in CUTS.split(", ")])

        return sorted(blocks.mapInArrow(add_up, SUMS).repartition(min(MERGERS, len(picked)), "feature").mapInArrow(merge, CUTS).collect())

    def with_margins(since: list[Tree]) -> DataFrame:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for ident, bins, y, margin in opened(batches):
                yield block_of(ident, bins, y, margin + sum((t.value[t.nodes(bins)] for t in since), np.zeros(len(y))))

        return cut_lineage(blocks.mapInArrow(add, BLOCKS))

    def grown(number: int, cuts_at: Callable[[Tree, list[int], list[int]], list]) -> Tree:
        """A tree from ``cuts_at``: the cuts of the tree so far at nodes, over features."""
        picked = sorted(np.random.default_rng([seed, number]).choice(width, max(1, int(colsample * width)), replace=False).tolist())
        tree, open_ = Tree.empty(max_depth), [0]
        for _ in range(max_depth):
            if not open_:
                break
            below, cuts = [], cuts_at(tree, open_, picked)
            for node in open_:
                own = [c for c in cuts if c.node == node]
                if node == 0:
                    tree.value[0] = -learning_rate * _shrunk(own[0].g, reg_alpha) / (own[0].h + reg_lambda)
                split = max(own, key=lambda c: (c.gain, -c.feature))
                if not split.gain > LEAST_GAIN:
                    continue
                tree.gain[node], tree.feature[node], tree.cut[node] = split.gain, split.feature, split.cut
                for child, g, h in ((2 * node + 1, split.left_g, split.left_h), (2 * node + 2, split.right_g, split.right_h)):
                    tree.value[child] = -learning_rate * _shrunk(g, reg_alpha) / (h + reg_lambda)
                    below.append(child)
            open_ = below
        return tree

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """All trees, from all blocks."""
        held = list(opened(batches))

        def cuts_at(tree: Tree, nodes: list[int], picked: list[int]) -> list[Cut]:
            sums, out = summed(held, tree, number, [], nodes, picked), []
            for f in picked:
                gain, cut, *sides = cuts_of(f, sums[f].ravel(), nodes)
                out += [Cut(f, node, int(cut[i]), float(gain[i]), *(float(x[i, k]) for x in sides for k in (0, 1))) for i, node in enumerate(nodes)]
            return out

        for number in range(n_estimators):
            tree = grown(number, cuts_at)
            held = [(ident, bins, y, margin + tree.value[tree.nodes(bins)]) for ident, bins, y, margin in held]
            columns = [pa.array([x.tobytes()], pa.binary()) for x in (tree.feature, tree.cut, tree.value, tree.gain)]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *columns], names=[c.split()[0] for c in TREES.split(", ")])

    if tasks == 1:
        kinds = (("feature", np.int64), ("cut", np.int64), ("value", float), ("gain", float))
        rows_ = sorted(blocks.mapInArrow(whole, TREES).collect(), key=lambda r: r.number)
        model.trees = [Tree(*(np.frombuffer(r[k], kind).copy() for k, kind in kinds)) for r in rows_]
        return model

    since: list[Tree] = []
    for number in range(n_estimators):
        tree = grown(number, lambda tree, nodes, picked: level_cuts(tree, number, since, nodes, picked))
        model.trees.append(tree)
        since.append(tree)
        if len(since) == MARGINS_EVERY and number + 1 < n_estimators:
            blocks, since = with_margins(since), []
    return model
