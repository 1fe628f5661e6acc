"""Approximate nearest neighbours by learned partitions.

Fit, on the ``sample_rows`` rows with the smallest seeded hash of the id (a
documented bound; the model's size does not depend on the table): the exact
k-nearest-neighbour graph of the sample is split into balanced parts by repeated
bisection with gain-based swaps of equal numbers of points, and a small network
learns to predict, for a point, the parts in which its neighbours lie.  The
number of parts a query probes is the smallest that reached ``recall`` on the
sample itself.

Index: EVERY usable row goes to its most probable part; queries go to their
several most probable parts and all rows there are reranked by exact distance.

Defined cases: as in ``vectors.usable_vectors``; zero vectors take no part;
vectors whose length differs from the sample's usual length are searched exactly
among those of their length; ties go to the smaller vec_id; with fewer than 256
sample rows there is one part, so the search is exact and returns all
candidates if there are fewer than k; empty table: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkit.llm.common import map_batches, stored
from driftkit.llm.vectors import BLOCK_ROWS, QUERY_ROWS, flat_lists, meet, pack, usable_vectors

SAMPLE_ROWS = 6144
PARTS = 32
ROWS_PER_PART = 128


@dataclass
class Router:
    dim: int
    weights: tuple  # (w1, b1, w2, b2)
    probes: int

    @property
    def parts(self) -> int:
        return len(self.weights[3])

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Ids of each point's k nearest other points (exact)."""
    norms, out = (x * x).sum(axis=1), np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        d = norms[None, :] - 2 * x[a:a + 512] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[a:a + 512] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, levels: int, rng: np.random.Generator) -> np.ndarray:
    """Repeated bisection: halves by the leading direction, then equal swaps of the
    points that gain most edges, until no swap gains."""
    part = np.zeros(len(x), np.int64)
    heads, tails = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    heads, tails = np.concatenate([heads, tails]), np.concatenate([tails, heads])
    for _ in range(levels):
        side = np.zeros(len(x), np.int64)
        for p in range(part.max() + 1):
            at = np.flatnonzero(part == p)
            y = x[at] - x[at].mean(axis=0)
            v = rng.normal(size=x.shape[1])
            for _ in range(12):
                v = y.T @ (y @ v)
                v /= np.linalg.norm(v) or 1.0
            side[at[np.argsort(y @ v, kind="stable")[len(at) // 2:]]] = 1
        inside = part[heads] == part[tails]
        h, t = heads[inside], tails[inside]
        for _ in range(30):
            other = np.bincount(h, weights=side[h] != side[t], minlength=len(x))
            own = np.bincount(h, weights=side[h] == side[t], minlength=len(x))
            gain, moved = other - own, 0
            for p in range(part.max() + 1):
                at = np.flatnonzero(part == p)
                a, b = (at[side[at] == s] for s in (0, 1))
                a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
                n = min(len(a), len(b))
                n = min(int(np.sum(gain[a[:n]] + gain[b[:n]] > 0)), max(1, n // 8))
                moved += n
                side[a[:n]], side[b[:n]] = 1, 0
            if not moved:
                break
        part = part * 2 + side
    return part


def train_network(x: np.ndarray, soft: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 30) -> tuple:
    """One hidden layer, softmax cross-entropy to the neighbours' parts, Adam."""
    scale = np.sqrt((x * x).sum(axis=1).mean()) or 1.0
    w = [rng.normal(size=(x.shape[1], hidden)) * np.sqrt(2.0) / scale, np.zeros(hidden), rng.normal(size=(hidden, soft.shape[1])) * np.sqrt(1.0 / hidden), np.zeros(soft.shape[1])]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            at = order[a:a + 256]
            h = np.maximum(x[at] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = (z / z.sum(axis=1, keepdims=True) - soft[at]) / len(at)
            back = (g @ w[2].T) * (h > 0)
            t += 1
            for i, grad in enumerate((x[at].T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                w[i] -= 2e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return tuple(w)


def fit_router(x: np.ndarray, k: int, recall: float, parts: int, seed: int) -> Router:
    levels = int(np.log2(max(1, min(parts, len(x) // ROWS_PER_PART))))
    dim = x.shape[1]
    if levels == 0:
        return Router(dim, (np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1)
    rng = np.random.default_rng(seed)
    near = neighbour_graph(x, k)
    part = balanced_parts(x, near, levels, rng)
    soft = np.zeros((len(x), 1 << levels))
    np.add.at(soft, (np.repeat(np.arange(len(x)), k), part[near].ravel()), 1.0 / (k + 1))
    soft[np.arange(len(x)), part] += 1.0 / (k + 1)
    router = Router(dim, train_network(x, soft, rng), 1)
    scores = router.scores(x)
    home = scores.argmax(axis=1)  # where the index puts each row
    place = np.argsort(np.argsort(-scores, axis=1, kind="stable"), axis=1)  # rank of each part for each query
    wanted = np.take_along_axis(place, home[near], axis=1)
    router.probes = next(p for p in range(1, router.parts + 1) if p == router.parts or (wanted < p).mean() >= recall)
    return router


def nearest_exact(k: int):
    """Kernel: k nearest of a block by Euclidean distance; products pick, differences score."""

    def kernel(q_ids, q, c_ids, c):
        c_norm, q_norm = (c * c).sum(axis=0), (q * q).sum(axis=1)
        for a in range(0, len(q_ids), 128):
            near = c_norm[None, :] + q_norm[a:a + 128, None] - 2 * (q[a:a + 128] @ c)
            for i, row in enumerate(near, start=a):
                at = np.flatnonzero(c_ids != q_ids[i])
                if len(at) > k:
                    d = row[at]
                    slack = 1e-9 * (q_norm[i] + c_norm.max())
                    at = at[d <= np.partition(d, k - 1)[k - 1] + slack]
                diff = c[:, at] - q[i][:, None]
                dist = np.sqrt((diff * diff).sum(axis=0))
                best = np.lexsort((c_ids[at], dist))[:k]
                yield q_ids[i], c_ids[at][best], dist[best]

    return kernel


def sample_vectors(rows: DataFrame, sample_rows: int, seed: int) -> np.ndarray:
    """The bounded training sample, vectors of the most usual length in it."""
    picked = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample_rows).select("vec").collect()
    lengths = [len(r.vec) for r in picked]
    usual = max(sorted(set(lengths)), key=lengths.count) if lengths else 0
    chosen = [r.vec for r in picked if len(r.vec) == usual]
    return np.array(chosen, dtype=float).reshape(len(chosen), usual)


def approximate_neighbours(
    df: DataFrame, k: int = 10, every: int = 100, recall: float = 0.95, parts: int = PARTS, sample_rows: int = SAMPLE_ROWS, seed: int = 7, ident: str = "vec_id", vec: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) for ids divisible by ``every``."""
    rows = usable_vectors(df, ident, vec).where(F.exists("vec", lambda x: x != 0))
    rows = stored(rows)
    router = fit_router(sample_vectors(rows, sample_rows, seed), k, recall, parts, seed)

    def route(probes: int):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            values, offsets = flat_lists(batch.column("vec"))
            lengths = np.diff(offsets)
            known = np.flatnonzero(lengths == router.dim)
            at, section = np.flatnonzero(lengths != router.dim), None
            section = -1 - lengths[at].astype(np.int64)  # other lengths: a section each
            if len(known):
                x = values[offsets[known][:, None] + np.arange(router.dim)[None, :]]
                chosen = np.argsort(-router.scores(x), axis=1, kind="stable")[:, :probes]
                at = np.concatenate([at, np.repeat(known, chosen.shape[1])])
                section = np.concatenate([section, chosen.ravel()])
            picked = batch.take(pa.array(at))
            return pa.RecordBatch.from_arrays([pa.array(section, pa.int64()), picked.column("id"), picked.column("vec")], names=["section", "id", "vec"])

        return work

    schema = "section long, id long, vec array<double>"
    spread = F.pmod(F.xxhash64("id"), F.lit(16))  # a hot part is packed by several tasks
    candidates = map_batches(rows, schema, route(1)).repartition("section", spread)
    queries = map_batches(rows.where(F.col("id") % every == 0), schema, route(router.probes)).repartition("section")
    return meet(pack(queries, QUERY_ROWS), pack(candidates, BLOCK_ROWS), nearest_exact(k), k, "low", np.float64)
