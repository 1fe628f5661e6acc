"""Embedding near-duplicates by int8 tile products with exact error bounds.

Exact copies are grouped first, so each distinct vector is compared once with its
number of copies as weight.  Distinct vectors of one length are dealt by hash over
slots of at most about ``BLOCK_ROWS`` vectors (fewer for long vectors); every pair of
slots meets in one task, as one block against another.

Inside a task the unit vector u of each row becomes int8 codes q with a scale s; the
length of what is lost, eps = |u - s q|, is known.  For two vectors

    |u.v - s t (q.r)|  <=  eps_u |t r| + eps_v |s q| + eps_u eps_v.

Tiles of codes are multiplied (sums of int8 products are whole numbers below 2 ** 24,
so float32 multiplication is exact).  Pairs whose upper bound is below the threshold
go, pairs whose lower bound reaches it are links, and only the rest is computed again
from the full vectors in double precision.  A task returns the number of links of
each vector and a spanning forest of its links, never the links themselves, so a
dense group costs no more rows than it has vectors; components follow.

Defined cases: NULL and empty vectors, zero vectors and vectors with a NULL, NaN or
infinite component link with nothing; vectors of different lengths are not compared;
every row counts (repeated rows are copies of each other, and link); a component
whose ids are all NULL has a NULL component; a NULL id is kept if its component is
NULL; empty table: no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkit.llm.common import join_copies, stored
from driftkit.llm.components import connected_components
from driftkit.llm.vectors import flat_lists

BLOCK_ROWS = 8192
BLOCK_BYTES = 16 << 20
TILE = 1024
RECOMPUTED_AT_ONCE = 1 << 16


class Codes:
    """A block of vectors: int8 codes, scales, what the codes lose, and the vectors."""

    def __init__(self, vecs: np.ndarray):
        self.vecs = vecs.astype(np.float64)
        largest = np.abs(self.vecs).max(axis=1)
        self.vecs /= largest[:, None]  # neither squares nor sums leave the range of doubles
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vecs, self.vecs))
        unit = self.vecs / self.norms[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        codes = np.rint(unit / self.scale[:, None])
        kept = codes * self.scale[:, None]
        slack = 1e-9  # above all rounding of doubles
        self.eps = np.sqrt(((unit - kept) ** 2).sum(axis=1)) + slack
        self.size = np.sqrt((kept ** 2).sum(axis=1)) + slack
        self.codes = codes.astype(np.int8)
        # whole numbers below 2 ** 24 are exact in float32
        self.kind = np.float32 if 127 * 127 * vecs.shape[1] < 1 << 24 else np.float64


def tile_links(x: Codes, i: slice, y: Codes, j: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x[i]`` and ``y[j]`` (from the tiles' starts) with cosine >= threshold."""
    dots = x.codes[i].astype(x.kind) @ y.codes[j].astype(x.kind).T
    eps, size = y.eps[j].max(), y.size[j].max()
    loose = x.eps[i] * size + eps * x.size[i] + x.eps[i] * eps  # not below any pair's bound
    least = (threshold - loose) / x.scale[i]
    least -= np.abs(least) * 1e-5  # float32 comparison
    a, b = np.nonzero(dots * y.scale[j].astype(x.kind) >= least.astype(x.kind)[:, None])
    about = dots[a, b].astype(np.float64) * x.scale[i][a] * y.scale[j][b]
    error = x.eps[i][a] * y.size[j][b] + y.eps[j][b] * x.size[i][a] + x.eps[i][a] * y.eps[j][b]
    linked = about - error >= threshold
    open_ = np.flatnonzero(~linked & (about + error >= threshold))
    for k in range(0, len(open_), RECOMPUTED_AT_ONCE):
        at = open_[k:k + RECOMPUTED_AT_ONCE]
        u, v = i.start + a[at], j.start + b[at]
        linked[at] = np.einsum("ij,ij->i", x.vecs[u], y.vecs[v]) / (x.norms[u] * y.norms[v]) >= threshold
    return a[linked], b[linked]


class Groups:
    """Union-find over positions, fed with whole tiles of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def settle(self) -> None:
        while True:
            above = self.up[self.up]
            if np.array_equal(above, self.up):
                return
            self.up = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            apart = self.up[a] != self.up[b]
            a, b = a[apart], b[apart]
            _, first = np.unique(self.up[a], return_index=True)  # one link of each group at a time
            for p, q in zip(self.up[a[first]].tolist(), self.up[b[first]].tolist()):
                while self.up[p] != p:
                    p = int(self.up[p])
                while self.up[q] != q:
                    q = int(self.up[q])
                self.up[max(p, q)] = min(p, q)
            self.settle()


def block_links(x: Codes, wx: np.ndarray, y: Codes | None, wy: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Link counts and group of each vector of a block, or of two blocks end to end."""
    n, same = len(x.vecs), y is None
    other, weights = (x, wx) if same else (y, wy)
    m = len(other.vecs)
    count = np.zeros(n if same else n + m)
    shift = 0 if same else n
    groups = Groups(len(count))
    for i0 in range(0, n, TILE):
        i = slice(i0, min(i0 + TILE, n))
        for j0 in range(i0 if same else 0, m, TILE):
            j = slice(j0, min(j0 + TILE, m))
            a, b = tile_links(x, i, other, j, threshold)
            if same and i0 == j0:
                a, b = a[a < b], b[a < b]
            a, b = a + i0, b + j0
            count += np.bincount(a, weights[b], len(count))
            count += np.bincount(b + shift, wx[a], len(count))
            groups.join(a, b + shift)
    return count.astype(np.int64), groups.up


def near_vectors(df: DataFrame, ident: str = "vec_id", vec: str = "embedding", threshold: float = 0.95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``df``."""
    if df.schema[vec].dataType.elementType.typeName() not in ("float", "double"):
        df = df.withColumn(vec, F.col(vec).cast("array<double>"))
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(ident).cast("long").alias("vec_id"), F.col(vec).alias("vec")).withColumn("usable", usable)
    distinct = stored(rows.where("usable").groupBy("vec").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")))
    number, total, longest = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0)), F.max(F.size("vec"))).first()
    per_block = max(256, min(block_rows, BLOCK_BYTES // (8 * (longest or 1))))
    slots = max(1, -(-number // per_block))
    numpy_type = np.float32 if df.schema[vec].dataType.elementType.typeName() == "float" else np.float64

    dealt = distinct.withColumns({"dim": F.size("vec"), "slot": F.pmod(F.xxhash64("vec"), F.lit(slots)).cast("int")})
    dealt = stored(dealt.repartition("dim", "slot").sortWithinPartitions("dim", "slot").withColumn("node", F.monotonically_increasing_id()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """One row per (dim, slot): rows of a slot follow each other."""
        key, parts = None, []

        def block() -> pa.RecordBatch:
            nodes, copies, vecs = (np.concatenate(p) for p in zip(*parts))
            columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (nodes, copies, vecs))]
            return pa.RecordBatch.from_arrays(columns, names=["dim", "slot", "nodes", "copies", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            dims, slot, nodes, copies = (batch.column(c).to_numpy() for c in ("dim", "slot", "node", "copies"))
            values, offsets = flat_lists(batch.column("vec"))
            cuts = [0, *(np.flatnonzero((np.diff(dims) != 0) | (np.diff(slot) != 0)) + 1).tolist(), len(dims)]
            for a, b in zip(cuts, cuts[1:]):
                own = (int(dims[a]), int(slot[a]))
                if key is not None and own != key:
                    yield block()
                    parts = []
                key = own
                parts.append((nodes[a:b], copies[a:b], values[offsets[a]:offsets[b]].astype(numpy_type)))
        if parts:
            yield block()

    blocks = stored(dealt.select("dim", "slot", "node", "copies", "vec").mapInArrow(pack, "dim int, slot int, nodes binary, copies binary, data binary"))
    met = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    met = met.withColumns({"low": F.least("slot", "other"), "high": F.greatest("slot", "other")})

    def compare(table: pa.Table) -> pa.Table:
        rows_in = sorted(table.to_pylist(), key=lambda r: r["slot"])
        low, high = rows_in[0]["low"], rows_in[0]["high"]
        nodes = [np.frombuffer(r["nodes"], np.int64) for r in rows_in]
        weights = [np.frombuffer(r["copies"], np.int64).astype(float) for r in rows_in]
        ids, count, up = np.concatenate(nodes), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if low == high or len(rows_in) == 2:
            codes = [Codes(np.frombuffer(r["data"], numpy_type).reshape(len(n), -1)) for r, n in zip(rows_in, nodes)]
            count, up = block_links(codes[0], weights[0], *((None, None) if low == high else (codes[1], weights[1])), threshold)
        at = np.flatnonzero(count)
        return pa.table({"node": pa.array(ids[at]), "links": pa.array(count[at]), "root": pa.array(ids[up[at]])})

    found = stored(met.groupBy("dim", "low", "high").applyInArrow(compare, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = dealt.select("node", "vec", "first", "copies").join(links, "node", "left").join(labels, "node", "left")
    classes = stored(classes.select("vec", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label")))
    least = classes.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    known = join_copies(classes, least, "label", "members", number).select("vec", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = join_copies(rows.where("usable").select("vec_id", "vec"), known, "vec", "copies", total).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
