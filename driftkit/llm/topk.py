"""Exact top-k inner-product search by columnar branch and bound.

Components become floor(256 x).  A block of candidates is read dimension block by
dimension block in vertical layout; after each, the score still open lies within
|rest of query| * |rest of candidate| (Cauchy-Schwarz on the remaining mass), the
k-th best lower bound gives a threshold, and the candidates whose upper bound is
below it are dropped by compaction before the next dimension block is read.

Defined cases: see ``vectors.usable_vectors`` (NULL and non-finite: no part; an
id counts once); vectors of different lengths are not compared; an empty vector
scores 0 against empty vectors; ties go to the smaller vec_id; empty table: no
rows.  Components beyond the range of a long saturate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkit.llm.common import stored
from driftkit.llm.vectors import BLOCK_ROWS, QUERY_ROWS, meet, pack, usable_vectors

DIMENSIONS = 16
EXACT = float(1 << 53)


def suffix_norms(m: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """Norms over the dimensions from each cut on; ``m`` is dimension-major."""
    square = m * m
    sums = [square[a:b].sum(axis=0) for a, b in zip(cuts, cuts[1:])]
    rest, out = np.zeros(m.shape[1]), []
    for s in reversed(sums):
        out.append(np.sqrt(rest) * (1 + 1e-12))
        rest = rest + s
    return out[::-1]  # after block i


def branch_and_bound(k: int, dimensions: int = DIMENSIONS):
    def kernel(q_ids, q, c_ids, c):
        d = c.shape[0]
        qf, cf = q.astype(float), c.astype(float)
        bound = (np.sqrt((qf * qf).sum(axis=1).max(initial=0)) * np.sqrt((cf * cf).sum(axis=0).max(initial=0))) if d else 0.0
        if bound >= EXACT:  # beyond exact doubles: whole integer products, no bounds
            whole = q @ c
            for i, ident in enumerate(q_ids):
                yield top(ident, c_ids, whole[i], k)
            return
        order = np.argsort(-np.abs(qf).sum(axis=0), kind="stable")  # heavy dimensions first
        qf, cf = np.ascontiguousarray(qf[:, order]), np.ascontiguousarray(cf[order])
        cuts = [*range(0, d, dimensions), d] if d else [0, 0]
        c_rest, q_rest = suffix_norms(cf, cuts), suffix_norms(np.ascontiguousarray(qf.T), cuts)
        first, slack = qf[:, :cuts[1]] @ cf[:cuts[1]], 1e-9 * (1 + bound)
        everyone = np.arange(len(c_ids))
        for i, ident in enumerate(q_ids):
            alive = everyone[c_ids != ident]
            part = first[i, alive]
            for step in range(len(cuts) - 1):
                if step:
                    a, b = cuts[step], cuts[step + 1]
                    part = part + qf[i, a:b] @ cf[a:b, alive]
                if len(alive) > k and step < len(cuts) - 2:
                    open_mass = q_rest[step][i] * c_rest[step][alive]
                    low = part - open_mass
                    keep = part + open_mass >= np.partition(low, len(low) - k)[len(low) - k] - slack
                    alive, part = alive[keep], part[keep]
            yield top(ident, c_ids[alive], np.rint(part).astype(np.int64), k)

    return kernel


def top(ident, ids, scores, k):
    own = ids != ident
    ids, scores = ids[own], scores[own]
    best = np.lexsort((ids, -scores))[:k]
    return ident, ids[best], scores[best]


def exact_top_k(df: DataFrame, k: int = 5, every: int = 50, ident: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    scaled = F.transform("vec", lambda x: F.floor(x * F.lit(256.0)).cast("long"))
    rows = stored(usable_vectors(df, ident, vec).select("id", F.lit(0).cast("long").alias("section"), scaled.alias("vec")))
    candidates = pack(rows, BLOCK_ROWS)
    queries = pack(rows.where(F.col("id") % every == 0), QUERY_ROWS)
    return meet(queries, candidates, branch_and_bound(k), k, "high", np.int64)
