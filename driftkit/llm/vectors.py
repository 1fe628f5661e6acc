"""Vector blocks: what exact and approximate search have in common.

Vectors are packed, inside tasks, into blocks in vertical layout (one row per
dimension).  Every query block meets every candidate block of its section once:
candidate blocks are dealt over salts and query blocks are repeated per salt, so
the meeting is an equi-join on (section, salt) and no block is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftkit.llm.common import stored

BLOCK_ROWS = 4096
QUERY_ROWS = 512
BLOCKS_PER_SALT = 4
BLOCK_SCHEMA = "section long, n int, ids binary, data binary"


def usable_vectors(df: DataFrame, ident: str, vec: str) -> DataFrame:
    """(id, vec array<double>): one row per non-NULL id.  NULL vectors and vectors
    with a NULL, NaN or infinite component take no part; ids are the key, so of
    repeated rows of an id the smallest vector counts, once."""
    rows = df.select(F.col(ident).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite).groupBy("id").agg(F.min("vec").alias("vec"))


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without NULL entries."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def pack(df: DataFrame, rows: int) -> DataFrame:
    """(section, id, vec array<long|double>) -> blocks of at most ``rows`` vectors of
    one section and one length; the length is part of the section's identity
    because blocks of different lengths never meet (see ``meet``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def block(key, ids, vecs):
            data = np.ascontiguousarray(np.concatenate(vecs).T)
            ids = np.concatenate(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())],
                names=["section", "n", "ids", "data"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            values, offsets = flat_lists(batch.column("vec"))
            lengths, sections = np.diff(offsets), batch.column("section").to_numpy()
            ids = batch.column("id").to_numpy()
            for key in set(zip(sections.tolist(), lengths.tolist())):
                at = np.flatnonzero((sections == key[0]) & (lengths == key[1]))
                vecs = values[offsets[at][:, None] + np.arange(key[1])[None, :]]
                for i in range(0, len(at), rows):
                    entry = held.setdefault(key, [0, [], []])
                    entry[0] += len(at[i:i + rows])
                    entry[1].append(ids[at[i:i + rows]])
                    entry[2].append(vecs[i:i + rows])
                    if entry[0] >= rows:
                        yield block(key, entry[1], entry[2])
                        del held[key]
        for key, (_, ids, vecs) in held.items():
            yield block(key, ids, vecs)

    return df.mapInArrow(run, BLOCK_SCHEMA)


def meet(queries: DataFrame, candidates: DataFrame, kernel: Callable, k: int, best: str, dtype) -> DataFrame:
    """Top ``k`` per query over all meetings of blocks: query_id, rank, vec_id, score.

    ``kernel(q_ids, q, c_ids, c)`` gets row-major queries and vertical candidates
    and yields (query_id, ids, scores).  ``best`` is "high" or "low"."""
    candidates = stored(candidates)
    # one row per part or odd vector length: broadcast, so that no block is shuffled by its section alone
    per_section = F.broadcast(candidates.groupBy("section").agg(F.ceil(F.count(F.lit(1)) / BLOCKS_PER_SALT).cast("int").alias("salts")))
    dealt = candidates.join(per_section, "section").select("section", F.pmod(F.xxhash64("ids"), F.col("salts")).cast("int").alias("salt"), F.col("ids").alias("c_ids"), F.col("data").alias("c_data"))
    asked = queries.join(per_section, "section").select("section", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    pairs = asked.hint("merge").join(dealt, ["section", "salt"]).select("q_ids", "q_data", "c_ids", "c_data")
    score_type = "long" if np.dtype(dtype) == np.int64 else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q_data, c_ids, c_data = (batch.column(i)[row].as_buffer() for i in range(4))
                q_ids, c_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
                q = np.frombuffer(q_data, dtype).reshape(-1, len(q_ids)).T
                c = np.frombuffer(c_data, dtype).reshape(-1, len(c_ids))
                if q.shape[1] != c.shape[0]:
                    continue  # vectors of different lengths are not compared
                found = list(kernel(q_ids, q, c_ids, c))
                if not found:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.full(len(i), x, np.int64) for x, i, _ in found])),
                        pa.array(np.concatenate([i for _, i, _ in found])),
                        pa.array(np.concatenate([s for _, _, s in found])),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    hits = pairs.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = F.col("score").desc() if best == "high" else F.col("score").asc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
