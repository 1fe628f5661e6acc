"""Merkle manifest of a dataset, with an inclusion proof for every row.

Leaves are digests of the rows' fields.  Per group they stand in order and every 2
consecutive nodes (the last run may hold one) become the digest of both, until one is
left: the group's subroot.  Subroots, in order of the group, give the root likewise.

Positions come from range partitions and offsets (``prefix_sums``).  A tree is built
in passes of ``HEIGHT`` levels: a block of 2 ** HEIGHT consecutive nodes makes its
levels in one task, its top node goes to the next pass, so no group is held by a task.

Proofs are made by pointer jumping.  Every node starts with a pointer to its parent
and the segment of siblings up to there (one).  A round joins the nodes with
themselves: a pointer over d levels is joined with the pointer over d levels that its
target holds, the distance doubles and the segments are put end to end.  Only nodes
whose level is a multiple of 2d are asked again, so the side that is looked up
shrinks to 1 / 2 ** d of the rows; it is broadcast only where that bound is small.
Segments are 33 bytes a level: the side of the sibling and its digest.

Defined cases: a NULL field is ``-``; a NULL group is a group of its own and comes
first; a NULL order value comes first in its group; rows of equal order value stand
by digest (repeated rows each get a proof); a lone leaf is its group's subroot; empty
table: no rows; columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftkit.llm.common import map_batches, stored
from driftkit.operators.scan import prefix_sums

HEIGHT = 10
STEP = 33  # bytes of a segment per level
ALONE, LEFT, RIGHT = 0, 1, 2  # where the sibling stands
BROADCAST_BYTES = 16 << 20
BROADCAST_GROUPS = 10_000
TILE = 16  # rows of a group meet what belongs to it in runs of 2 ** TILE
GROUP = ["_none", "_group"]


def field_text(column: Column) -> Column:
    """``-`` for NULL, else byte count, colon and value."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field_text, columns)).cast("binary"), 256))


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def with_group(rows: DataFrame, groups: DataFrame, number: int) -> DataFrame:
    """Join what belongs to a group (one row each, with its size ``n``) to its rows.

    Few groups are broadcast; many are repeated per run of 2 ** TILE positions, so
    that a group with a third of all rows is spread over many tasks."""
    if number <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), GROUP)
    tiles = F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, TILE))
    keyed = rows.withColumn("_tile", F.shiftright("pos", TILE))
    return keyed.join(groups.withColumn("_tile", F.explode(tiles)), [*GROUP, "_tile"]).drop("_tile")


def build_pass(rows: DataFrame, low: int) -> DataFrame:
    """One pass over nodes (_none, _group, n, pos, digest, carry) of level ``low``.

    Rows out: ``path`` set for a node with its pointer to the parent; else ``digest``
    is the top node of a block, which is the subroot if ``n`` nodes end there."""
    block = F.shiftright("pos", HEIGHT)
    dealt = rows.withColumn("_block", block).repartition(*GROUP, "_block").sortWithinPartitions(*GROUP, "pos")
    carry_type = rows.schema["carry"].dataType
    schema = T.StructType([
        T.StructField("_none", T.BooleanType()), T.StructField("_group", T.StringType()), T.StructField("n", T.LongType()),
        T.StructField("level", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("path", T.BinaryType()),
        T.StructField("digest", T.BinaryType()), T.StructField("carry", carry_type),
    ])

    def block_rows(key: tuple, first: int, found: list[bytes], carried: list) -> Iterator[tuple]:
        none, group, n, _ = key
        nodes, level = [d.hex() for d in found], low
        if n == 1:  # a lone leaf is its group's subroot
            yield none, group, n, 0, first, b"", found[0], carried[0]
        while level < low + HEIGHT and (n - 1) >> level:  # the group has more than one node here
            for i, node in enumerate(nodes):
                if (at := i ^ 1) < len(nodes):
                    path = bytes([LEFT if at < i else RIGHT]) + bytes.fromhex(nodes[at])
                else:
                    path = bytes([ALONE]) + bytes(STEP - 1)
                yield none, group, n, level, first + i, path, *((found[i], carried[i]) if level == 0 else (None, None))
            nodes = [digest(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
            first, level = first >> 1, level + 1
        yield none, group, n, level, first, None, bytes.fromhex(nodes[0]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        kind = None
        key, first, found, carried, out = None, 0, [], [], []

        def batch_of(rows_out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows_out))
            kinds = [pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), kind]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

        for batch in batches:
            kind = batch.column("carry").type
            for none, group, n, pos, value, carry, blk in zip(*(batch.column(c).to_pylist() for c in (*GROUP, "n", "pos", "digest", "carry", "_block"))):
                own = (none, group, n, blk)
                if own != key:
                    if key is not None:
                        out += block_rows(key, first, found, carried)
                    key, first, found, carried = own, pos, [], []
                found.append(value)
                carried.append(carry)
                if len(out) >= 10_000:
                    yield batch_of(out)
                    out = []
        if key is not None:
            out += block_rows(key, first, found, carried)
            yield batch_of(out)

    return stored(dealt.select(*GROUP, "n", "pos", "digest", "carry", "_block").mapInArrow(run, schema))


def jump(lower: DataFrame, upper: DataFrame, distance: int, bound: int) -> DataFrame:
    """Pointers over ``distance`` levels -> over twice that, or to the top."""
    found = upper.select(*GROUP, F.col("level").alias("_level"), F.col("pos").alias("_pos"), F.col("path").alias("_more"))
    if bound * (STEP * distance + 64) <= BROADCAST_BYTES:
        found = F.broadcast(found)
    target = lower.withColumns({"_level": F.col("level") + distance, "_pos": F.shiftright("pos", distance)})
    joined = target.join(found, [*GROUP, "_level", "_pos"], "left")
    return joined.withColumn("path", F.concat("path", F.coalesce("_more", F.lit(b"")))).select(*lower.columns)


def merkle_paths(leaves: DataFrame, sizes: DataFrame, groups: int, rows: int, largest: int, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (_none, _group, digest, carry and what ``order`` reads) ->
    (_none, _group, n, pos, digest, carry, path) and the subroots (_none, _group, n, digest)."""
    counted = prefix_sums(leaves.withColumn("_one", F.lit(1).cast("long")), order, ["_one"], GROUP)
    level = with_group(counted.select(*GROUP, (F.col("_one_cum") - 1).alias("pos"), "digest", "carry"), sizes, groups)
    nodes, tops, low = None, None, 0
    depth = max(0, largest - 1).bit_length()
    while True:
        made = build_pass(level, low)
        low += HEIGHT
        here = made.where("path IS NOT NULL")
        nodes = here if nodes is None else nodes.unionByName(here)
        ended = F.expr("shiftright(n - 1, level) = 0")
        done = made.where("path IS NULL").where(ended).select(*GROUP, "n", "digest")
        tops = done if tops is None else tops.unionByName(done)
        if low >= depth:
            break
        level = made.where("path IS NULL").where(~ended).select(*GROUP, "n", "pos", "digest", "carry")
    line, upper, distance = nodes.where("level = 0"), nodes.where("level > 0").select(*GROUP, "level", "pos", "path"), 1
    while distance < depth:
        asked = upper.where(F.col("level") % (2 * distance) == distance)
        bound = (2 * rows >> distance) + 64 * groups  # nodes of levels from ``distance`` on
        line = jump(line, asked, distance, bound)
        if 2 * distance < depth:
            upper = stored(jump(upper.where(F.col("level") % (2 * distance) == 0), asked, distance, bound))
        distance *= 2
    return line.select(*GROUP, "n", "pos", "digest", "carry", "path"), tops


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "lang",
    order: str = "doc_id",
    altered: Mapping[str, Column] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """``order`` column, leaf, subroot, root, proof_sha256, folded_root, verified, path.

    ``altered`` (field -> changed value) and ``where`` give a second leaf to rows that
    are to be checked in another state; ``folded_root`` folds that leaf, else the
    row's own, with the proof.  ``path`` is the proof itself."""
    own = leaf_digest([F.col(f) for f in fields])
    changed = F.lit(None).cast("binary")
    if altered:
        other = leaf_digest([altered.get(f, F.col(f)) for f in fields])
        changed = F.when(F.lit(True) if where is None else where, other)
    leaves = docs.select(
        F.col(group).isNull().alias("_none"),
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_group"),
        own.alias("digest"),
        F.struct(F.col(order).alias("order"), changed.alias("altered")).alias("carry"),
        F.monotonically_increasing_id().alias("_row"),  # equal rows may stand either way
    )
    leaves = stored(leaves)
    sizes = leaves.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
    number, total, largest = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    standing = [F.col("carry.order"), F.col("digest"), F.col("_row")]
    line, tops = merkle_paths(leaves, sizes, number, total, largest, standing)

    whole = [F.lit(False).alias("_none"), F.lit("").alias("_group")]
    roots = tops.select(*whole, "digest", F.struct(F.col("_none").alias("none"), F.col("_group").alias("group"), F.col("n").alias("n")).alias("carry"))
    one = roots.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
    by_group = [(~F.col("carry.none")), F.col("carry.group")]
    high, top = merkle_paths(roots, one, 1, number, number, by_group)
    root = top.select("digest").first()  # one row, none for an empty table
    high = high.select(
        F.col("carry.none").alias("_none"), F.col("carry.group").alias("_group"), F.col("carry.n").alias("n"), F.col("digest").alias("subroot"),
        F.col("path").alias("_rest"), F.lit(bytes(root.digest) if root else None).cast("binary").alias("root"),
    )
    full = with_group(line.drop("n"), high, number).select(
        F.col("carry.order").alias("order"), F.col("carry.altered").alias("altered"), "digest", "subroot", "root", F.concat("path", "_rest").alias("path")
    )

    def fold(batch: pa.RecordBatch) -> pa.RecordBatch:
        leaf, subroot, top_root, proof, folded = [], [], [], [], []
        for value, other, sub, end, path in zip(*(batch.column(c).to_pylist() for c in ("digest", "altered", "subroot", "root", "path"))):
            node, siblings = (other or value).hex(), []
            for i in range(0, len(path), STEP):
                side, sibling = path[i], path[i + 1:i + STEP].hex()
                if side == ALONE:
                    node = digest(node)
                    continue
                siblings.append(sibling)
                node = digest(sibling, node) if side == LEFT else digest(node, sibling)
            leaf.append(value.hex())
            subroot.append(sub.hex())
            top_root.append(end.hex())
            proof.append(digest(*siblings))
            folded.append(node)
        names = ["order", "leaf", "subroot", "root", "proof_sha256", "folded_root", "path"]
        return pa.RecordBatch.from_arrays([batch.column("order"), *map(pa.array, (leaf, subroot, top_root, proof, folded)), batch.column("path")], names=names)

    kind = docs.schema[order].dataType.simpleString()
    out = map_batches(full, f"order {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, path binary", fold)
    return out.select(F.col("order").alias(order), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "path")
