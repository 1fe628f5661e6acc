"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: words of the text with A-Z in lower case, word shingles (repeats
included) hashed with XXH64 (seed 42); a bit is set if it is set in over half of
the hashes.  Two fingerprints link at ``max_bits`` or fewer differing bits.

Index.  Linked fingerprints agree on at least one of ``max_bits + 1`` segments,
so each distinct fingerprint is listed once per segment, rotated so that the
segment leads, and the list is range-partitioned in the order of its Gray rank:
fingerprints that share bits stand together, and a hot segment value is spread
over neighbouring tasks.  Inside a task runs of up to 16 neighbours of one
segment value get an upper node with the bits that all of them share (mask and
pattern), runs of 16 nodes the next, and so on.  The search descends pairs of
nodes: differences on bits fixed in both add up, a pair of groups is pruned when
they exceed the limit, and accepted as a whole when even the open bits cannot
exceed it.  A segment value that goes over a task border meets itself chunk by
chunk in a second step, pruned by the chunks' root nodes first.  Each task
returns a spanning forest of the links it found; components follow.

Defined cases: NULL, empty and wordless texts have fingerprint zero and link like
any other; texts with fewer words than a shingle hash their whole word sequence;
exact copies and repeated rows share one fingerprint and are aggregated before
any search; a group whose ids are all NULL has a NULL component; empty table:
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkit.llm.common import map_batches, stored, utf8
from driftkit.llm.components import connected_components

SEED = 42
FANOUT = 16
PAIRS_AT_ONCE = 1 << 20
ROWS_PER_TASK = 100_000
SHINGLES_AT_ONCE = 1 << 15


def fingerprint(text: bytes | None, shingle: int) -> int:
    words = text.lower().split() if text else []  # bytes.lower: A-Z only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
    spans = list(zip(starts, ends[shingle - 1:].tolist()))
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for a in range(0, len(spans), SHINGLES_AT_ONCE):
        h = np.frombuffer(b"".join([digest(joined[i:j], SEED) for i, j in spans[a:a + SHINGLES_AT_ONCE]]), np.uint8)
        ones += np.unpackbits(h.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(spans)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long; and the long columns ``keep``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in utf8(batch.column("text"))], np.uint64).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), *map(batch.column, keep)], names=["doc_id", "fp", *keep])

    schema = "doc_id long, fp long" + "".join(f", {c} long" for c in keep)
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep), schema, work)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(start from the top, width) of max_bits + 1 near-equal segments."""
    n = max_bits + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


class Node:
    """One level of the index: arrays over its nodes, children as ranges below."""

    def __init__(self, both: np.ndarray, some: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.both, self.shared, self.first, self.last = both, ~(both ^ some), first, last
        self.some = some


def build_levels(fps: np.ndarray, bucket: np.ndarray) -> list[Node]:
    """Levels from single fingerprints (0) up to one node per bucket."""
    at = np.arange(len(fps))
    levels, own = [Node(fps, fps, at, at + 1)], bucket
    while True:
        new = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
        if new.all() and len(levels) > 1:
            return levels
        begins = np.flatnonzero(new)
        place = np.arange(len(own)) - np.repeat(begins, np.diff(np.append(begins, len(own))))
        head = np.flatnonzero(place % FANOUT == 0)
        below = levels[-1]
        levels.append(Node(np.bitwise_and.reduceat(below.both, head), np.bitwise_or.reduceat(below.some, head), head, np.append(head[1:], len(own))))
        own = own[head]


class Forest:
    """Union-find over positions; keeps what joins, so its size is linear."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        roots = np.array([self.root(i) for i in range(len(self.up))], np.int64)
        child = np.flatnonzero(roots != np.arange(len(roots)))
        return child, roots[child]


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every member of each range, and which range it is of."""
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), which


def search(left: list[Node], right: list[Node], limit: int, join, same: bool) -> None:
    """Descend pairs of nodes of two indexes (or of one with itself)."""
    top_a, top_b = len(left) - 1, len(right) - 1
    n_a, n_b = len(left[top_a].both), len(right[top_b].both)
    if same:
        a = b = np.arange(n_a)  # buckets do not meet each other here
    else:
        a, b = (x.ravel() for x in np.meshgrid(np.arange(n_a), np.arange(n_b), indexing="ij"))
    stack = [(top_a, top_b, a, b)]
    while stack:
        da, db, a, b = stack.pop()
        if len(a) > PAIRS_AT_ONCE:
            half = len(a) // 2
            stack += [(da, db, a[:half], b[:half]), (da, db, a[half:], b[half:])]
            continue
        x, y = left[da], right[db]
        fixed = x.shared[a] & y.shared[b]
        apart = np.bitwise_count((x.both[a] ^ y.both[b]) & fixed).astype(np.int64)
        near = apart <= limit
        a, b, fixed, apart = a[near], b[near], fixed[near], apart[near]
        if da == 0 and db == 0:
            other = a != b if same else np.ones(len(a), bool)
            join(a[other], b[other])
            continue
        whole = apart + 64 - np.bitwise_count(fixed) <= limit
        if whole.any():
            a0, a1 = _leaves(left, da, a[whole], False), _leaves(left, da, a[whole], True)
            b0, b1 = _leaves(right, db, b[whole], False), _leaves(right, db, b[whole], True)
            members, which = spread(a0, a1)
            join(members, b0[which])
            members, which = spread(b0, b1)
            join(a0[which], members)
            a, b = a[~whole], b[~whole]
        if not len(a):
            continue
        if da >= db and da > 0:
            kids, which = spread(x.first[a], x.last[a])
            if same and da == db:  # both sides of one index go down together, each pair once
                stack.append((da - 1, db - 1, *_both_down(x, y, a, b)))
            else:
                stack.append((da - 1, db, kids, b[which]))
        else:
            kids, which = spread(y.first[b], y.last[b])
            stack.append((da, db - 1, a[which], kids))


def _both_down(x: Node, y: Node, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kids_a, which = spread(x.first[a], x.last[a])
    b = b[which]
    kids_b, again = spread(y.first[b], y.last[b])
    kids_a = kids_a[again]
    once = kids_a <= kids_b
    return kids_a[once], kids_b[once]


def _leaves(levels: list[Node], depth: int, i: np.ndarray, end: bool) -> np.ndarray:
    """First leaf, or one past the last leaf, below nodes of a level."""
    for level in range(depth, 0, -1):
        i = levels[level].last[i] - 1 if end else levels[level].first[i]
    return i + 1 if end else i


def fingerprint_links(fps: DataFrame, max_bits: int = 3, rows: int | None = None) -> DataFrame:
    """``fps`` (distinct fp) -> (a, b): links whose components are those of all links."""
    rotated = []
    for start, _ in segments(max_bits):
        r = F.col("fp") if start == 0 else F.shiftleft("fp", start).bitwiseOR(F.shiftrightunsigned("fp", 64 - start))
        rotated.append(r)
    listed = fps.select("fp", F.posexplode(F.array(*rotated)).alias("segment", "turned"))
    listed = listed.withColumn("rank", F.col("turned"))
    for s in (1, 2, 4, 8, 16, 32):  # rank in Gray order: prefix sums modulo 2
        listed = listed.withColumn("rank", F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", s)))
    listed = listed.withColumn("rank", F.col("rank").bitwiseXOR(F.lit(-(1 << 63))))  # unsigned order
    rows = fps.count() if rows is None else rows
    tasks = max(1, -(-rows * (max_bits + 1) // ROWS_PER_TASK))
    ordered = listed.repartitionByRange(tasks, "segment", "rank").sortWithinPartitions("segment", "rank")
    widths = [w for _, w in segments(max_bits)]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        fp, turned = (table.column(c).to_numpy().astype(np.uint64) for c in ("fp", "turned"))
        segment = table.column("segment").to_numpy().astype(np.int64)
        lead = np.zeros(len(fp), np.uint64)
        for s, width in enumerate(widths):
            lead[segment == s] = turned[segment == s] >> np.uint64(64 - width)
        change = np.concatenate([[True], (segment[1:] != segment[:-1]) | (lead[1:] != lead[:-1])])
        bucket = np.cumsum(change)
        forest = Forest(len(fp))
        levels = build_levels(fp, bucket)
        search(levels, levels, max_bits, forest.join, same=True)
        child, root = forest.links()
        signed = fp.astype(np.int64)
        none = [None] * len(child)
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed[child]), pa.array(signed[root]), pa.array(none, pa.int32()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(none, pa.int64()), pa.array(none, pa.int64())],
            names=["a", "b", "segment", "lead", "chunk", "both", "some"],
        )
        for edge in sorted({int(bucket[0]), int(bucket[-1])}):  # may go on in a neighbouring task
            own = np.flatnonzero(bucket == edge)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None], pa.int64()), pa.array([None], pa.int64()),
                    pa.array([segment[own[0]]], pa.int32()), pa.array([int(lead[own[0]])], pa.int64()), pa.array([fp[own].tobytes()], pa.binary()),
                    pa.array([np.bitwise_and.reduce(fp[own])]).cast(pa.uint64()).view(pa.int64()), pa.array([np.bitwise_or.reduce(fp[own])]).cast(pa.uint64()).view(pa.int64()),
                ],
                names=["a", "b", "segment", "lead", "chunk", "both", "some"],
            )

    found = stored(ordered.mapInArrow(within, "a long, b long, segment int, lead long, chunk binary, both long, some long"))
    chunks = found.where("chunk IS NOT NULL").withColumn("id", F.xxhash64("chunk")).select("segment", "lead", "id", "both", "some", "chunk")
    heads = chunks.drop("chunk")
    fixed = F.bitwise_not(F.col("x.both").bitwiseXOR(F.col("x.some"))).bitwiseAND(F.bitwise_not(F.col("y.both").bitwiseXOR(F.col("y.some"))))
    apart = F.bit_count(F.col("x.both").bitwiseXOR(F.col("y.both")).bitwiseAND(fixed))
    same = (F.col("x.segment") == F.col("y.segment")) & (F.col("x.lead") == F.col("y.lead")) & (F.col("x.id") < F.col("y.id"))
    meet = heads.alias("x").join(heads.alias("y"), same).where(apart <= max_bits).select(F.col("x.id").alias("x"), F.col("y.id").alias("y"))
    blobs = chunks.select("id", "chunk").dropDuplicates(["id"])
    pairs = meet.join(blobs.select(F.col("id").alias("x"), F.col("chunk").alias("left")), "x").join(blobs.select(F.col("id").alias("y"), F.col("chunk").alias("right")), "y").select("left", "right")

    def across(batch: pa.RecordBatch) -> pa.RecordBatch:
        ends = ([], [])
        for left, right in zip(batch.column("left"), batch.column("right")):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
            forest = Forest(len(x) + len(y))
            search(build_levels(x, np.zeros(len(x), int)), build_levels(y, np.zeros(len(y), int)), max_bits, lambda a, b, n=len(x): forest.join(a, b + n), same=False)  # noqa: B023
            child, root = forest.links()
            both = np.concatenate([x, y]).astype(np.int64)
            ends[0].append(both[child])
            ends[1].append(both[root])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(e)) for e in ends], names=["a", "b"])

    over = map_batches(pairs, "a long, b long", across)
    return found.where("a IS NOT NULL").select("a", "b").unionByName(over)


def _labelled(signed: DataFrame, max_bits: int) -> DataFrame:
    """(fp, first, rows, label) of stored fingerprints: smallest doc_id, number of rows
    and group of each distinct one."""
    nodes = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")))
    labels = connected_components(fingerprint_links(nodes.select("fp"), max_bits))
    return nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "first", "rows", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    signed = stored(fingerprints(docs, shingle))
    linked = _labelled(signed, max_bits)
    # a component's first document: one row per fingerprint in, one per component out
    best = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    member = linked.join(best, "label").select("fp", "component_id")
    return signed.join(member, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (NULL last); of
    several texts under that id in the group, the one with the smallest row hash.

    Rows are told apart by two hashes of all their columns; rows that agree in every
    column are the same row, of which one stays."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.select(*columns, F.xxhash64(*columns).alias("_h1"), F.xxhash64(F.lit(7), *columns).alias("_h2"))
    signed = stored(fingerprints(hashed, shingle, ["_h1", "_h2"]))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h1", "_h2")
    # per fingerprint first, then per group: no group of copies meets in one task
    first = signed.groupBy("fp").agg(F.min(order).alias("best"))
    chosen = _labelled(signed, max_bits).join(first, "fp").groupBy("label").agg(F.min("best").alias("best"))
    same = signed.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_rows"))
    chosen = chosen.select("best._h1", "best._h2").join(same, ["_h1", "_h2"])
    kept = stored(hashed.join(chosen, ["_h1", "_h2"]))
    single = kept.where("_rows = 1").select(*columns)
    return single.unionByName(kept.where("_rows > 1").dropDuplicates(["_h1", "_h2"]).select(*columns))
