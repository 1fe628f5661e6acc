"""Substring dedup: a count-min prefilter, then exact groups of what it lets through.

Documents are dealt once to chunks of about ``CHUNK_BYTES`` by a hash of their id.

0. Texts that are equal as a whole are grouped first: of a group only the least
   doc_id goes on (any window of the others starts there too), so thousands of
   copies cost no window traffic.
1. Each chunk hashes its windows (``window`` consecutive words) into every row of
   a count-min sketch.  Its partial sketch travels as compressed gaps between the
   occupied counters, one record per section of a row, and sections are merged by
   the section's task, so no task or driver holds a whole row.  Each chunk gets
   back which of its own counters add up to two or more.
2. Each chunk keeps the windows that every row estimates as repeated and groups
   them exactly, by a 128-bit hash of their words, to (least doc_id, more than one
   document); groups of all chunks meet by that hash, at most one record per
   chunk.  Overestimates drop out here; a repeated window cannot be lost.
3. Chunks that hold a document with a larger id than the least one of a window get
   that id back, mark the covered words and cut them out.

The dealt texts are shuffled once; all steps read that one exchange.

Defined cases: NULL and empty texts have 0 words; texts shorter than a window
keep all; rows with one doc_id do not remove from each other; a row without
doc_id neither removes nor loses words; an untouched text is kept as it is, a
changed one is its kept words joined by one space; empty table: no rows; other
columns can ride along (``carry``) and are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftkit.llm.common import Memo, stored

CHUNK_BYTES = 6 << 20
SECTION = 1 << 24  # counters of a sketch row that one record covers
ROWS = 2
SPARE = 4  # counters per expected window, in each row
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ROW_MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
WORD_MEMO = 100_000
COPY = -1  # marks records that name later copies


def word_lanes(words: list[bytes], memo: Memo) -> np.ndarray:
    """128 bits per word as two columns."""
    return np.frombuffer(b"".join(map(memo.__getitem__, words)), np.uint64).reshape(-1, 2)


def window_lane(h: np.ndarray, window: int, multiplier: int) -> np.ndarray:
    """Polynomial hash of every window, by doubling, then mixed."""
    n, m = len(h) - window + 1, (1 << 64) - 1
    out, done, power, span, rest = None, 0, h, 1, window
    while rest:
        if rest & 1:
            piece = power[done:done + n]
            out = piece.copy() if out is None else out * np.uint64(pow(multiplier, span, 1 << 64) & m) + piece
            done += span
        rest >>= 1
        if rest:
            power = power[:len(power) - span] * np.uint64(pow(multiplier, span, 1 << 64) & m) + power[span:]
            span *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def chunk_windows(texts: list[bytes | None], window: int, memo: Memo) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Words per document, both lanes of all windows, document of each window."""
    counts, one, two, owner = [], [], [], []
    for i, text in enumerate(texts):
        words = text.split() if text else []
        counts.append(len(words))
        if len(words) >= window:
            lanes = word_lanes(words, memo)
            one.append(window_lane(np.ascontiguousarray(lanes[:, 0]), window, MULTIPLIERS[0]))
            two.append(window_lane(np.ascontiguousarray(lanes[:, 1]), window, MULTIPLIERS[1]))
            owner.append(np.full(len(words) - window + 1, i, np.int32))
    none = np.zeros(0, np.uint64)
    lanes = np.stack([np.concatenate(one), np.concatenate(two)]) if one else np.stack([none, none])
    return counts, lanes, np.concatenate(owner) if owner else np.zeros(0, np.int32)


def counters(lanes: np.ndarray, row: int, width_bits: int) -> np.ndarray:
    """Counter of each window in a sketch row (the top bits of a multiplied hash)."""
    return ((lanes[0] ^ (lanes[1] << np.uint64(row))) * np.uint64(ROW_MULTIPLIERS[row])) >> np.uint64(64 - width_bits)


def squeeze(ascending: np.ndarray) -> bytes:
    """Gaps of ascending offsets below 2 ** 24 as three byte planes, compressed."""
    gaps = np.diff(ascending, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.T).tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(3, -1).astype(np.int64)
    return np.cumsum(planes[0] | planes[1] << 8 | planes[2] << 16)


def binary(column: pa.ChunkedArray) -> list[bytes]:
    return column.to_pylist()


def utf8_table(table: pa.Table) -> list[bytes | None]:
    return table.column("text").cast(pa.binary()).to_pylist()


def doc_ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which rows have one."""
    known = table.column("doc_id").is_valid().to_numpy()
    return table.column("doc_id").fill_null(0).to_numpy(), known


def copy_rows(table: pa.Table, copies: pa.Table) -> np.ndarray:
    """Which rows are later copies of a whole text (by id and text hash)."""
    listed = set(zip(copies.column("doc_id").to_pylist(), copies.column("mark").to_pylist()))
    return np.fromiter((x in listed for x in zip(table.column("doc_id").to_pylist(), table.column("mark").to_pylist())), bool, table.num_rows)


def without_copies(table: pa.Table, copies: pa.Table) -> list[bytes | None]:
    """Texts of a chunk, later copies of a whole text left out."""
    return [None if gone else text for text, gone in zip(utf8_table(table), copy_rows(table, copies))]


def of(kind: dict, **columns) -> pa.Table:
    return pa.table({k: pa.array(v, kind[k]) for k, v in columns.items()})


def new_memo() -> Memo:
    return Memo(xxhash.xxh3_128_digest, WORD_MEMO)


def deduplicated(docs: DataFrame, window: int = 13, carry: str | None = None, with_text: bool = True, chunk_bytes: int = CHUNK_BYTES, spare: int = SPARE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (+ kept_text, + the struct column
    ``carry``) for every row of ``docs``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    width_bits = max(16, int(spare * size / 6).bit_length())  # about six bytes a word
    sections = max(1, (1 << width_bits) // SECTION)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("mark")] + ([F.col(carry)] if carry else [])
    chunk = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))), F.lit(chunks)).cast("int").alias("chunk")
    dealt = docs.select(chunk, *columns).repartition(int(chunks), "chunk")

    slim = stored(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(chunk, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.sha2("text", 256).alias("whole")))
    least_of = slim.groupBy("whole").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("most > least").drop("most")
    later = slim.join(least_of, "whole").where("doc_id > least").select("chunk", "doc_id", "mark").distinct()

    def sketch(table: pa.Table, copies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return of(SKETCH, part=[], chunk=[], once=[], more=[])
        _, lanes, _ = chunk_windows(without_copies(table, copies), window, new_memo())
        part, once, more = [], [], []
        for row in range(ROWS):
            at, n = np.unique(counters(lanes, row, width_bits), return_counts=True)
            at = at.astype(np.int64)
            cuts = np.searchsorted(at, np.arange(sections + 1) * SECTION)
            for s in np.flatnonzero(np.diff(cuts)):
                own, many = at[cuts[s]:cuts[s + 1]] - s * SECTION, n[cuts[s]:cuts[s + 1]] > 1
                part.append(row * sections + int(s))
                once.append(squeeze(own[~many]))
                more.append(squeeze(own[many]))
        own_chunk = [table.column("chunk")[0].as_py()] * len(part)
        return of(SKETCH, part=part, chunk=own_chunk, once=once, more=more)

    def merge(table: pa.Table) -> pa.Table:
        seen, twice = np.zeros(SECTION, bool), np.zeros(SECTION, bool)
        once, more = ([unsqueeze(b) for b in binary(table.column(c))] for c in ("once", "more"))
        for a, b in zip(once, more):
            twice[a[seen[a]]] = True
            seen[a] = True
            twice[b] = True
        hot = [np.sort(np.concatenate([a[twice[a]], b])) for a, b in zip(once, more)]
        keep = [i for i, h in enumerate(hot) if len(h)]
        return of(REPLY, chunk=table.column("chunk").take(pa.array(keep, pa.int64())).combine_chunks(), part=table.column("part").take(pa.array(keep, pa.int64())).combine_chunks(), hot=[squeeze(hot[i]) for i in keep])

    def group(table: pa.Table, reply: pa.Table) -> pa.Table:
        copies = reply.filter(pc.equal(reply.column("part"), COPY))
        reply = reply.filter(pc.not_equal(reply.column("part"), COPY))
        if not table.num_rows or not reply.num_rows:
            return of(KEYS, chunk=[], one=[], two=[], first=[], several=[])
        _, lanes, owner = chunk_windows(without_copies(table, copies), window, new_memo())
        ids, known = doc_ids(table)
        parts = reply.column("part").to_numpy()
        passed = known[owner]
        for row in range(ROWS):
            hot = [unsqueeze(b) + (p - row * sections) * SECTION for p, b in zip(parts.tolist(), binary(reply.column("hot"))) if p // sections == row]
            hot = np.sort(np.concatenate(hot)).astype(np.uint64) if hot else np.zeros(0, np.uint64)
            at = counters(lanes, row, width_bits)
            passed &= hot[np.minimum(np.searchsorted(hot, at), len(hot) - 1)] == at if len(hot) else False
        lanes, of_doc = lanes[:, passed], ids[owner[passed]]
        order = np.lexsort((of_doc, lanes[1], lanes[0]))
        lanes, of_doc = lanes[:, order], of_doc[order]
        new = np.concatenate([[True], (np.diff(lanes[0]) != 0) | (np.diff(lanes[1]) != 0)]) if len(of_doc) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(of_doc))[:len(head)] - 1  # no head at all where nothing passed
        return of(KEYS, chunk=np.full(len(head), table.column("chunk")[0].as_py(), np.int32), one=lanes[0][head].view(np.int64), two=lanes[1][head].view(np.int64), first=of_doc[head], several=of_doc[last] > of_doc[head])

    def cut(table: pa.Table, reply: pa.Table) -> pa.Table:
        copies = reply.filter(pc.is_null(reply.column("first")))
        reply = reply.filter(pc.is_valid(reply.column("first")))
        texts, memo = utf8_table(table), new_memo()
        ids, known = doc_ids(table)
        copied = copy_rows(table, copies)
        one, two = (reply.column(c).to_numpy().view(np.uint64) for c in ("one", "two"))
        order = np.lexsort((two, one))
        one, two, first = one[order], two[order], reply.column("first").to_numpy()[order]
        runs = int(np.unique(one, return_counts=True)[1].max()) if len(one) else 0
        n_words, n_removed, sha, kept_text = [], [], [], []
        for i, text in enumerate(texts):
            words = text.split() if text else []
            hit = np.zeros(0, bool)
            if copied[i]:
                hit = np.ones(max(0, len(words) - window + 1), bool)
            elif runs and known[i] and len(words) >= window:
                _, lanes, _ = chunk_windows([text], window, memo)
                at, hit = np.searchsorted(one, lanes[0]), np.zeros(lanes.shape[1], bool)
                for step in range(runs):  # equal first lanes stand together
                    j = np.minimum(at + step, len(one) - 1)
                    hit |= (one[j] == lanes[0]) & (two[j] == lanes[1]) & (first[j] < ids[i])
            removed = 0
            if hit.any():
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.flatnonzero(hit), 1)
                np.add.at(edge, np.flatnonzero(hit) + window, -1)
                stay = np.cumsum(edge[:-1]) == 0
                removed = int(len(words) - stay.sum())
                kept = b" ".join([words[j] for j in np.flatnonzero(stay)])
            else:
                kept = b" ".join(words)
            n_words.append(len(words))
            n_removed.append(removed)
            sha.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_text.append(kept.decode() if removed else None if text is None else text.decode())
        out = {"doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        if with_text:
            out["kept_text"] = pa.array(kept_text, pa.string())
        if carry:
            out[carry] = table.column(carry)
        return pa.table(out)

    by_chunk = dealt.groupBy("chunk")
    copies = later.select("chunk", F.lit(COPY).alias("part"), F.lit(None).cast("binary").alias("hot"), "doc_id", "mark")
    sketches = by_chunk.cogroup(copies.groupBy("chunk")).applyInArrow(sketch, "part int, chunk int, once binary, more binary")
    replies = sketches.groupBy("part").applyInArrow(merge, "chunk int, part int, hot binary").unionByName(copies, allowMissingColumns=True)
    keys = by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(group, "chunk int, one long, two long, first long, several boolean")
    least = keys.withColumn("least", F.min("first").over(Window.partitionBy("one", "two")))
    back = least.where("least < first OR several").select("chunk", "one", "two", F.col("least").alias("first"))
    back = back.unionByName(later.select("chunk", "doc_id", "mark"), allowMissingColumns=True)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    if carry:
        schema += f", {carry} {docs.schema[carry].dataType.simpleString()}"
    return by_chunk.cogroup(back.groupBy("chunk")).applyInArrow(cut, schema)


SKETCH = {"part": pa.int32(), "chunk": pa.int32(), "once": pa.binary(), "more": pa.binary()}
REPLY = {"chunk": pa.int32(), "part": pa.int32(), "hot": pa.binary()}
KEYS = {"chunk": pa.int32(), "one": pa.int64(), "two": pa.int64(), "first": pa.int64(), "several": pa.bool_()}


def without_repeats(docs: DataFrame, window: int = 13, text: str = "text") -> DataFrame:
    """``docs``, same columns, with repeated passages cut out of the texts; a document
    that loses all its words goes."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("whole")
    slim = docs.select(F.col("doc_id"), F.col(text).alias("text"), rest)
    out = deduplicated(slim, window, carry="whole").where("n_removed = 0 OR n_removed < n_words")
    done = {text: F.col("kept_text")}
    if "n_chars" in docs.columns:
        done["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("whole.n_chars"))
    return out.select(*[done.get(c, F.col(f"whole.`{c}`")).alias(c) for c in docs.columns])
