"""Best-fit packing by the configuration linear program over the length histogram.

Pieces of at most ``capacity`` tokens are counted by length (a histogram of at
most ``capacity`` numbers is all that reaches the driver).  A configuration is a
multiset of lengths that fits one sequence.  The fractional program - fewest
configurations that cover every length - is worked on by multiplicative weights:

* a length's price falls exponentially with how far its cover is ahead of the round;
* one knapsack dynamic program over the capacity prices all configurations, and for
  every length the best one that holds it is read off; those within ``slack`` of the
  dearest take part;
* each takes a small step: what its scarcest length allows, shared by all that want
  that length, and in all at most 1 / rounds of the tokens.

The prices over the dearest configuration are a feasible dual, whose value bounds the
number of sequences from below.  The averaged steps are rounded at random (seeded,
never above what is left), and what they leave goes, longest first, to the fullest
sequence that still takes it, room in planned sequences included.  The plan is a list
of (configuration, number of sequences); pieces are ranked within their length by
distributed prefix sums and take their places from the plan by rank.

Tokenization: the vocabulary's tokenizer splits at white space and between letter
runs, digits and other runs, so ids are made per distinct such piece and kept in a
bounded memo; texts with characters outside a plain set go, white-space word by
white-space word, through the tokenizer itself.

Defined cases: NULL text is an empty text (one token, the end id); repeated rows
are packed each; a text of any length is cut into full pieces and a rest; other
columns are not read; empty table: no rows.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftkit.llm.common import KEY_RANGE, Memo, map_batches, seeded_key, stored, utf8
from driftkit.llm.ordering import bucket_count, prefix_before
from driftkit.llm.wordpiece import byte_alphabet

CAPACITY = 4096
END_ID = 1
MEMO_PIECES = 150_000
# characters on which NFC is the identity and lower-casing is one to one
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*\Z")
# the tokenizer's own split on those characters, after lower-casing
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class Ids:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = {b: c for c, b in byte_alphabet().items()}
        self.model = self.tokenizer.model
        self.pieces = Memo(self._piece, MEMO_PIECES)
        self.words = Memo(self._word, MEMO_PIECES // 10)

    def _piece(self, piece: str) -> bytes:
        printed = piece.encode().decode("latin-1").translate(self.table)
        return np.array([t.id for t in self.model.tokenize(printed)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if PLAIN.match(text) and not any(s in text for s in self.special):
            return b"".join(map(self.pieces.__getitem__, SPLIT.findall(text.lower())))
        out = []
        for word in text.split(" "):  # a space never joins what stands around it
            if PLAIN.match(word) and not any(s in word for s in self.special):
                out += map(self.pieces.__getitem__, SPLIT.findall(word.lower()))
            else:
                out.append(self.words[word])
        return b"".join(out)


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: whole documents, cut only where longer."""
    end = np.array([end_id], "<u4").tobytes()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = ids_of(vocabulary)
        row, piece, start, length, crc = [], [], [], [], []
        for i, text in enumerate(utf8(batch.column("text"))):
            data = (encode(text.decode("utf-8", "replace")) if text else b"") + end
            for p, a in enumerate(range(0, len(data), 4 * capacity)):
                part = data[a:a + 4 * capacity]
                row.append(i)
                piece.append(p)
                start.append(a // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text"), "doc_id long, piece int, start long, length long, ids_crc32 long", work)


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest price within c tokens, for every c, and the piece taken last (-1: none,
    a token is left free).  ``lengths`` ascend."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        value = best[c - lengths[:fitting[c]]] + price[:fitting[c]]
        i = int(value.argmax())
        best[c] = max(value[i], best[c - 1])
        choice[c] = i if value[i] > best[c - 1] else -1
    return best, choice


def read_off(lengths: np.ndarray, choice: np.ndarray, first: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The best configuration that holds each of ``first``: (configuration, piece) pairs."""
    taken = np.maximum.accumulate(np.where(choice >= 0, np.arange(capacity + 1), 0))
    config, piece, room, live = [np.arange(len(first))], [first], capacity - lengths[first], np.arange(len(first))
    while True:
        at = taken[room[live]]
        live, at = live[choice[at] >= 0], at[choice[at] >= 0]
        if not len(live):
            return np.concatenate(config), np.concatenate(piece)
        config.append(live)
        piece.append(choice[at])
        room[live] = at - lengths[choice[at]]


def configuration_program(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 24, eta: float = 2.0, slack: float = 0.02) -> tuple[list[tuple], float]:
    """Per round (configuration, piece, amount of each configuration); and the dual bound
    on the number of sequences."""
    n, tokens = counts.astype(float), float((counts * lengths).sum())
    cover, out, bound = np.zeros(len(n)), [], tokens / capacity
    for t in range(rounds):
        price = lengths / capacity * np.exp(eta * np.clip(t / rounds - cover / n, -8, 8))
        best, choice = knapsack(lengths, price, capacity)
        bound = max(bound, float((n * price).sum() / best[capacity]))
        first = np.flatnonzero(price + best[capacity - lengths] >= (1 - slack) * best[capacity])
        config, piece = read_off(lengths, choice, first, capacity)
        wanted = np.bincount(piece, n[first][config], len(n))
        share = np.ones(len(first))
        np.minimum.at(share, config, (n / np.maximum(wanted, 1e-300))[piece])
        amount = n[first] * share
        used = float((np.bincount(piece, amount[config], len(n)) * lengths).sum())
        amount *= min(1.0, tokens / rounds / used)
        cover += np.bincount(piece, amount[config], len(n))
        out.append((config, piece, amount))
    return out, bound


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int, begun: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Longest first, each to the fullest sequence that still takes it, the ``begun``
    ones included; like sequences stand for each other, so the work follows the histogram."""
    room: dict[int, list] = {}  # free tokens -> [[config, sequences]]
    for config, many in begun:
        room.setdefault(capacity - sum(int(lengths[i]) * n for i, n in config.items()), []).append([config, many])
    for i in np.argsort(-lengths, kind="stable"):
        n, size = int(counts[i]), int(lengths[i])
        while n:
            free = min((r for r in room if r >= size), default=None)
            if free is None:
                config, many, free = {}, n, capacity
            else:
                config, many = room[free].pop()
                if not room[free]:
                    del room[free]
            each = min(free // size, n)
            used = min(many, n // each)
            if used < many and free is not None and config:
                room.setdefault(free, []).append([config, many - used])
            new = dict(config)
            new[int(i)] = new.get(int(i), 0) + each
            room.setdefault(free - each * size, []).append([new, used])
            n -= each * used
    return [(config, many) for entries in room.values() for config, many in entries]


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, seed: int = 11) -> list[tuple[dict[int, int], int]]:
    """Integer plan that uses every piece exactly once: [({length: copies}, sequences)]."""
    if not len(lengths):
        return []
    rng, left, begun = np.random.default_rng(seed), counts.astype(np.int64).copy(), []
    for config, piece, amount in configuration_program(lengths, counts, capacity)[0]:
        whole = np.floor(amount + rng.random(len(amount))).astype(np.int64)
        order = np.argsort(config, kind="stable")
        cuts, piece = np.searchsorted(config[order], np.arange(len(amount) + 1)), piece[order]
        for i in np.flatnonzero(whole):
            own, copies = np.unique(piece[cuts[i]:cuts[i + 1]], return_counts=True)
            many = int(min(whole[i], (left[own] // copies).min()))
            if many:
                left[own] -= copies * many
                begun.append((dict(zip(own.tolist(), copies.tolist())), many))
    return [({int(lengths[i]): n for i, n in config.items()}, many) for config, many in best_fit(lengths, left, capacity, begun)]


def places(made: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan by (length, first rank): where pieces of those ranks go."""
    rows, used, sequence = [], {}, 0
    for config, many in made:
        offset = 0
        for length, n in sorted(config.items(), reverse=True):
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, n, offset))
            used[length] = rank + n * many
            offset += n * length
        sequence += many
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "rank", "sequence", "each", "offset"))}


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, seed: int = 11) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(cut_pieces(docs, vocabulary, capacity, end_id))
    histogram = sorted(pieces.groupBy("length").count().collect())  # at most `capacity` rows
    lengths, counts = (np.array([r[i] for r in histogram], np.int64) for i in (0, 1))
    at = places(plan(lengths, counts, capacity))
    keyed = pieces.withColumn("key", seeded_key(seed, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece")))
    tie = [F.col(c) for c in ("key", "doc_id", "piece", "ids_crc32")]
    ranked = prefix_before(keyed, ["length"], F.col("key") / KEY_RANGE, tie, {"n": F.lit(1).cast("long")}, bucket_count(int(counts.sum()))).drop("key", "n_total")
    big = int(counts.max(initial=0)) + 1
    index = at["length"] * big + at["rank"]  # the plan's size is bounded by the histogram

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "n_before"))
        i = np.searchsorted(index, length * big + rank, side="right") - 1
        along = rank - at["rank"][i]
        sequence = at["sequence"][i] + along // at["each"][i]
        offset = at["offset"][i] + along % at["each"][i] * length
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return map_batches(ranked, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", work)
