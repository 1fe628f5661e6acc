"""Spelling variants: words one edit apart, found through pivotal bigrams.

Words are letter runs of whole texts, A-Z lowered; counts are added up per task and
then per word.  Bigrams are ranked by how many words hold them, rare first.  A word's
prefix is its three rarest bigrams and all others that tie with the last of them; its
two pivots are the pair of disjoint bigrams of the prefix that is cheapest by that
count, found by dynamic programming over positions.  One edit leaves a pivot whole,
so of two near words the one whose prefix ends at the rarer bigram has a pivot among
the other's prefix bigrams.

Position limits: the edit stands on one side of the surviving pivot.  If right of it,
the words agree up to and with the pivot, at the same position; if left of it, from
the pivot on, the position shifted by the difference in length, at most 1.  So pivots
and prefix bigrams meet on (side, length, the part that must agree), an equi-join;
what meets is verified by edit distance.

A word's form is its near word of largest count (ties: smallest), if that count is
``ratio`` times its own or more; roots follow the forms to the end by pointer jumping
(counts grow ``ratio``-fold per step, so the number of rounds is known).

Defined cases: NULL and empty texts have no words; a NULL doc_id counts as an empty
id in the slip rule; repeated rows count each; a text of any length is read whole;
words without near words have ``n_near`` 0, no form and are their own root; empty
table: no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkit.llm.common import map_batches, stored, utf8

RUN = re.compile("[a-zÀ-ÿ]+")
WORDS_HELD = 300_000  # distinct words a task adds up before it sends them on
SHORTEST = 4  # shorter words have no three bigrams


class Runs:
    """Counts of a text's letter runs.  Slips: where ``every`` divides the crc32 of
    ``<doc_id>:<run>``, the run loses one letter."""

    def __init__(self, every: int | None):
        self.every, self.known = every, {}

    def __call__(self, ident: int | None, text: bytes) -> Counter:
        runs = Counter(RUN.findall(text.lower().decode("utf-8", "replace")))  # bytes.lower: A-Z only
        if not self.every:
            return runs
        known, crc32, every = self.known, zlib.crc32, self.every
        if len(known) > WORDS_HELD:
            known.clear()
        known.update([(run, run.encode()) for run in runs if run not in known])
        start = crc32(f"{'' if ident is None else ident}:".encode())
        slipped = [(run, h) for run in runs if not (h := crc32(known[run], start)) % every]
        moved = [(run, h % len(run), runs.pop(run)) for run, h in slipped]
        for run, at, n in moved:
            runs[run[:at] + run[at + 1:]] += n
        return runs


def count_words(docs: DataFrame, min_length: int, min_count: int, slip: int | None) -> DataFrame:
    """(word, n) of all words of at least ``min_length`` letters and ``min_count`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        runs, held = Runs(slip), Counter()

        def send() -> pa.RecordBatch:
            long = [(w, n) for w, n in held.items() if len(w) >= min_length]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in long], pa.string()), pa.array([n for _, n in long], pa.int64())], names=["word", "n"])

        for batch in batches:
            for ident, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                if text:
                    held.update(runs(ident, text))
                    if len(held) > WORDS_HELD:
                        yield send()
        yield send()

    counted = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def cheapest_disjoint(at: Sequence[int], cost: Sequence[int], picks: int = 2, width: int = 2) -> tuple[int, ...]:
    """Places (in ``at``, ascending) of ``picks`` bigrams that do not overlap, of least
    total cost: best[k][i] is the cheapest choice of k among the first i."""
    best = [[(0, ())] * (len(at) + 1)]
    for _ in range(picks):
        row = [(math.inf, ())]
        for i, p in enumerate(at):
            free = next((j for j in range(i, 0, -1) if at[j - 1] + width <= p), 0)  # of the first i, those that end before p
            total, chosen = best[-1][free]
            row.append(min(row[-1], (total + cost[i], (*chosen, i)), key=lambda c: c[0]))
        best.append(row)
    return best[-1][-1][1]


def signature(word: str, words_with: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """Where the prefix ends in the order of bigrams, keys of the pivots, keys of the prefix."""
    cost = [words_with[word[i:i + 2]] for i in range(len(word) - 1)]
    last = sorted(cost)[2]
    prefix = [i for i, c in enumerate(cost) if c <= last]
    pivots = [prefix[i] for i in cheapest_disjoint(prefix, [cost[i] for i in prefix])]

    def keys(i: int, length: int) -> list[int]:
        return [xxhash.xxh3_64_intdigest(f"{length}<{word[:i + 2]}") >> 1, xxhash.xxh3_64_intdigest(f"{length}>{word[i:]}") >> 1]

    asked = [k for i in pivots for length in (len(word) - 1, len(word), len(word) + 1) for k in keys(i, length)]
    return last, asked, [k for i in prefix for k in keys(i, len(word))]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n) -> (word, other, other_n): both directions of every pair one edit apart."""
    grams = words.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2))))).alias("gram"))
    # bounded by the alphabet of the runs: at most 90 letters squared
    words_with = dict(grams.groupBy("gram").count().collect())

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [signature(w, words_with) for w in batch.column("word").to_pylist()]
        columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), *columns], names=["word", "n", "last", "asked", "held"])

    signed = stored(map_batches(words, "word string, n long, last long, asked array<long>, held array<long>", work))
    one, two = (signed.select(F.explode(c).alias("key"), *(F.col(x).alias(f"{x}_{k}") for x in ("word", "n", "last"))) for k, c in (("a", "asked"), ("b", "held")))
    met = one.join(two, "key").where("last_a <= last_b").where(F.levenshtein("word_a", "word_b", 1) == 1)
    both = F.array(*(F.struct(F.col(f"word_{x}").alias("word"), F.col(f"word_{y}").alias("other"), F.col(f"n_{y}").alias("other_n")) for x, y in ("ab", "ba")))
    return met.select(F.explode(both).alias("p")).select("p.*").distinct()


def spelling_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, slip: int | None = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs``."""
    if min_length < SHORTEST or ratio < 2:
        raise ValueError(f"words of {SHORTEST} letters at least, and a ratio of 2 at least")
    words = stored(count_words(docs, min_length, min_count, slip))
    best = F.min(F.struct((-F.col("other_n")).alias("m"), "other"))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left").withColumn("form_n", F.when(-F.col("best.m") >= ratio * F.col("n"), -F.col("best.m")))
    known = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n", F.when(F.col("form_n").isNotNull(), F.col("best.other")).alias("form")))
    most = words.agg(F.max("n")).first()[0] or 1
    steps = max(0, math.floor(math.log(most / max(1, min_count), ratio) + 1e-9)) if most > min_count else 0
    ends = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    reach = 1
    while reach < steps:
        ends = stored(ends)
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("_end"))
        ends = ends.join(further, "root", "left").select("word", F.coalesce("_end", "root").alias("root"))
        reach *= 2
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
