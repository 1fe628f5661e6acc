"""Toxicity by the nearest labelled examples: exact TF-IDF cosines over a block-max
inverted index.

Fit, on a bounded sample of labelled rows (``sample_rows`` per class, a parameter):
terms are letter runs, lower-cased, and the first five letters of longer runs.  EVERY term of the examples is indexed; document frequencies for
the IDF are counted over ALL documents.  A term's weight in a text is

    (1 + log tf) * idf * (1 + chi / ``boost``),

where chi is the chi-square of the term among the examples if it is more frequent in
toxic ones, else 0: words that go with the label count for more, at every rarity and
without a cut; where a text has none, its plain TF-IDF decides.

Search: examples stand in blocks of 64 like ones (dealt by their nearest seed); the
index holds postings per (term, block) and each term's largest value per block.  Terms
that a sixteenth of the examples have are added up first, for a run of texts by one
matrix product; a text's bound for a block is the largest such sum in the block plus
the product of its other weights with the block's maxima.  Blocks are visited by
falling bound until none reaches the k-th best cosine, so the k nearest are exact.

Score: the k nearest vote, weighted by squared cosine and class weight, smoothed with
the toxic share of the labelled rows.  Votes become probabilities by a logistic map of
their log-odds, fitted on the examples themselves, each searched without itself and
without its own part in chi.

The index goes to the tasks as one Spark broadcast; it holds at most ``MAX_POSTINGS``
postings, or the fit ends with an error that asks for a smaller sample.

Defined cases: NULL and empty texts, and texts without a term of any example, score the
toxic share; repeated rows score alike; ties (within 1e-9) go to the smaller doc_id;
an id with several texts takes part with one of them (the smallest); without labelled
rows every score is 0; with one class alone votes stay as they are; empty table: no
rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkit.llm.common import in_training, labelled_sample, map_batches, stored, utf8

SAMPLE_ROWS = 1000
BLOCK = 64
SEEDS = 48
FIRST_BLOCKS = 6
COMMON = 16  # a term is common if one example in so many has it
RUN = 64  # texts searched together
MAX_POSTINGS = 20_000_000
BEGINNING = 5
LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: bytes | None) -> dict[str, int]:
    """Counts of a text's letter runs; only words with other characters are searched for them."""
    words = Counter(text.decode("utf-8", "replace").lower().split()) if text else {}
    runs = {word: n for word, n in words.items() if word.isalpha()}
    for word, n in words.items():
        if not word.isalpha():
            for run in LETTERS.findall(word):
                runs[run] = runs.get(run, 0) + n
    return runs


def text_terms(text: bytes | None) -> Counter:
    """Counts of a text's terms: letter runs, and the beginnings of longer ones."""
    runs = letter_runs(text)
    terms = Counter(runs)
    for run, n in runs.items():
        if len(run) > BEGINNING:
            terms[run[:BEGINNING] + "*"] += n
    return terms


class Matcher:
    """Places in the vocabulary, and counts, of those terms of a text that are in it."""

    def __init__(self, vocabulary: list[str]):
        self.whole = {t: i for i, t in enumerate(vocabulary) if t[-1] != "*"}
        self.beginning = {t[:-1]: i for i, t in enumerate(vocabulary) if t[-1] == "*"}

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        whole, beginning, found = self.whole.get, self.beginning.get, {}
        for run, n in letter_runs(text).items():
            if (place := whole(run)) is not None:
                found[place] = n
            if len(run) > BEGINNING and (place := beginning(run[:BEGINNING])) is not None:
                found[place] = found.get(place, 0) + n
        size = len(found)
        return np.fromiter(found.keys(), np.int64, size), np.fromiter(found.values(), np.float64, size)


def signed_chi(n1: np.ndarray, n0: np.ndarray, all1: float, all0: float) -> np.ndarray:
    """Chi-square of terms in n1 of all1 toxic and n0 of all0 other examples; 0 where
    toxic ones do not have the term more often."""
    if all1 <= 0 or all0 <= 0:
        return np.zeros(len(n1))
    rest1, rest0 = all1 - n1, all0 - n0
    chi = (n1 * rest0 - n0 * rest1) ** 2 * (all1 + all0) / (np.maximum(n1 + n0, 1e-9) * np.maximum(rest1 + rest0, 1e-9) * all1 * all0)
    return np.where(n1 * all0 > n0 * all1, chi, 0.0)


@dataclass
class Index:
    """Block-max inverted index of unit example vectors."""

    vocabulary: list[str]  # all terms of the examples
    idf: np.ndarray
    toxic_rows: np.ndarray  # per term: toxic examples that have it, and others
    other_rows: np.ndarray
    ids: np.ndarray  # per example
    toxic: np.ndarray
    weight: np.ndarray
    boost: float
    postings: tuple  # (term, example, count), by term
    own: dict = field(init=False)

    def __post_init__(self):
        self.size = (float(self.toxic.sum()), float((1 - self.toxic).sum()))
        self.weights = self.idf * (1 + signed_chi(self.toxic_rows, self.other_rows, *self.size) / self.boost)
        total = float(self.weight.sum())
        self.prior = float((self.toxic * self.weight).sum()) / total if total else 0.0
        term, example, count = self.postings
        value = (1 + np.log(count)) * self.weights[term]
        norm = np.sqrt(np.bincount(example, value * value, len(self.ids)))
        value = value / np.where(norm > 0, norm, 1.0)[example]
        place = self._like_together(term, example, value)
        self.ids, self.toxic, self.weight = (x[np.argsort(place)] for x in (self.ids, self.toxic, self.weight))
        order = np.lexsort((place[example], term))
        self.postings = (term[order].astype(np.int32), place[example][order].astype(np.int32), value[order])
        self.own = {}

    def _like_together(self, term: np.ndarray, example: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Place of each example in an order in which like ones are neighbours."""
        seeds = np.linspace(0, len(self.ids) - 1, min(SEEDS, len(self.ids))).astype(np.int64) if len(self.ids) else np.zeros(0, np.int64)
        like = np.zeros((len(self.ids), len(seeds)))
        for i, s in enumerate(seeds):
            weights = np.zeros(len(self.idf))
            weights[term[example == s]] = value[example == s]
            like[:, i] = np.bincount(example, value * weights[term], len(self.ids))
        nearest = like.argmax(axis=1) if len(seeds) else np.zeros(len(self.ids))
        place = np.empty(len(self.ids), np.int64)
        place[np.lexsort((self.ids, nearest, self.toxic))] = np.arange(len(self.ids))
        return place

    def open(self) -> "Index":
        """What a task makes of the index once: starts and maxima per (term, block)."""
        if not self.own:
            term, example, value = self.postings
            self.blocks = max(1, -(-len(self.ids) // BLOCK))
            cell = term.astype(np.int64) * self.blocks + example // BLOCK
            self.starts = np.searchsorted(cell, np.arange(len(self.idf) * self.blocks + 1)).astype(np.int32)  # MAX_POSTINGS fits
            self.largest = np.zeros((len(self.idf), self.blocks), np.float32)
            if len(cell):
                first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                # rounded up, as the maxima are bounds
                self.largest.reshape(-1)[cell[first]] = np.nextafter(np.maximum.reduceat(value, first).astype(np.float32), np.float32(2))
            common = np.bincount(term, minlength=len(self.idf)) * COMMON >= max(1, len(self.ids))
            self.row = np.full(len(self.idf), -1)  # of common terms, in the matrix of their values
            self.row[common] = np.arange(common.sum())
            self.dense = np.zeros((int(common.sum()), self.blocks * BLOCK))
            at = self.row[term] >= 0
            self.dense[self.row[term[at]], example[at]] = value[at]
            self.own["ready"] = True
        return self

    def vector(self, terms: np.ndarray, counts: np.ndarray, label: int | None = None) -> np.ndarray:
        """Unit weights of a text's terms; with ``label`` as if the text, an example of
        that class, had no part in chi."""
        if label is None:
            weights = self.weights[terms]
        else:
            chi = signed_chi(self.toxic_rows[terms] - label, self.other_rows[terms] - (1 - label), self.size[0] - label, self.size[1] - (1 - label))
            weights = self.idf[terms] * (1 + chi / self.boost)
        weights = (1 + np.log(counts)) * weights
        return weights / (np.sqrt((weights * weights).sum()) or 1.0)

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of a run of texts (terms, unit weights): places and cosines of the k
        examples of highest positive cosine.  ``without``: an example to leave out of each."""
        common = np.zeros((len(texts), len(self.dense)))
        for i, (terms, weights) in enumerate(texts):
            row = self.row[terms]
            common[i, row[row >= 0]] = weights[row >= 0]
        sums = common @ self.dense
        if without:
            sums[np.arange(len(texts)), without] = -np.inf
        out = []
        for (terms, weights), known in zip(texts, sums):
            rare = self.row[terms] < 0
            out.append(self._search(terms[rare], weights[rare], known, k))
        return out

    def _search(self, terms: np.ndarray, weights: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        _, examples, values = self.postings
        bound = known.reshape(self.blocks, BLOCK).max(axis=1) + (weights.astype(np.float32) @ self.largest[terms]) * (1 + 1e-5)
        queue = np.argsort(-bound, kind="stable")
        at, best, take = np.zeros(0, np.int64), np.zeros(0), FIRST_BLOCKS
        while len(queue):
            limit = best[k - 1] - 1e-9 if len(best) >= k else 0.0
            queue = queue[bound[queue] > limit]
            blocks, queue = queue[:take], queue[take:]
            take *= 2
            if not len(blocks):
                break
            cells = (terms[:, None] * self.blocks + blocks).ravel()
            begin = self.starts[cells]
            n = self.starts[cells + 1] - begin
            ends = np.cumsum(n, dtype=np.int32)
            posting = np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
            rest = np.bincount(examples[posting], np.repeat(np.repeat(weights, len(blocks)), n) * values[posting], len(known))
            seen = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            score = np.round(known[seen] + rest[seen], 9)
            hit = score > 0
            at, best = np.concatenate([at, seen[hit]]), np.concatenate([best, score[hit]])
            order = np.lexsort((self.ids[at], -best))[:k]
            at, best = at[order], best[order]
        return at, best

    def vote(self, at: np.ndarray, cosine: np.ndarray, smoothing: float) -> float:
        vote = np.minimum(cosine, 1.0) ** 2 * self.weight[at]
        return (float((vote * self.toxic[at]).sum()) + smoothing * self.prior) / (float(vote.sum()) + smoothing)


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def fit_calibration(votes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of the logistic map, by damped Newton steps on
    targets that are pulled off 0 and 1 by one row each."""
    ones, zeros = float((weight * y).sum()), float((weight * (1 - y)).sum())
    if not ones or not zeros:
        return 1.0, 0.0
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.column_stack([log_odds(votes), np.ones(len(votes))])
    fit = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ fit))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (weight * (p - target)))
        fit = fit - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(fit[0]), 0.0), float(fit[1])


def fit_index(docs: DataFrame, labels: DataFrame, sample_rows: int, boost: float, seed: int) -> tuple[Index, DataFrame]:
    """The index, and the sample it was made of (doc_id, text, y, weight)."""
    picked = labelled_sample(labels, "toxic", {0: sample_rows, 1: sample_rows}, seed)
    # at most 2 * sample_rows rows of three numbers: a proven bound for the broadcast
    held = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("weight").alias("weight"))
    sample = stored(held)

    def examples(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [text_terms(t) for t in utf8(batch.column("text"))]
        lists = [pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "y", "weight")), *lists], names=["doc_id", "y", "weight", "terms", "counts"])

    made = stored(map_batches(sample, "doc_id long, y int, weight double, terms array<string>, counts array<long>", examples))
    size = made.agg(F.sum(F.size("terms"))).first()[0] or 0
    if size > MAX_POSTINGS:
        raise ValueError(f"the examples have {size} terms, more than {MAX_POSTINGS}: take a smaller sample_rows")
    rows = made.orderBy("doc_id").toArrow().combine_chunks()
    coded = pc.list_flatten(rows.column("terms")).combine_chunks().dictionary_encode()
    vocabulary, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    counts = pc.list_flatten(rows.column("counts")).to_numpy()
    example = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("terms")).to_numpy())
    y = rows.column("y").to_numpy().astype(float)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def frequencies(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Documents of the batch that have a term, added up before terms are looked up."""
        runs, beginnings = Counter(), Counter()
        texts = utf8(batch.column("text"))
        for text in texts:
            own = letter_runs(text)
            runs.update(own.keys())
            beginnings.update({run[:BEGINNING] for run in own if len(run) > BEGINNING})
        if "matcher" not in state:
            state["matcher"] = Matcher(shared.value)
        found = [(-1, len(texts))]
        for known, counted in ((state["matcher"].whole, runs), (state["matcher"].beginning, beginnings)):
            found += [(known[t], n) for t, n in counted.items() if t in known]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["term", "df"])

    state: dict = {}
    df = np.zeros(len(vocabulary) + 1)
    counted = map_batches(docs.select("text"), "term long, df long", frequencies).groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    rows_with = [np.bincount(place, y[example] == c, len(vocabulary)) for c in (1, 0)]
    by_term = np.argsort(place, kind="stable")
    postings = tuple(x[by_term] for x in (place, example, counts))
    return Index(vocabulary, idf, *rows_with, rows.column("doc_id").to_numpy(), y, rows.column("weight").to_numpy(), boost, postings), sample


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, boost: float = 10.0, k: int = 15, smoothing: float = 0.1, threshold: float = 0.7, seed: int = 3, carry: str | None = None
) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the nearest examples),
    and the column ``carry`` of ``docs`` if one is named."""
    slim = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    extra = [carry] if carry else []
    index, sample = fit_index(slim, labels, sample_rows, boost, seed)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    state: dict = {}  # of a task: the closure is unpickled there

    def opened() -> tuple[Index, Matcher]:
        if not state:
            state["index"] = shared.value.open()
            state["matcher"] = Matcher(state["index"].vocabulary)
        return state["index"], state["matcher"]

    def own_votes(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Votes on the examples, each searched without itself."""
        index, matcher = opened()
        place = {i: p for p, i in enumerate(index.ids.tolist())}
        votes, rows = [], list(zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), utf8(batch.column("text"))))
        for i in range(0, len(rows), RUN):
            texts = []
            for _, y, text in rows[i:i + RUN]:
                terms, counts = matcher(text)
                texts.append((terms, index.vector(terms, counts, y)))
            votes += [index.vote(*found, smoothing) for found in index.nearest(texts, k, [place[r[0]] for r in rows[i:i + RUN]])]
        return pa.RecordBatch.from_arrays([batch.column("y"), batch.column("weight"), pa.array(votes, pa.float64())], names=["y", "weight", "vote"])

    known = map_batches(sample, "y int, weight double, vote double", own_votes).toArrow()  # 2 * sample_rows rows at most
    slope, offset = fit_calibration(*(known.column(c).to_numpy() for c in ("vote", "y", "weight")))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, matcher = opened()
        scores, evidence = [], []
        whole = utf8(batch.column("text"))
        for i in range(0, len(whole), RUN):
            texts = []
            for text in whole[i:i + RUN]:
                terms, counts = matcher(text)
                texts.append((terms, index.vector(terms, counts)))
            for at, cosine in index.nearest(texts, k):
                vote = index.vote(at, cosine, smoothing)
                scores.append(float(1 / (1 + np.exp(-slope * log_odds(np.array(vote)) - offset))) if len(at) else index.prior)
                evidence.append(index.ids[at[:3]].tolist())
        columns = [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, *map(batch.column, extra)], names=["doc_id", "score", "evidence", *extra])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)
    schema = "doc_id long, score double, evidence array<long>" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    scored = map_batches(whole, schema, work)
    held_out = ~F.coalesce(in_training(F.col("doc_id")), F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", *extra)
