"""Quality classifier: hashed word n-gram logistic regression, FTRL-proximal.

Features of a text: its words, their shapes (runs of lower-case, upper-case,
digits and other characters), the bigrams of both, and "same word again", hashed
to ``2 ** bits`` coordinates; the value is the feature's share of the text's
features.  Training is follow-the-regularised-leader, one row at a time, over a
bounded sample of labelled rows (``sample_rows``, a parameter) in a seeded order
in one task; the model is one weight vector.  Scoring is a sparse dot product over
every whole text.

Defined cases: NULL, empty and wordless texts have no features and score by the
intercept alone; repeated rows score alike; without labelled rows every score is
0.5; empty table: no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkit.llm.common import Memo, in_training, labelled_sample, map_batches, utf8

SAMPLE_ROWS = 8000
BITS = 18
SCALE = 8.0
SHAPES = [(re.compile(r"[^\W\d_]+"), lambda m: "X" if m.group().isupper() and len(m.group()) > 1 else "Xx" if m.group()[0].isupper() else "x"), (re.compile(r"\d+"), lambda m: "0"), (re.compile(r"([^\w\s])\1+"), lambda m: m.group(1) * 2)]


def word_codes(word: bytes) -> bytes:
    """Two 32-bit hashes of a word: of itself (lower-cased) and of its shape."""
    text = word.decode("utf-8", "replace")
    shape = text
    for pattern, by in SHAPES:
        shape = pattern.sub(by, shape)
    return xxhash.xxh32_digest(text.lower().encode(), 1)[::-1] + xxhash.xxh32_digest(shape.encode(), 2)[::-1]


def feature_codes(text: bytes | None, memo: Memo, bits: int) -> np.ndarray:
    """Hashed coordinates of all n-grams, repeats included."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(b"".join(map(memo.__getitem__, words)), "<u4").reshape(-1, 2).astype(np.uint64)
    pairs = (codes[:-1] * np.uint64(0x9E3779B1) + codes[1:] * np.uint64(0x85EBCA77) + np.uint64(7)) >> np.uint64(9)
    again = np.full(int((codes[1:, 0] == codes[:-1, 0]).sum()), 11, np.uint64)
    return (np.concatenate([codes.ravel(), pairs.ravel(), again]) & np.uint64((1 << bits) - 1)).astype(np.int64)


class Ftrl:
    """FTRL-proximal for logistic loss; coordinate 2 ** bits is the intercept."""

    def __init__(self, bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.001, l2: float = 0.01):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def features(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(codes, return_counts=True)
    return np.append(at, 1 << bits), np.append(SCALE * count / max(1, len(codes)), 1.0)


def fit_weights(docs: DataFrame, labels: DataFrame, sample_rows: int, bits: int, epochs: int, seed: int) -> np.ndarray:
    picked = labelled_sample(labels, "quality", {0: sample_rows // 2, 1: sample_rows // 2}, seed)
    sample = docs.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo, ats, xs = Memo(word_codes), [], []
        for text in utf8(batch.column("text")):
            at, x = features(feature_codes(text, memo, bits), bits)
            ats.append(at.astype(np.int32).tobytes())
            xs.append(x.astype(np.float32).tobytes())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(ats, pa.binary()), pa.array(xs, pa.binary())], names=["doc_id", "y", "at", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows = [(np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(x.as_buffer(), np.float32).astype(float), y.as_py()) for b in batches for a, x, y in zip(b.column("at"), b.column("x"), b.column("y"))]
        model, rng = Ftrl(bits), np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                model.learn(*rows[i])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights(slice(None)).astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    # bounded by sample_rows: one task learns, in an order fixed by the seed
    ready = map_batches(sample.select("doc_id", "text", "y"), "doc_id long, y int, at binary, x binary", work)
    lined = ready.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").select("at", "x", "y")
    made = lined.mapInArrow(train, "weights binary").first()  # None: no labelled rows, no task
    return np.frombuffer(made.weights, np.float32).astype(float) if made else np.zeros((1 << bits) + 1)


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, bits: int = BITS, epochs: int = 3, threshold: float = 0.5, seed: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    slim = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    weights = fit_weights(slim, labels, sample_rows, bits, epochs, seed)
    memos: list[Memo] = []  # one per task: the closure is unpickled there

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not memos:
            memos.append(Memo(word_codes))
        out = np.empty(batch.num_rows)
        for i, text in enumerate(utf8(batch.column("text"))):
            codes = feature_codes(text, memos[0], bits)
            dot = weights[-1] + (SCALE * weights[codes].mean() if len(codes) else 0.0)
            out[i] = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    scored = map_batches(slim, "doc_id long, score double", work)
    held_out = ~F.coalesce(in_training(F.col("doc_id")), F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
