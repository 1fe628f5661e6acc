"""Small helpers shared by the text and vector operators.

Words everywhere are maximal runs of bytes outside space and ``\\t..\\r``
(``[^\\x20\\x09-\\x0D]+``), which is exactly ``bytes.split()`` on UTF-8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkit.session import ensure_checkpoint_dir

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder: cuts lineage and lets
    several consumers read one result without computing it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def word_count(text: Column) -> Column:
    """Number of words (NULL text: 0), JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def seeded_key(seed: int, ident: Column) -> Column:
    """60 uniform bits of md5(seed:id) as a non-negative long; plain SQL can restate it."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


KEY_RANGE = float(1 << 60)


def utf8(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding."""
    return column.cast(pa.binary()).to_pylist()


def slices(texts: list[bytes | None], size: int) -> Iterator[list[bytes | None]]:
    """Runs of texts of about ``size`` bytes, so that working memory stays bounded."""
    held, used = [], 0
    for text in texts:
        held.append(text)
        used += len(text or b"")
        if used >= size:
            yield held
            held, used = [], 0
    if held:
        yield held


def map_batches(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """``mapInArrow`` with a function of one batch; None drops the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def in_training(ident: Column) -> Column:
    """Rows that a classifier may learn from: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(ident.cast("string").cast("binary")) % 3 != 1


def labelled_sample(labels: DataFrame, label: str, rows: dict[int, int], seed: int) -> DataFrame:
    """(doc_id, y, weight): per class at most ``rows[class]`` training rows, those with
    the smallest seeded hash of the id; ``weight`` restores the class sizes.  An id
    that is labelled more than once counts once, with its largest label."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    known = stored(known.where(in_training(F.col("doc_id"))))
    sizes = dict(known.groupBy("y").count().collect()) if rows else {}
    picked = None
    for y, most in rows.items():
        part = known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)
        part = part.withColumn("weight", F.lit(max(1.0, sizes.get(y, 0) / most)))
        picked = part if picked is None else picked.unionByName(part)
    return picked


def join_copies(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int, least: int = 2_000) -> DataFrame:
    """Join ``rows`` to their class (one row each, ``size`` rows of ``rows`` in it) by ``key``.

    A class of more than total / 10,000 rows (``least`` at least) is dealt over as many
    salts as it has such portions; at most 10,000 classes are that large, a proven
    bound for the broadcast.  Rows of smaller classes meet in one shuffle, unsalted."""
    portion = max(least, total // 10_000)
    salts = F.ceil(F.col(size) / portion).cast("int")
    large = classes.where(F.col(size) > portion).select(key, salts.alias("_salts"))
    dealt = rows.join(F.broadcast(large), key, "left")
    dealt = dealt.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    held = classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return dealt.join(held, [key, "_salt"]).drop("_salt")


class Memo(dict):
    """Bounded cache: computes what is missing, starts anew when full."""

    def __init__(self, compute: Callable, limit: int = 150_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value
