"""Sharding by proportional stratified interleaving (law ``rows``).

Rows of each source are put in a seeded shuffle; the row at rank r (from 0) of a
source with n rows gets the fractional rank (r + 1/2) / n.  Sorting all rows by
fractional rank interleaves the sources in proportion, so a cut into equal runs
gives every shard the mixture of the whole table, with row counts at most one
apart.  Both sorts run over uniform buckets (``ordering``): a hot source is
spread over all tasks and only the slim columns are shuffled.

Defined cases: NULL source is a source of its own; NULL text has size 1 and
CRC 0, like an empty text; repeated rows are separate rows (ties are broken by
doc_id, source, size and CRC, so equal rows are interchangeable); equal texts
are not kept together, since the law is on rows; an empty table gives no rows;
other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkit.llm.common import KEY_RANGE, seeded_key, stored
from driftkit.llm.ordering import bucket_count, prefix_before


def interleaved_shards(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard."""
    body = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.col("source").isNull().alias("no_source"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        seeded_key(seed, F.col("doc_id")).alias("key"),
    )
    slim = stored(slim)
    total = slim.count()
    buckets = bucket_count(total)
    tie = [F.col(c) for c in ("key", "doc_id", "no_source", "source", "size", "text_crc32")]
    ranked = prefix_before(slim, ["no_source", "source"], F.col("key") / KEY_RANGE, tie, {"n": F.lit(1).cast("long")}, buckets)
    mixed = ranked.select(*slim.columns, ((2 * F.col("n_before") + 1) / (2 * F.col("n_total"))).alias("frac"))
    placed = prefix_before(mixed, [], F.col("frac"), [F.col("frac"), *tie], {"n": F.lit(1).cast("long")}, buckets)
    base, more = divmod(total, shards)
    at, wide = F.col("n_before"), more * (base + 1)  # the first `more` shards have one row more
    shard = F.when(at < wide, F.floor(at / (base + 1))).otherwise(more + F.floor((at - wide) / max(base, 1))).cast("int")
    start = F.when(F.col("shard") < more, F.col("shard") * F.lit(base + 1).cast("long")).otherwise(wide + (F.col("shard") - more) * F.lit(base).cast("long"))
    return placed.withColumn("shard", shard).select(
        "doc_id",
        F.when(~F.col("no_source"), F.col("source")).alias("source"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (at - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
