"""Mixing sources to target weights: Sainte-Lague block quotas (DataFrame only).

1. Targets: sources in code-point order (NULL last) weigh 1, 2, 3, 1, ... and
   share the total words; a target stops at ``epochs`` times its source's size
   and the excess is shared again by weight.  The fixed point is a water level:
   with sources sorted by (cap / weight) the capped ones are a prefix, found with
   two running sums.
2. Seats: the mix is cut into equal-token blocks, at least ``blocks`` of them and
   so small that the least target holds ``NEAR``.  Block j of a source has the
   quotient target / (2 j + 1); the highest quotients win, whatever the source's
   size.  The first H awards are the seats of a mix of H blocks, so the awards are
   dealt to ``shards`` in equal runs by the seats at each run's end: integer quotas
   per shard and source.  Of a source's seats only those near the margin are listed
   (the others are won by every house of that size): a few rows per source and
   shard, however many blocks there are.
3. Selection: the documents of a source stand in seeded order on a line of words
   that is cut into the same blocks; the shards take the source's blocks one after
   the other by their quotas, going round again for repeats.  A document takes the
   words of its span: whole rounds plus the overlap with the last, partial round.

Sources are names: the table of sources (a row each) is sorted in one task, so it
must stay within some million rows.

Defined cases: NULL text has size 0 and takes 0; documents without words take 0;
a source of size 0 has target 0; NULL source is a source of its own, last in
order; repeated rows are separate documents; a table without words gives
targets of 0; empty table: no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftkit.llm.common import KEY_RANGE, WORD_PATTERN, seeded_key, stored, word_count
from driftkit.llm.ordering import bucket_count, prefix_before

WEIGHTS = (1, 2, 3)
BLOCKS = 65_536
EPOCHS = 3
NEAR = 128  # blocks that the least target holds (a block has a word at least)
SHARDS = 8


def source_targets(sizes: DataFrame, epochs: int = EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """(no_source, source, source_size) -> + weight, total, target, place.  One row
    per source throughout."""
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy("no_source", F.col("source").cast("binary")))
    w = sizes.withColumn("place", place.cast("long"))
    weight = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    w = w.withColumns({"weight": weight.cast("long"), "cap": F.lit(int(epochs)) * F.col("source_size")})
    w = w.withColumn("total", F.sum("source_size").over(everything))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumns({
        "pos": F.row_number().over(by_ratio),
        "level": (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward),
    })
    # the first source (by ratio) that its level does not fill sets the water level
    open_pos = F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("pos"))
    w = w.withColumn("first", F.min(open_pos).over(everything))
    w = w.withColumn("water", F.min(F.when(F.col("pos") == F.col("first"), F.col("level"))).over(everything))
    target = F.when(F.col("pos") >= F.col("first"), F.col("weight") * F.col("water")).otherwise(F.col("cap").cast("double"))
    return w.withColumn("target", target).drop("cap", "pos", "level", "first", "water")


def block_quotas(targets: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """Sainte-Lague seats: (no_source, source, block, seats), ``block`` the words of a
    block and ``seats[k]`` the source's seats in the shards 0 to k."""
    everything = Window.partitionBy()
    open_ = targets.where("target > 0").select(
        "*", F.count(F.lit(1)).over(everything).alias("sources"), F.min("target").over(everything).alias("least")
    )
    words = F.least(F.floor(F.col("total") / blocks), F.floor(F.col("least") / NEAR))
    cut = open_.withColumn("block", F.greatest(words, F.lit(1)).cast("long"))
    runs = cut.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(int(shards)))))
    runs = runs.withColumn("house", F.expr(f"(total DIV block * shard) DIV {int(shards)}"))
    share = F.col("target") / F.col("total")
    sure = F.greatest(F.floor(share * (F.col("house") - F.col("sources") / 2) + 0.5) - 1, F.lit(0)).cast("long")
    most = (F.ceil(share * (F.col("house") + F.col("sources") / 2) + 0.5) + 1).cast("long")
    by_house = Window.partitionBy("shard")
    runs = runs.withColumns({"sure": sure, "most": most}).withColumn("left", F.col("house") - F.sum("sure").over(by_house))
    listed = runs.withColumn("seat", F.explode(F.sequence("sure", "most")))
    award = F.row_number().over(by_house.orderBy((F.col("target") / (2 * F.col("seat") + 1)).desc(), "place", "seat"))
    won = listed.withColumn("won", (award <= F.col("left")).cast("long"))
    per = won.groupBy("no_source", "source", "block", "shard").agg((F.min("sure") + F.sum("won")).alias("n"))
    dealt = per.groupBy("no_source", "source", "block").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("runs"))
    return dealt.select("no_source", "source", "block", F.col("runs.n").alias("seats"))


def mix_sources(docs: DataFrame, blocks: int = BLOCKS, epochs: int = EPOCHS, weights: tuple = WEIGHTS, seed: int = 29, shards: int = SHARDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and shard_words (the words each
    shard takes, summing to ``taken``) for every row of ``docs``."""
    return _mixed(stored(_sized(docs, seed)), ["doc_id", "size"], blocks, epochs, weights, shards)


def _sized(docs: DataFrame, seed: int, *keep: str) -> DataFrame:
    return docs.select(
        *keep,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.col("source").isNull().alias("no_source"),
        word_count(F.col("text")).alias("size"),
        seeded_key(seed, F.col("doc_id")).alias("key"),
    )


def _mixed(slim: DataFrame, tie: list[str], blocks: int, epochs: int, weights: tuple, shards: int) -> DataFrame:
    sizes = slim.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, epochs, weights)
    seats = block_quotas(targets, blocks, shards)
    ends = F.transform("seats", lambda n: F.least(n * F.col("block"), F.col("source_size") * epochs))
    none = F.array_repeat(F.lit(0).cast("long"), shards)
    quota = targets.join(seats, ["no_source", "source"], "left").select(
        "no_source", "source", "source_size", "target", F.coalesce(ends, none).alias("ends")
    )
    line = prefix_before(slim, ["no_source", "source"], F.col("key") / KEY_RANGE, [F.col("key"), *map(F.col, tie)], {"w": F.col("size")}, bucket_count(slim.count()))
    # a few rows per source: joined on the source by whichever way the runtime sizes allow
    both = line.join(quota, ["no_source", "source"])
    whole, rest = "end DIV source_size * size", "greatest(least(end % source_size - w_before, size), 0L)"
    upto = F.expr(f"transform(ends, end -> CASE WHEN source_size > 0 THEN {whole} + {rest} ELSE 0L END)")
    both = both.withColumn("upto", upto)
    return both.select(
        *[c for c in slim.columns if c not in ("no_source", "key")],
        "no_source",
        "source_size",
        "target",
        F.element_at("upto", -1).cast("long").alias("taken"),
        F.expr("transform(upto, (x, k) -> x - CASE WHEN k > 0 THEN upto[k - 1] ELSE 0L END)").alias("shard_words"),
    ).withColumn("source", F.when(~F.col("no_source"), F.col("source"))).drop("no_source")


def mixed_documents(docs: DataFrame, blocks: int = BLOCKS, epochs: int = EPOCHS, weights: tuple = WEIGHTS, seed: int = 29, shards: int = SHARDS) -> DataFrame:
    """``docs`` as the mix reads them, same columns: a document is repeated for each
    whole round and, for a partial round, once more with the first words of its
    span (joined by one space; ``n_chars``, if present, follows the text).  Rows are
    numbered and written once, so each row takes its own span, whatever its id."""
    numbered = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.monotonically_increasing_id().alias("_row")))
    fields = numbered.select("_row", *[F.col(f"whole.`{c}`").alias(c) for c in ("doc_id", "source", "text")])
    read = _mixed(stored(_sized(fields, seed, "_row")), ["doc_id", "size", "_row"], blocks, epochs, weights, shards)
    both = numbered.join(read.where("taken > 0").select("_row", "size", "taken"), "_row")
    copies = F.expr("CASE WHEN size > 0 THEN taken DIV size ELSE 0L END").cast("int")
    rest = F.expr("CASE WHEN size > 0 THEN taken % size ELSE 0L END").cast("int")
    takes = F.concat(F.array_repeat(F.lit(0), copies), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = both.select("whole", F.explode(takes).alias("_first"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("whole.text"), F.lit(WORD_PATTERN), F.lit(0)), F.lit(1), F.col("_first")), " ")
    out = rows.select(*[F.col(f"whole.`{c}`").alias(c) for c in docs.columns if c != "text"], F.when(F.col("_first") > 0, cut).otherwise(F.col("whole.text")).alias("text"), "_first")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_first") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])
