"""The operators as registered queries over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkit.llm.ann import approximate_neighbours
from driftkit.llm.common import table
from driftkit.llm.embed_dedup import near_vectors
from driftkit.llm.merkle import merkle_manifest
from driftkit.llm.mixing import BLOCKS, EPOCHS, NEAR, SHARDS, mix_sources
from driftkit.llm.packing import pack_documents
from driftkit.llm.quality import quality_scores
from driftkit.llm.sharding import interleaved_shards
from driftkit.llm.simhash import near_duplicates
from driftkit.llm.spelling import spelling_variants
from driftkit.llm.substring import deduplicated
from driftkit.llm.topk import exact_top_k
from driftkit.llm.toxicity import toxicity_scores
from driftkit.llm.wordpiece import token_counts


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file (installed beside the cluster's Python)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(table(spark, sf_dir, "documents"), shards=8).drop("source")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("shard_words").cast("array<string>"), ",").alias("shard_words"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), window=13, with_text=False)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate_neighbours(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), min_length=6, min_count=5, ratio=5, slip=199)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle_manifest(table(spark, sf_dir, "documents"), altered={"n_chars": F.col("n_chars") + 1}, where=tampered).drop("path")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_sharding, op2_exact_top_k, op3_mixing, op4_token_counts, op5_simhash, op6_toxicity, op7_quality, op8_substring_dedup, op9_neighbours, op10_packing, op11_embedding_near_dedup, op12_spelling, op13_merkle)
    return {f.__name__: f for f in made}


def _key(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT"


CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""


def _crc(text: str) -> str:
    """Unsigned crc32 of a non-NULL string; ``t`` is the table above."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda acc, b: xor(acc >> 8, t[CAST(xor(acc, b) & 255 AS BIGINT) + 1])), 4294967295)"""


SHARDING_SQL = f"""
WITH {CRC_TABLE}, d AS (
  SELECT doc_id, source, coalesce(source, '') AS s, source IS NULL AS no_source, coalesce(strlen(text), 0) + 1 AS size, {_key(17)} AS key,
    {_crc("coalesce(text, '')")} AS text_crc32
  FROM documents, crc_table
), r AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY no_source, s ORDER BY key, doc_id) - 1) + 1) / (2.0::DOUBLE * count(*) OVER (PARTITION BY no_source, s)) AS frac FROM d
), p AS (
  SELECT *, row_number() OVER (ORDER BY frac, key, doc_id) - 1 AS spot, count(*) OVER () // 8 AS base, count(*) OVER () % 8 AS more FROM r
), q AS (
  SELECT *, CASE WHEN spot < more * (base + 1) THEN spot // (base + 1) ELSE more + (spot - more * (base + 1)) // greatest(base, 1) END AS shard FROM p
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(spot - CASE WHEN shard < more THEN shard * (base + 1) ELSE more * (base + 1) + (shard - more) * base END AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM q
"""

TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""

MIXING_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS no_source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, {_key(29)} AS key FROM documents
), src AS (
  SELECT no_source, s, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL
), w AS (
  SELECT *, row_number() OVER (ORDER BY no_source, encode(s)) AS place, CAST(sum(source_size) OVER () AS BIGINT) AS total, count(*) OVER () AS n FROM src
), c AS (
  SELECT *, (place - 1) % 3 + 1 AS weight, {EPOCHS} * source_size AS cap FROM w
), l AS (
  SELECT *, row_number() OVER o AS pos,
    CAST(total - coalesce(sum(cap) OVER (ORDER BY cap / CAST(weight AS DOUBLE), place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY cap / CAST(weight AS DOUBLE), place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM c WINDOW o AS (ORDER BY cap / CAST(weight AS DOUBLE), place)
), f AS (
  SELECT *, min(CASE WHEN cap > weight * level THEN pos END) OVER () AS first_open FROM l
), t AS (
  SELECT *, CASE WHEN pos >= first_open THEN weight * (SELECT level FROM f WHERE pos = first_open) ELSE CAST(cap AS DOUBLE) END AS target FROM f
), b AS (
  SELECT *, greatest(1, least(total // {BLOCKS}, CAST(floor(min(target) OVER () / {NEAR}) AS BIGINT))) AS block, count(*) OVER () AS sources FROM t WHERE target > 0
), h AS (
  SELECT *, unnest(range(1, {SHARDS} + 1)) AS k FROM b
), r AS (
  SELECT *, (total // block * k) // {SHARDS} AS house FROM h
), m AS (
  SELECT *, CAST(greatest(floor(target / total * (house - sources / 2.0) + 0.5) - 1, 0) AS BIGINT) AS sure FROM r
), listed AS (
  SELECT *, unnest(range(sure, CAST(ceil(target / total * (house + sources / 2.0) + 0.5) AS BIGINT) + 2)) AS seat,
    house - sum(sure) OVER (PARTITION BY k) AS open_seats FROM m
), won AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY target / (2 * seat + 1) DESC, place, seat) <= open_seats AS wins FROM listed
), seats AS (
  SELECT no_source, s, k, min(block) * (min(sure) + count(*) FILTER (WHERE wins)) AS words FROM won GROUP BY ALL
), quota AS (
  SELECT no_source, s, source_size, target, list(CAST(least(coalesce(words, 0), {EPOCHS} * source_size) AS BIGINT) ORDER BY k) AS ends
  FROM t LEFT JOIN seats USING (no_source, s) GROUP BY ALL
), line AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY no_source, s ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d
), took AS (
  SELECT *, list_transform(ends, lambda e: CASE WHEN source_size > 0 THEN e // source_size * size + greatest(least(e % source_size - start, size), 0) ELSE 0 END) AS upto
  FROM line JOIN quota USING (no_source, s)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(upto[-1] AS BIGINT) AS taken,
  array_to_string(list_transform(range(1, {SHARDS} + 1), lambda k: CAST(CAST(coalesce(upto[k], 0) - CASE WHEN k > 1 THEN coalesce(upto[k - 1], 0) ELSE 0 END AS BIGINT) AS VARCHAR)), ',') AS shard_words
FROM took
"""

SUBSTRING_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents
), p AS (
  SELECT row_id, doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d
), w AS (
  SELECT row_id, doc_id, i, words[i] AS word, CASE WHEN i + 12 <= len(words) THEN array_to_string(words[i:i + 12], ' ') END AS win FROM p
), f AS (
  SELECT *, win IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY win) AS hit FROM w
), c AS (
  SELECT *, coalesce(bool_or(hit) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone FROM f
), g AS (
  SELECT row_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY row_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (row_id)
"""


NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
    coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS ok
  FROM embeddings
), u AS (
  SELECT r, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE ok
), links AS (
  SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) AND CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) / (a.norm * b.norm) END >= 0.95
), reach AS (
  SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), c AS (
  SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON v.r = b GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = v.r) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c ON c.a = v.r
"""

SPELLING_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run
  FROM documents
), counted AS (
  SELECT id, run, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, n, {_crc("id || ':' || run")} AS h FROM counted, crc_table
), slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), del AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)
), near AS (
  SELECT a.word, b.word AS other FROM del a JOIN del b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT del.word, w.word FROM del JOIN w ON del.v = w.word
  UNION SELECT w.word, del.word FROM del JOIN w ON del.v = w.word
), ranked AS (
  SELECT near.word, other, w.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS place
  FROM near JOIN w ON w.word = other
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM w LEFT JOIN ranked ON ranked.word = w.word AND place = 1
), follow AS (
  SELECT word, word AS at FROM f UNION ALL SELECT follow.word, f.form FROM follow JOIN f ON f.word = follow.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, follow.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN follow ON follow.word = f.word JOIN f last ON last.word = follow.at AND last.form IS NULL
"""


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen(CAST({f} AS VARCHAR)) || ':' || {f} END" for f in fields) + ")"


STEP_SQL = "CASE WHEN sib.h IS NULL THEN '=' WHEN sib.pos < me.pos THEN 'L' || sib.h ELSE 'R' || sib.h END"

MERKLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, d AS (
  SELECT doc_id, lang IS NULL AS none, coalesce(lang, '') AS g, {_leaf("n_chars")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_crc("coalesce(CAST(doc_id AS VARCHAR), '')")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS other
  FROM documents, crc_table
), s AS (
  SELECT *, row_number() OVER (PARTITION BY none, g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY none, g) AS n FROM d
), tree AS (
  SELECT none, g, 0 AS lvl, pos, leaf AS h, n FROM s
  UNION ALL SELECT none, g, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY none, g, lvl, pos // 2, n
), sub AS (
  SELECT none, g, h AS subroot, row_number() OVER (ORDER BY none DESC, encode(g)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM sub
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n
), low AS (
  SELECT s.none, s.g, s.pos, list({STEP_SQL} ORDER BY me.lvl) AS steps
  FROM s JOIN tree me ON me.none = s.none AND me.g = s.g AND me.n > 1 AND me.pos = s.pos >> me.lvl
  LEFT JOIN tree sib ON sib.none = me.none AND sib.g = me.g AND sib.lvl = me.lvl AND sib.pos = xor(me.pos, 1) GROUP BY ALL
), high AS (
  SELECT sub.pos, list({STEP_SQL} ORDER BY me.lvl) AS steps
  FROM sub JOIN top me ON me.n > 1 AND me.pos = sub.pos >> me.lvl LEFT JOIN top sib ON sib.lvl = me.lvl AND sib.pos = xor(me.pos, 1) GROUP BY ALL
), p AS (
  SELECT s.doc_id, s.leaf, s.other, sub.subroot, (SELECT h FROM top WHERE n = 1) AS root, list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
  FROM s JOIN sub ON sub.none = s.none AND sub.g = s.g LEFT JOIN low ON low.none = s.none AND low.g = s.g AND low.pos = s.pos LEFT JOIN high ON high.pos = sub.pos
), q AS (
  SELECT *, coalesce(array_to_string(list_transform(list_filter(steps, lambda x: x <> '='), lambda x: x[2:]), ''), '') AS siblings,
    list_reduce(list_prepend(coalesce(other, leaf), steps), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)) AS folded_root
  FROM p
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified FROM q
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": SHARDING_SQL, "op2_exact_top_k": TOP_K_SQL, "op3_mixing": MIXING_SQL, "op8_substring_dedup": SUBSTRING_SQL,
        "op11_embedding_near_dedup": NEAR_VECTORS_SQL, "op12_spelling": SPELLING_SQL, "op13_merkle": MERKLE_SQL,
    }
