"""Registered queries for scalar functions and ordering operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftkit.functions.names import sanitize_name_col
from driftkit.functions.scalar import clip, log_positive, missing_flag, score_or_neg_inf, sqrt_abs
from driftkit.operators import splits
from driftkit.plans.catalog import register, rounded
from driftkit.sources.tables import read_table

# F1 twin: the same rule written in DuckDB's regexp_replace ('g' = all matches).
_SAN = """coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({c}),
    '[\\s/\\-]+', '_', 'g'), '[()]+', '', 'g'), '[^0-9A-Za-z_]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unnamed')"""


@register("f1_f2_sanitised_names", f"""SELECT p_partkey, {_SAN.format(c="p_name")} AS name_clean,
  {_SAN.format(c="p_type || ' (' || p_brand || ')'")} AS type_clean,
  regexp_matches(p_type, '^(STANDARD|SMALL)') AS is_standard_or_small
FROM part""")
def q_names(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return p.select("p_partkey", sanitize_name_col("p_name").alias("name_clean"),
                    sanitize_name_col(F.concat(F.col("p_type"), F.lit(" ("), F.col("p_brand"), F.lit(")"))).alias("type_clean"),
                    F.col("p_type").rlike("^(STANDARD|SMALL)").alias("is_standard_or_small"))


@register("f9_f11_math_and_flags", """SELECT o_orderkey,
  rnd(CASE WHEN o_totalprice > 0 THEN ln(o_totalprice) END) AS log_price,
  rnd(sqrt(abs(o_totalprice - 100000.0))) AS sqrt_abs_dev,
  rnd(least(greatest(o_totalprice, 1000.0), 300000.0)) AS clipped,
  CAST(o_orderpriority IS NULL AS INTEGER) AS priority_missing,
  rnd(CASE WHEN o_totalprice IS NULL OR isnan(o_totalprice) THEN -'inf'::DOUBLE ELSE o_totalprice END) AS score
FROM orders""")
def q_math(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return rounded(o.select("o_orderkey", log_positive("o_totalprice").alias("log_price"),
                            sqrt_abs(F.col("o_totalprice") - 100000.0).alias("sqrt_abs_dev"),
                            clip("o_totalprice", 1000.0, 300000.0).alias("clipped"),
                            missing_flag("o_orderpriority").alias("priority_missing"),
                            score_or_neg_inf("o_totalprice").alias("score")))


@register("t2_t3_top15_by_abs", """SELECT c_custkey, rnd(c_acctbal) AS c_acctbal FROM customer
ORDER BY abs(c_acctbal) DESC NULLS LAST, c_custkey LIMIT 15""")
def q_topk(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rounded(splits.top_k(c, "c_acctbal", 15, by_abs=True, ties=["c_custkey"]))


@register("t4_head_in_time_order", """SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders
ORDER BY o_orderdate, o_orderkey LIMIT 100""")
def q_head(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return splits.head_in_time_order(o, ["o_orderdate", "o_orderkey"], 100)


@register("t5_seeded_sample", """SELECT o_orderkey, rnd(o_totalprice) AS o_totalprice FROM orders
ORDER BY md5(concat_ws(':', '42', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 1000""")
def q_sample(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rounded(splits.deterministic_sample(o, 1000, ["o_orderkey"], seed=42))


@register("u2_union_by_name", """SELECT 'open' AS part, o_orderkey, o_totalprice, NULL::VARCHAR AS o_orderpriority FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'finished' AS part, o_orderkey, NULL::DOUBLE AS o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F'""")
def q_union(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    a = o.filter(F.col("o_orderstatus") == "O").select(F.lit("open").alias("part"), "o_orderkey", "o_totalprice")
    b = o.filter(F.col("o_orderstatus") == "F").select(F.lit("finished").alias("part"), "o_orderkey", "o_orderpriority")
    return a.unionByName(b, allowMissingColumns=True)


@register("u3_distinct_pairs", """SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem""")
def q_distinct(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber").distinct()
