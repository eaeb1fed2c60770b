"""A study derived from the relational tables: customers are samples, brands are variants.

``dosage`` is the number of a brand's line items that a customer bought, modulo 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, sample_idx): customer keys are dense and serve as index."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_custkey").alias("sample_idx"))


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, n_orders, nation, month): month is null for customers without orders."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(F.count("*").cast("double").alias("n"), F.avg(F.month("o_orderdate").cast("double")).alias("month"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").cast("double").alias("nation"))
    return c.join(o, "sample_id", "left").select("sample_id", F.coalesce("n", F.lit(0.0)).alias("n_orders"), "nation", "month")


def phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, pheno, y): balance (missing for every 17th), spend (missing without orders) and a binary trait."""
    spend = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample_id")).agg((F.sum("o_totalprice") / 1000).alias("spend"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_acctbal").alias("b")).join(spend, "sample_id", "left")
    traits = F.explode(
        F.array(
            F.struct(F.lit("balance").alias("pheno"), F.when(F.col("sample_id") % 17 != 0, F.col("b")).alias("y")),
            F.struct(F.lit("positive").alias("pheno"), (F.col("b") > 4000).cast("double").alias("y")),
            F.struct(F.lit("spend").alias("pheno"), F.col("spend").alias("y")),
        )
    )
    return c.select("sample_id", traits.alias("p")).select("sample_id", "p.pheno", "p.y")


def bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant_id, sample_id, n): line items by brand and customer, where there are any."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return joined.groupBy(F.col("p_brand").alias("variant_id"), F.col("o_custkey").alias("sample_id")).agg(F.count("*").alias("n"))


def dosages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant_id, sample_id, sample_idx, dosage) of every brand and customer.

    Each customer's row is expanded by the list of brands, one value of bounded size.
    """
    brands = table(spark, sf_dir, "part").agg(F.sort_array(F.collect_set("p_brand")).alias("brands"))
    grid = samples(spark, sf_dir).join(F.broadcast(brands)).select(F.explode("brands").alias("variant_id"), "sample_id", "sample_idx")
    return grid.join(bought(spark, sf_dir), ["variant_id", "sample_id"], "left").select("variant_id", "sample_id", "sample_idx", (F.coalesce("n", F.lit(0)) % 3).cast("double").alias("dosage"))


def kinship_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_idx, id1, id2, value): families of four customers, each pair listed in both orders and with itself."""
    s = samples(spark, sf_dir).select(F.col("sample_id").alias("id1"))
    e = s.select("id1", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("k")).select("id1", (F.floor(F.col("id1") / 4) * 4 + F.col("k")).cast("long").alias("id2"))
    e = e.join(samples(spark, sf_dir).select(F.col("sample_id").alias("id2")), "id2", "left_semi").filter("id1 <> id2")
    return e.select((F.col("id1") * 1000000 + F.col("id2")).alias("edge_idx"), "id1", "id2", F.lit(0.5).alias("value"))


#: The same views for the SQL check.
SQL_VIEWS = """
cov AS (SELECT c_custkey AS sample_id, coalesce(n, 0)::DOUBLE AS n_orders, c_nationkey::DOUBLE AS nation, m AS month FROM customer
  LEFT JOIN (SELECT o_custkey, count(*) AS n, avg(month(o_orderdate)::DOUBLE) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey),
phe AS (SELECT c_custkey AS sample_id, 'balance' AS pheno, CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal END AS y FROM customer
  UNION ALL SELECT c_custkey, 'positive', CASE WHEN c_acctbal > 4000 THEN 1.0::DOUBLE ELSE 0.0 END FROM customer
  UNION ALL SELECT c_custkey, 'spend', s FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) / 1000 AS s FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey),
buy AS (SELECT p_brand AS variant_id, o_custkey AS sample_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY p_brand, o_custkey),
dos AS (SELECT b.variant_id, c_custkey AS sample_id, (coalesce(n, 0) % 3)::DOUBLE AS dosage FROM customer CROSS JOIN (SELECT DISTINCT p_brand AS variant_id FROM part) b
  LEFT JOIN buy ON buy.variant_id = b.variant_id AND buy.sample_id = c_custkey),
edge AS (SELECT id1 * 1000000 + id2 AS edge_idx, id1, id2, 0.5::DOUBLE AS value FROM (SELECT a.c_custkey AS id1, b.c_custkey AS id2 FROM customer a JOIN customer b ON a.c_custkey // 4 = b.c_custkey // 4 WHERE a.c_custkey <> b.c_custkey))
"""
