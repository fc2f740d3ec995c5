"""A catalog, seller entries and links derived from the driver's tables.

``part`` plays the catalog and ``lineitem`` the entries that sellers send for it, with the faults that
real ones have: malformed ids, missing and injected brands, foreign categories, loose spacing, repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.workspace import with_rank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (key + 1).cast("long").alias("id"),
        F.col("p_name").alias("name"),
        F.when(key % 8 != 0, F.col("p_brand")).alias("brand"),
        F.when(key % 32 != 0, F.col("p_type")).alias("category"),
    )


def entries(spark: SparkSession, sf_dir: str, indexed: bool = True) -> DataFrame:
    """Raw entries, and with ``indexed`` their global order.

    They lie by ``true_product``, so a join with the catalog moves none of them again.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
    )
    if indexed:
        order = [F.col(c) for c in lines.columns]
        lines = with_rank(lines, order, "record_index", "entries", kept=lines.columns[:4])
    product = lambda key: (F.col(key) + 1).cast("long").alias("true_product")
    parts = table(spark, sf_dir, "part").select(product("p_partkey"), "p_name", "p_brand", "p_type")
    sellers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    joined = lines.withColumn("true_product", product("l_partkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, "true_product")
    h = F.md5(F.concat(F.col("l_suppkey").cast("string"), F.lit(":"), F.col("l_partkey").cast("string")))
    cut = lambda a, n: F.substring(h, a, n)
    uuid = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    order, number, name = F.col("l_orderkey"), F.col("l_linenumber"), F.col("p_name")
    return joined.select(
        *(["record_index"] if indexed else []),
        F.col("s_name").alias("raw_seller"),
        F.when(order % 90 == 0, F.substring(uuid, 2, 40)).otherwise(uuid).alias("raw_id"),
        F.when(number == 1, F.replace(name, F.lit(" "), F.lit("  ")))
        .when(number == 2, F.concat(F.lit(" "), name))
        .otherwise(name)
        .alias("raw_name"),
        F.when(order % 97 == 0, None)
        .when(order % 101 == 0, F.concat(F.col("p_brand"), F.lit("'; SELECT 1; --")))
        .otherwise(F.col("p_brand"))
        .alias("raw_brand"),
        F.when(order % 103 == 0, "Photo").otherwise(F.col("p_type")).alias("raw_category"),
        "true_product",
    )


PRODUCT_SQL = """product AS (SELECT (p_partkey + 1)::BIGINT AS id, p_name AS name, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_brand END AS brand,
       CASE WHEN p_partkey % 32 = 0 THEN NULL ELSE p_type END AS category FROM part)"""
ENTRIES_SQL = """entries AS (
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS record_index,
       s_name AS raw_seller, CASE WHEN l_orderkey % 90 = 0 THEN substr(u, 2) ELSE u END AS raw_id,
       CASE l_linenumber WHEN 1 THEN replace(p_name, ' ', '  ') WHEN 2 THEN concat(' ', p_name) ELSE p_name END AS raw_name,
       CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 101 = 0 THEN concat(p_brand, '''; SELECT 1; --') ELSE p_brand END AS raw_brand,
       CASE WHEN l_orderkey % 103 = 0 THEN 'Photo' ELSE p_type END AS raw_category, (l_partkey + 1)::BIGINT AS true_product
FROM (SELECT *, concat(substr(h,1,8),'-',substr(h,9,4),'-',substr(h,13,4),'-',substr(h,17,4),'-',substr(h,21,12)) AS u
      FROM (SELECT *, md5(concat(l_suppkey::VARCHAR, ':', l_partkey::VARCHAR)) AS h
            FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)))"""
