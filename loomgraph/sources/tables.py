"""The relational tables as a property graph: keys are nodes, foreign keys are CALLS edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schema as S
from loomgraph.session import read

#: Table, key, label, and the number that orders its nodes among those of others.
TABLES = (("region", "r_regionkey", "r_name", 0), ("nation", "n_nationkey", "n_name", 1), ("customer", "c_custkey", "c_name", 2), ("supplier", "s_suppkey", "s_name", 3), ("part", "p_partkey", "p_name", 4), ("orders", "o_orderkey", "o_orderpriority", 5))


def key(table: str, column: str) -> Column:
    return F.concat(F.lit(f"{table}:"), F.col(column).cast("string"))


def fk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, node_type, file (the table), signature (the label), node_pos."""
    out = None
    for table, k, label, number in TABLES:
        part = read(spark, sf_dir, table).select(key(table, k).alias("name"), F.lit(S.FUNCTION).alias("node_type"), F.lit(table).alias("file"), F.col(label).alias("signature"), (F.lit(number * 10**12) + F.col(k).cast("long")).alias("node_pos"))
        out = part if out is None else out.unionByName(part)
    return out


def fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight, edge_type; an order's edges to parts and suppliers weigh the number of its lines."""

    def direct(table: str, a: str, other: str, b: str) -> DataFrame:
        return read(spark, sf_dir, table).where(F.col(b).isNotNull()).select(key(table, a).alias("src"), key(other, b).alias("dst"), F.lit(1.0).alias("weight"))

    lines = read(spark, sf_dir, "lineitem")
    out = direct("nation", "n_nationkey", "region", "n_regionkey").union(direct("customer", "c_custkey", "nation", "c_nationkey")).union(direct("supplier", "s_suppkey", "nation", "s_nationkey")).union(direct("orders", "o_orderkey", "customer", "o_custkey"))
    for other, b in (("part", "l_partkey"), ("supplier", "l_suppkey")):
        # numbers are grouped, as names take twice the shuffle
        counted = lines.groupBy("l_orderkey", b).agg(F.count("*").cast("double").alias("weight"))
        out = out.union(counted.select(key("orders", "l_orderkey").alias("src"), key(other, b).alias("dst"), "weight"))
    return out.withColumn("edge_type", F.lit(S.CALLS))


FK_SQL = """
fk_nodes AS (
  SELECT 'region:' || r_regionkey AS name, 'region' AS file, r_name AS signature, CAST(r_regionkey AS BIGINT) AS node_pos FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 1000000000000 + n_nationkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, 2000000000000 + c_custkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 3000000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, 4000000000000 + p_partkey FROM part
  UNION ALL SELECT 'orders:' || o_orderkey, 'orders', o_orderpriority, 5000000000000 + o_orderkey FROM orders),
fk_edges AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 1.0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 1.0 FROM supplier
  UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, 1.0 FROM orders
  UNION ALL SELECT 'orders:' || l_orderkey, 'part:' || l_partkey, count(*)::DOUBLE FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT 'orders:' || l_orderkey, 'supplier:' || l_suppkey, count(*)::DOUBLE FROM lineitem GROUP BY 1, 2)"""
