"""Named graphs over the driver's tables, of every line; weights are whole cents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.graph import Graph
from millrace.runtime import table


def nation_trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Customer's nation to supplier's nation, weighing the cheapest line between them; every nation is a vertex."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = rows.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.min(F.round(F.col("l_extendedprice") * 100)).alias("weight"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("long").alias("tag"), F.col("n_name").alias("name"))
    return Graph.of(nations, edges)


def cust_supp(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers (even ids) to suppliers (odd ids) of the lines; vertices are the ends of edges."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = rows.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), F.round(F.col("l_extendedprice") * 100).alias("weight"))
    return Graph.of(None, edges)


def supp_part(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers (odd ids) to parts (even ids)."""
    lines = table(spark, sf_dir, "lineitem")
    return Graph.of(None, lines.select((F.col("l_suppkey") * 2 + 1).alias("src"), (F.col("l_partkey") * 2).alias("dst"), F.round(F.col("l_extendedprice") * 100).alias("weight")))


def user_flow(spark: SparkSession, sf_dir: str) -> Graph:
    """From the user of each error event to the user of the next event in time; every user is a vertex."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    # The log is one sequence; its order is found per hour, and the hour's last row looks up the next hour's first.
    hour = F.date_trunc("hour", F.col("ts"))
    mine = events.withColumn("hour", hour)
    order = Window.partitionBy("hour").orderBy("ts", "event_id")
    firsts = mine.groupBy("hour").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first_user"))
    following = firsts.select("hour", F.lead("first_user").over(Window.orderBy("hour")).alias("next_user"))  # one row an hour
    rows = mine.withColumn("then", F.lead("user_id").over(order)).join(following, "hour")
    edges = rows.where("event_type = 'error'").select(F.col("user_id").alias("src"), F.coalesce("then", "next_user").alias("dst"), F.lit(1.0).alias("weight")).where("dst is not null")
    return Graph.of(events.select(F.col("user_id").alias("id")).distinct(), edges)


NATION_SQL = """SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(min(round(l_extendedprice * 100)) AS DOUBLE) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2"""
CUST_SUPP_SQL = "SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, round(l_extendedprice * 100) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
SUPP_PART_SQL = "SELECT l_suppkey * 2 + 1 AS src, l_partkey * 2 AS dst, round(l_extendedprice * 100) AS w FROM lineitem"
USER_FLOW_SQL = """SELECT user_id AS src, dst FROM (SELECT user_id, event_type, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events)
  WHERE event_type = 'error' AND dst IS NOT NULL"""
