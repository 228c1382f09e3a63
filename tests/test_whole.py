"""Every query takes every row of its tables."""

from helpers import SF, duck_rows, rows_of

from millrace import catalog
from millrace.runtime import table
from millrace.sources import tables


def test_query_hash_groups(spark):
    groups = catalog.QUERIES["query_hash_groups"](spark, SF).collect()
    ids = sorted(int(i) for r in groups for i in r["query_ids"].split(","))
    assert ids == sorted(r[0] for r in table(spark, SF, "orders").select("o_orderkey").collect())


def test_graphs_of_every_line(spark):
    n = table(spark, SF, "lineitem").count()
    assert tables.cust_supp(spark, SF).edges.count() == n
    assert tables.supp_part(spark, SF).edges.count() == n
    cheapest = """SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(min(round(l_extendedprice * 100)) AS DOUBLE) AS weight FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""
    assert rows_of(tables.nation_trade(spark, SF).edges.select("src", "dst", "weight")) == duck_rows(cheapest)


def test_no_query_filters_lines_or_customers():
    assert not [k for k, v in catalog.ORACLE_SQL.items() if "l_quantity" in v or "l_returnflag" in v or "l_discount" in v or "o_custkey <" in v]
