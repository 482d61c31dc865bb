"""The star schema as a typed property graph, the stand-in for a loaded graph.

Regions contain nations, nations customers, customers their orders: the hierarchy. Orders use parts, parts apply to
suppliers, suppliers sit in nations. A node's document is its region.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.operators.graph import GraphStore
from graphloom.sources.tables import table


def key(kind: str, column: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), (F.col(column) if isinstance(column, str) else column).cast("string"))


def star_graph(spark: SparkSession, sf_dir: str) -> GraphStore:
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation")
    place = F.broadcast(nation.select(F.col("n_nationkey").alias("__n"), F.col("n_regionkey").alias("__r")))  # 25 rows at any scale
    customer = t("customer").join(place, F.col("c_nationkey") == F.col("__n"))
    supplier = t("supplier").join(place, F.col("s_nationkey") == F.col("__n"))
    orders = t("orders").join(customer.select("c_custkey", "__r"), F.col("o_custkey") == F.col("c_custkey"))

    def node(rows: DataFrame, kind: str, id_: str, label: str, content: Column, doc: Column) -> DataFrame:
        return rows.select(key(kind, id_).alias("id"), F.lit(kind.title()).alias("type"), F.col(label).alias("label"), content.cast("string").alias("content"), doc.cast("string").alias("doc"))

    nothing = F.lit(None)
    nodes = [
        node(t("region"), "region", "r_regionkey", "r_name", nothing, F.col("r_regionkey")),
        node(nation, "nation", "n_nationkey", "n_name", nothing, F.col("n_regionkey")),
        node(customer, "customer", "c_custkey", "c_name", F.col("c_mktsegment"), F.col("__r")),
        node(supplier, "supplier", "s_suppkey", "s_name", nothing, F.col("__r")),
        node(t("part"), "part", "p_partkey", "p_name", F.col("p_type"), nothing),
        node(orders, "order", "o_orderkey", "o_orderpriority", F.col("o_orderstatus"), F.col("__r")),
    ]

    def edge(rows: DataFrame, src: Column, kind: str, dst: Column) -> DataFrame:
        return rows.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"))

    lines = t("lineitem")
    edges = [
        edge(nation, key("region", "n_regionkey"), "CONTAINS", key("nation", "n_nationkey")),
        edge(t("customer"), key("nation", "c_nationkey"), "CONTAINS", key("customer", "c_custkey")),
        edge(t("orders"), key("customer", "o_custkey"), "PLACED", key("order", "o_orderkey")),
        edge(lines.select("l_orderkey", "l_partkey").distinct(), key("order", "l_orderkey"), "USES", key("part", "l_partkey")),
        edge(lines.select("l_partkey", "l_suppkey").distinct(), key("part", "l_partkey"), "APPLIES_TO", key("supplier", "l_suppkey")),
        edge(t("supplier"), key("supplier", "s_suppkey"), "LOCATED_IN", key("nation", "s_nationkey")),
    ]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return GraphStore(union(nodes).withColumn("labels", F.array(F.lit("Entity"), F.col("type"))), union(edges))


#: The same graph in SQL.
GRAPH_SQL = """
nodes AS (
  SELECT concat('region:', r_regionkey) AS id, 'Region' AS type, r_name AS label, NULL::VARCHAR AS content, r_regionkey::VARCHAR AS doc FROM region
  UNION ALL SELECT concat('nation:', n_nationkey), 'Nation', n_name, NULL, n_regionkey::VARCHAR FROM nation
  UNION ALL SELECT concat('customer:', c_custkey), 'Customer', c_name, c_mktsegment, n_regionkey::VARCHAR FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT concat('supplier:', s_suppkey), 'Supplier', s_name, NULL, n_regionkey::VARCHAR FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT concat('part:', p_partkey), 'Part', p_name, p_type, NULL FROM part
  UNION ALL SELECT concat('order:', o_orderkey), 'Order', o_orderpriority, o_orderstatus, n_regionkey::VARCHAR FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
edges AS (
  SELECT concat('region:', n_regionkey) AS src, 'CONTAINS' AS type, concat('nation:', n_nationkey) AS dst FROM nation
  UNION ALL SELECT concat('nation:', c_nationkey), 'CONTAINS', concat('customer:', c_custkey) FROM customer
  UNION ALL SELECT concat('customer:', o_custkey), 'PLACED', concat('order:', o_orderkey) FROM orders
  UNION ALL SELECT DISTINCT concat('order:', l_orderkey), 'USES', concat('part:', l_partkey) FROM lineitem
  UNION ALL SELECT DISTINCT concat('part:', l_partkey), 'APPLIES_TO', concat('supplier:', l_suppkey) FROM lineitem
  UNION ALL SELECT concat('supplier:', s_suppkey), 'LOCATED_IN', concat('nation:', s_nationkey) FROM supplier)"""
