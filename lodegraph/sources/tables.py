"""The star-schema tables as DataFrames, and the property graph that they hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: table, prefix and key of the source, relation, prefix and key of the destination.
EDGES = [
    ("customer", "c", "c_custkey", "in_nation", "n", "c_nationkey"),
    ("supplier", "s", "s_suppkey", "in_nation", "n", "s_nationkey"),
    ("nation", "n", "n_nationkey", "in_region", "r", "n_regionkey"),
    ("orders", "o", "o_orderkey", "placed_by", "c", "o_custkey"),
    ("lineitem", "o", "l_orderkey", "contains", "p", "l_partkey"),
    ("lineitem", "p", "l_partkey", "supplied_by", "s", "l_suppkey"),
]
#: table, prefix, key, type, label.
NODES = [
    ("customer", "c", "c_custkey", "customer", "c_name"),
    ("supplier", "s", "s_suppkey", "supplier", "s_name"),
    ("nation", "n", "n_nationkey", "nation", "n_name"),
    ("region", "r", "r_regionkey", "region", "r_name"),
    ("orders", "o", "o_orderkey", "order", "o_orderpriority"),
    ("part", "p", "p_partkey", "part", "p_name"),
]


def edges(spark: SparkSession, sf_dir: str, relations: tuple[str, ...] | None = None) -> DataFrame:
    """(src, rel, dst), a bag. With relations, only the tables that hold them are read."""
    parts = [
        table(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(k).cast("string")).alias("src"), F.lit(rel).alias("rel"), F.concat(F.lit(b), F.col(d).cast("string")).alias("dst"))
        for t, a, k, rel, b, d in EDGES
        if relations is None or rel in relations
    ]
    return reduce(DataFrame.unionByName, parts)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, type, label)."""
    parts = [table(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(k).cast("string")).alias("node_id"), F.lit(kind).alias("type"), F.col(label).alias("label")) for t, a, k, kind, label in NODES]
    return reduce(DataFrame.unionByName, parts)


#: The same two tables as SQL.
EDGES_SQL = "\n  UNION ALL ".join(f"SELECT '{a}' || {k} AS src, '{rel}' AS rel, '{b}' || {d} AS dst FROM {t}" for t, a, k, rel, b, d in EDGES)
NODES_SQL = "\n  UNION ALL ".join(f"SELECT '{a}' || {k} AS node_id, '{kind}' AS type, {label} AS label FROM {t}" for t, a, k, kind, label in NODES)
GRAPH_SQL = f"""edges AS ({EDGES_SQL}),
nodes AS ({NODES_SQL}),
incident AS (SELECT src AS node_id, src, rel, dst, dst AS other FROM edges
  UNION ALL SELECT dst, src, rel, dst, src FROM edges WHERE src <> dst)"""
