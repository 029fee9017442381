"""Graph queries over the star schema seen as a property graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import graph as g
from lodegraph.registry import query
from lodegraph.sources.tables import GRAPH_SQL, edges, nodes, table


def ids(df: DataFrame, node_type: str) -> DataFrame:
    return df.where(F.col("type") == node_type).select("node_id")


@query(f"""WITH {GRAPH_SQL}
SELECT i.node_id, i.src, i.rel, i.dst, i.other FROM incident i JOIN nodes n USING (node_id) WHERE n.type = 'nation' AND i.rel IN ('in_nation', 'in_region')""")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges around every nation, of two relations."""
    e = edges(spark, sf_dir, ("in_nation", "in_region"))
    return g.neighbors(e, table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id")), ["in_nation", "in_region"])


@query(f"""WITH {GRAPH_SQL}, step AS (SELECT DISTINCT node_id, other FROM incident),
seeds AS (SELECT node_id FROM nodes WHERE type = 'supplier'),
one AS (SELECT DISTINCT s.node_id AS seed, t.other AS node_id FROM seeds s JOIN step t USING (node_id)),
two AS (SELECT DISTINCT o.seed, t.other AS node_id FROM one o JOIN step t USING (node_id)),
f AS (SELECT seed, node_id, 1 AS hop FROM one UNION ALL SELECT seed, node_id, 2 FROM two)
SELECT node_id, count(DISTINCT seed) AS support, min(hop)::BIGINT AS min_hops FROM f JOIN nodes USING (node_id)
WHERE type = 'order' GROUP BY 1 ORDER BY support DESC, min_hops, node_id LIMIT 50""")
def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders within two hops of suppliers, by how many suppliers reach them."""
    n = nodes(spark, sf_dir)
    return g.expand(edges(spark, sf_dir), ids(n, "supplier"), 2, n, "order")


@query(f"""WITH {GRAPH_SQL}, step AS (SELECT DISTINCT node_id, other FROM incident),
seeds AS (SELECT DISTINCT 'o' || o_orderkey AS node_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 490000),
ent AS (SELECT DISTINCT s.other AS node_id FROM step s SEMI JOIN seeds USING (node_id) JOIN nodes n ON n.node_id = s.other WHERE n.type IN ('part', 'customer'))
SELECT s.other AS node_id, count(DISTINCT e.node_id) AS shared FROM ent e JOIN step s USING (node_id) JOIN nodes n ON n.node_id = s.other
WHERE n.type = 'order' AND s.other NOT IN (SELECT node_id FROM seeds) GROUP BY 1 ORDER BY shared DESC, node_id LIMIT 25""")
def graph_shared_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share parts or the customer with large urgent orders."""
    seeds = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 490000").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node_id"))
    return g.shared_entities(edges(spark, sf_dir), seeds, nodes(spark, sf_dir), ["part", "customer"], "order", 25)


@query(f"""WITH {GRAPH_SQL}, step AS (SELECT DISTINCT node_id, other, CASE WHEN src = node_id THEN rel ELSE '~' || rel END AS rel FROM incident WHERE rel IN ('in_nation', 'in_region')),
p1 AS (SELECT n.node_id AS start, s.other AS node_id, [n.node_id, s.other] AS path, [s.rel] AS rels, 1 AS hops FROM nodes n JOIN step s USING (node_id) WHERE n.type = 'region'),
p2 AS (SELECT p.start, s.other AS node_id, list_append(path, s.other) AS path, list_append(rels, s.rel) AS rels, 2 AS hops FROM p1 p JOIN step s USING (node_id) WHERE NOT list_contains(path, s.other)),
p3 AS (SELECT p.start, s.other AS node_id, list_append(path, s.other) AS path, list_append(rels, s.rel) AS rels, 3 AS hops FROM p2 p JOIN step s USING (node_id) WHERE NOT list_contains(path, s.other)),
u AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3),
r AS (SELECT *, row_number() OVER (PARTITION BY start, node_id, hops ORDER BY array_to_string(path, '>'), array_to_string(rels, '>')) AS k FROM u)
SELECT start, node_id, hops::BIGINT AS hops, array_to_string(path, '>') AS path, array_to_string(rels, '>') AS rels FROM r WHERE k = 1""")
def graph_typed_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first simple path from each region to every end at each length."""
    e = edges(spark, sf_dir, ("in_nation", "in_region"))
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"))
    out = g.walk(e, starts, 3, ["in_nation", "in_region"])
    return out.select("start", "node_id", "hops", F.array_join("path", ">").alias("path"), F.array_join("rels", ">").alias("rels"))


@query("""SELECT DISTINCT 'c' || c_custkey AS node_id FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA'
UNION SELECT 's' || s_suppkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE r_name = 'ASIA'""")
def graph_exact_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is exactly two hops from one region."""
    e = edges(spark, sf_dir, ("in_nation", "in_region"))
    start = table(spark, sf_dir, "region").where("r_name = 'ASIA'").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"))
    return g.walk(e, start, 2, ["in_nation", "in_region"]).where("hops = 2").select("node_id").distinct()


@query("""SELECT DISTINCT 'p' || l_partkey AS node_id FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE r_name = 'EUROPE'""")
def graph_relation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in orders of a region's customers, by four relations against their direction and one along it."""
    start = table(spark, sf_dir, "region").where("r_name = 'EUROPE'").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"))
    return g.chain(edges(spark, sf_dir), start, ["~in_region", "~in_nation", "~placed_by", "contains"])


@query(f"""WITH {GRAPH_SQL}, step AS (SELECT DISTINCT src AS node_id, rel, dst AS other FROM edges UNION SELECT DISTINCT dst, '~' || rel, src FROM edges),
a AS (SELECT DISTINCT s.other AS node_id, s.rel AS chain FROM nodes n JOIN step s USING (node_id) WHERE n.type = 'nation'),
b AS (SELECT DISTINCT s.other AS node_id, chain || '>' || s.rel AS chain FROM a JOIN step s USING (node_id)),
c AS (SELECT DISTINCT s.other AS node_id, chain || '>' || s.rel AS chain FROM b JOIN step s USING (node_id))
SELECT chain, count(*) AS ends FROM c GROUP BY 1 ORDER BY ends DESC, chain LIMIT 40""")
def graph_chain_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relation chains of three steps from nations, by the number of their ends."""
    return g.chains(edges(spark, sf_dir), ids(nodes(spark, sf_dir), "nation"))


@query("""WITH e AS (SELECT 'c' || c_custkey AS src, 'in_nation' AS rel, 'n' || c_nationkey AS dst FROM customer UNION SELECT 's' || s_suppkey, 'in_nation', 'n' || s_nationkey FROM supplier
  UNION SELECT 'n' || n_nationkey, 'in_region', 'r' || n_regionkey FROM nation UNION SELECT 'o' || o_orderkey, 'placed_by', 'c' || o_custkey FROM orders),
step AS (SELECT src AS n, rel, dst AS o FROM e UNION SELECT dst, '~' || rel, src FROM e),
vals AS (SELECT DISTINCT dst AS n FROM e WHERE rel = 'in_region' AND dst NOT IN (SELECT src FROM e)),
p AS (SELECT s.start, a.rel r1, a.o e1, b.rel r2, b.o e2, c.rel r3, c.o e3 FROM (SELECT DISTINCT 's' || s_suppkey AS start FROM supplier) s JOIN step a ON a.n = s.start
  JOIN step b ON b.n = a.o JOIN step c ON c.n = b.o WHERE a.o NOT IN (FROM vals) AND b.o NOT IN (FROM vals) AND b.o <> s.start),
k AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY r1, e1, r2, e2, r3, e3) AS k FROM p)
SELECT start, r1, e1, r2, e2, r3, e3 FROM k WHERE k = 1""")
def graph_first_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's first path of three steps."""
    e = edges(spark, sf_dir, ("in_nation", "in_region", "placed_by"))
    starts = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"))
    return g.first_paths(e, starts, ["in_region"])


@query(f"""WITH RECURSIVE {GRAPH_SQL}, step AS (SELECT DISTINCT node_id, other FROM incident),
bfs AS (SELECT 'r0' AS node_id, 0 AS d UNION SELECT s.other, d + 1 FROM bfs JOIN step s USING (node_id) WHERE d < 4)
SELECT min(d)::BIGINT AS depth, node_id FROM bfs GROUP BY node_id HAVING min(d) > 0""")
def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes at each depth from a region, each at its first."""
    start = spark.createDataFrame([("r0",)], "node_id string")
    return g.levels(edges(spark, sf_dir), start, 4)


HITS_SQL = "hit AS (SELECT 'n' || n_nationkey AS node_id FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 5000)"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, regions and the richer suppliers."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("node_id")
    return table(spark, sf_dir, "nation").select(key("n", "n_nationkey")).union(table(spark, sf_dir, "region").select(key("r", "r_regionkey"))).union(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(key("s", "s_suppkey")))


@query(f"""WITH {GRAPH_SQL}, {HITS_SQL}, step AS (SELECT DISTINCT node_id, other FROM incident),
one AS (SELECT s.node_id AS a, s.other AS b FROM hit JOIN step s USING (node_id)),
two AS (SELECT DISTINCT x.a, s.other AS b FROM one x JOIN step s ON s.node_id = x.b),
near AS (SELECT h.node_id AS b, s.other AS m FROM hit h JOIN step s USING (node_id)),
three AS (SELECT DISTINCT x.a, n.b FROM two x JOIN near n ON n.m = x.b),
best AS (SELECT a, b, min(d) AS d FROM (SELECT a, b, 1 AS d FROM one UNION ALL SELECT a, b, 2 FROM two UNION ALL SELECT a, b, 3 FROM three) GROUP BY ALL)
SELECT coalesce(best.d::VARCHAR, 'more') AS steps, count(*) AS n FROM hit x JOIN hit y ON x.node_id < y.node_id LEFT JOIN best ON best.a = x.node_id AND best.b = y.node_id GROUP BY 1""")
def graph_path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart the matched nodes are in the whole graph, by the number of pairs."""
    return g.path_distribution(edges(spark, sf_dir), hits(spark, sf_dir)).select(F.coalesce(F.col("steps").cast("string"), F.lit("more")).alias("steps"), "n")


@query(f"""WITH {GRAPH_SQL}, pair AS (SELECT DISTINCT 's' || l_suppkey AS a, 'c' || o_custkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity = 50),
step AS (SELECT DISTINCT node_id, other FROM incident), origin AS (SELECT DISTINCT a FROM pair), to_b AS (SELECT s.other AS m, b FROM (SELECT DISTINCT b FROM pair) JOIN step s ON s.node_id = b),
one AS (SELECT a, s.other AS b FROM origin JOIN step s ON s.node_id = a), two AS (SELECT DISTINCT a, m.b FROM one JOIN to_b m ON m.m = one.b),
far AS (SELECT DISTINCT a, s.other AS b FROM one JOIN step s ON s.node_id = one.b), three AS (SELECT DISTINCT a, m.b FROM far JOIN to_b m ON m.m = far.b)
SELECT a, b, CASE WHEN (a, b) IN (FROM two) THEN 2::BIGINT WHEN (a, b) IN (FROM three) THEN 3 END AS steps FROM pair""")
def graph_pair_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest path of suppliers to customers who bought much from them, pair by pair."""
    many = table(spark, sf_dir, "lineitem").where("l_quantity = 50").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = many.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("b")).distinct()
    return g.path_lengths(edges(spark, sf_dir), pairs)


@query("""WITH e AS (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, l_suppkey AS doc_id FROM lineitem),
ent AS (SELECT 'p' || p_partkey AS node_id FROM part WHERE p_brand = 'Brand#2')
SELECT doc_id, count(*) AS votes FROM (SELECT src AS n, doc_id FROM e UNION ALL SELECT dst, doc_id FROM e WHERE src <> dst) JOIN ent ON n = node_id GROUP BY 1""")
def graph_document_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents, voted for by the order lines of one brand's parts."""
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_suppkey").alias("doc_id"))
    entities = table(spark, sf_dir, "part").where("p_brand = 'Brand#2'").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"))
    return g.edge_votes(e, entities)


@query("""WITH e AS (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, l_suppkey AS doc_id FROM lineitem),
ent AS (SELECT 'o' || o_orderkey AS node_id FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT 'p' || p_partkey FROM part WHERE p_size > 40)
SELECT doc_id, 1 + (d.node_id IS NOT NULL)::BIGINT AS weight FROM e JOIN ent s ON s.node_id = src LEFT JOIN ent d ON d.node_id = dst ORDER BY weight DESC, doc_id LIMIT 1""")
def graph_edge_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of the edge that touches the entities most."""
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_suppkey").alias("doc_id"))
    entities = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node_id")).union(table(spark, sf_dir, "part").where("p_size > 40").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))))
    return g.touches(e, entities)


@query(f"""WITH {GRAPH_SQL}, step AS (SELECT DISTINCT node_id, other FROM incident), deg AS (SELECT node_id, count(*) AS d FROM step GROUP BY 1),
linked AS (SELECT 's' || s_suppkey AS node_id, s_nationkey AS query_id FROM supplier),
near AS (SELECT DISTINCT query_id, other AS node_id FROM linked JOIN step USING (node_id) EXCEPT SELECT query_id, node_id FROM linked),
u AS (SELECT query_id, node_id, -1 AS d FROM linked UNION ALL SELECT query_id, node_id, d FROM near JOIN deg USING (node_id)),
r AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY d, node_id) AS rank FROM u)
SELECT query_id, node_id, rank FROM r WHERE rank <= 20""")
def graph_rare_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation its suppliers, then their neighbours, the least connected first."""
    linked = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("query_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"))
    return g.rare_neighbors(edges(spark, sf_dir), linked, 20).drop("degree")


@query(f"""WITH {GRAPH_SQL} SELECT n.node_id, array_to_string(list_sort(list_distinct(list(i.src || ' ' || i.rel || ' ' || i.dst) FILTER (i.rel IS NOT NULL))), '; ') AS relations
FROM (SELECT node_id FROM nodes WHERE type = 'supplier') n LEFT JOIN incident i USING (node_id) GROUP BY 1""")
def graph_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier with its distinct incident edges."""
    hits = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"))
    out = g.hydrated(hits, edges(spark, sf_dir))
    line = F.transform("relations", lambda x: F.concat_ws(" ", x["src"], x["rel"], x["dst"]))
    return out.select("node_id", F.array_join(F.sort_array(line), "; ").alias("relations"))


@query("""WITH seeds AS (SELECT s_nationkey AS query_id, 's' || s_suppkey AS node_id, s_acctbal AS score FROM supplier WHERE s_acctbal > 0),
step AS (SELECT DISTINCT 's' || l_suppkey AS node_id, 'p' || l_partkey AS other FROM lineitem),
near AS (SELECT query_id, other AS node_id, max(score) * 0.85 AS score FROM seeds JOIN step USING (node_id) GROUP BY 1, 2),
u AS (FROM seeds UNION ALL SELECT * FROM near), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM u)
SELECT query_id, node_id, round(score, 6) AS score, rank FROM r WHERE rank <= 8""")
def graph_top_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation, then the parts next to them at a damped score."""
    seeds = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("query_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), F.col("s_acctbal").alias("score"))
    out = g.topped_up(seeds, edges(spark, sf_dir, ("supplied_by",)), 5, 3)
    return out.select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {GRAPH_SQL}, s AS (SELECT 'n' || n_nationkey AS node_id FROM nation WHERE n_regionkey < 2 UNION SELECT 's' || s_suppkey FROM supplier UNION SELECT 'r' || r_regionkey FROM region)
SELECT src, rel, dst, CAST('0x' || right(md5(rel), 1) AS BIGINT) AS rel_index FROM edges WHERE src IN (FROM s) AND dst IN (FROM s)""")
def graph_internal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges within a set of nodes, with the relation's hash index."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("node_id")
    chosen = table(spark, sf_dir, "nation").where("n_regionkey < 2").select(key("n", "n_nationkey")).union(table(spark, sf_dir, "supplier").select(key("s", "s_suppkey"))).union(table(spark, sf_dir, "region").select(key("r", "r_regionkey")))
    return g.internal(edges(spark, sf_dir), chosen)


@query(f"""WITH {GRAPH_SQL} SELECT node_id, count(*) AS degree, count(DISTINCT rel) AS relations FROM incident GROUP BY 1""")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: degree and relations of every node."""
    return g.degree_report(edges(spark, sf_dir))


@query(f"""WITH {GRAPH_SQL}, o AS (SELECT DISTINCT src, rel, dst FROM edges WHERE src IN (SELECT node_id FROM nodes) AND dst IN (SELECT node_id FROM nodes))
SELECT rel, (SELECT count(*) FROM edges b WHERE b.rel = o.rel) AS bag, count(*) AS merged FROM o GROUP BY rel""")
def graph_relation_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: edges of each relation before and after the store merges them."""
    e, n = edges(spark, sf_dir), nodes(spark, sf_dir)
    bag = e.groupBy("rel").agg(F.count(F.lit(1)).alias("bag"))
    return bag.join(g.stored(e, n).groupBy("rel").agg(F.count(F.lit(1)).alias("merged")), "rel")


@query("""SELECT c_nationkey AS node_id, max_by(c_mktsegment, c_custkey) AS segment, max_by(c_acctbal, CASE WHEN c_acctbal > 0 THEN c_custkey END) AS balance, max_by(c_name, c_custkey) AS name FROM customer GROUP BY 1""")
def graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written one after another into their nation's node; of each attribute the last value that isn't null stays."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("node_id"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ord"))
    return g.upsert(rows)


@query("""WITH e AS (SELECT DISTINCT 's' || l_suppkey AS node_id, 'p' || l_partkey AS other FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
direct AS (SELECT 's' || s_suppkey AS node_id, s_acctbal / 10000 AS score FROM supplier WHERE s_acctbal > 5000),
ev AS (SELECT 's' || s_suppkey AS node_id, greatest(s_acctbal, 0) / 10000 AS similarity FROM supplier),
via AS (SELECT DISTINCT d.node_id AS seed, b.other AS node_id FROM direct d JOIN e a USING (node_id) JOIN e b ON b.node_id = a.other WHERE b.other <> d.node_id AND b.other NOT IN (SELECT node_id FROM direct)),
c AS (SELECT node_id, count(DISTINCT seed) AS support, 2 AS hops FROM via GROUP BY 1),
sp AS (SELECT CASE WHEN max(score) - min(score) > 0 THEN max(score) - min(score) ELSE max(score) END AS spread FROM direct)
SELECT node_id, support, hops::BIGINT AS hops, round(similarity + 0.5 * least(support, 5) / 5 / hops * spread, 6) AS score FROM c JOIN ev USING (node_id), sp WHERE similarity >= 0.05""")
def graph_boosted_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share parts with the richest ones, boosted by how many they share them with."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), F.col("s_acctbal").alias("balance"))
    direct = s.where("balance > 5000").select("node_id", (F.col("balance") / 10000).alias("score"))
    similarity = s.select("node_id", (F.greatest("balance", F.lit(0.0)) / 10000).alias("similarity"))
    out = g.boosted(direct, edges(spark, sf_dir, ("supplied_by",)), s, similarity, 0.5)
    return out.withColumn("score", F.round("score", 6))
