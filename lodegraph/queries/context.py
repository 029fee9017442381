"""Queries of contexts, guards and scores, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import context as x
from lodegraph.operators import graph as g
from lodegraph.operators import stats
from lodegraph.operators.retrieval import blended, char_sum_vector
from lodegraph.operators.similarity import closest
from lodegraph.registry import query
from lodegraph.sources.tables import GRAPH_SQL, edges, nodes, table


def key(prefix: str, column: str, name: str = "node_id"):
    return F.concat(F.lit(prefix), F.col(column).cast("string")).alias(name)


@query(f"""WITH {GRAPH_SQL}, s AS (SELECT DISTINCT node_id AS a, other AS b FROM incident), h AS (SELECT 's' || s_suppkey AS b FROM supplier),
p1 AS (SELECT 'r' || r_regionkey AS start, b, ['r' || r_regionkey, b] AS p FROM region JOIN s ON a = 'r' || r_regionkey),
p2 AS (SELECT start, s.b, list_append(p, s.b) AS p FROM p1 JOIN s ON s.a = p1.b WHERE NOT list_contains(p, s.b)),
p3 AS (SELECT start, s.b, list_append(p, s.b) AS p FROM p2 JOIN s ON s.a = p2.b WHERE NOT list_contains(p, s.b)),
p4 AS (SELECT start, s.b, list_append(p, s.b) AS p FROM p3 JOIN s ON s.a = p3.b SEMI JOIN h ON h.b = s.b WHERE NOT list_contains(p, s.b)),
u AS (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3 UNION ALL FROM p4)
SELECT start, b AS node_id, (len(p) - 1)::BIGINT AS hops, array_to_string(p, '>') AS path, 1::BIGINT AS matches FROM u SEMI JOIN h USING (b) ORDER BY hops, path LIMIT 20""")
def paths_to_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty paths of four steps or less from regions to nodes whose label or summary has a term, in the whole graph."""
    n = nodes(spark, sf_dir).withColumn("summary", F.concat(F.lit("a "), "type"))
    return x.paths_to_terms(edges(spark, sf_dir), n, table(spark, sf_dir, "region").select(key("r", "r_regionkey")), ["supplier"])


@query(f"""WITH {GRAPH_SQL}, s AS (SELECT 's' || s_suppkey AS node_id FROM supplier WHERE s_acctbal > 8000), f AS (SELECT i.* FROM incident i SEMI JOIN s USING (node_id)),
o AS (SELECT DISTINCT other AS node_id FROM f WHERE other NOT IN (FROM s) ORDER BY 1 LIMIT 10) SELECT src, rel, dst FROM f UNION SELECT src, rel, dst FROM incident SEMI JOIN o USING (node_id)""")
def subgraph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at the richest suppliers and at their first neighbours."""
    return x.subgraph(edges(spark, sf_dir), table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(key("s", "s_suppkey")))


@query("""WITH n AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w FROM part), s AS (SELECT p_partkey, len(list_intersect(w, ['red', 'ring', 'small'])) / len(w)::DOUBLE AS s FROM n)
SELECT p_partkey, round(s, 6) AS overlap FROM s WHERE s > 0 ORDER BY s DESC, p_partkey LIMIT 50""")
def keyword_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by the share of their words that a question has; the best fifty."""
    w = F.array_distinct(x.tokens(F.col("p_name")))
    n = table(spark, sf_dir, "part").select("p_partkey", (F.size(F.array_intersect(w, F.array(*map(F.lit, ["red", "ring", "small"])))) / F.size(w)).alias("s")).where("s > 0")
    return n.orderBy(F.desc("s"), "p_partkey").limit(50).select("p_partkey", F.round("s", 6).alias("overlap"))


@query(f"""WITH {GRAPH_SQL}, deg AS (SELECT node_id, count(*) AS degree FROM incident GROUP BY 1), st AS (SELECT * FROM incident WHERE rel IN ('in_region', 'in_nation')), one AS (SELECT src, rel, dst, other, 1 AS hop FROM st WHERE node_id = 'r1'),
two AS (SELECT s.src, s.rel, s.dst, s.other, 2 AS hop FROM st s WHERE s.node_id IN (SELECT other FROM one WHERE other <> 'r1')) SELECT src, rel, dst, min(hop)::BIGINT AS hop, max(degree) AS degree FROM (FROM one UNION ALL FROM two) JOIN deg ON deg.node_id = other GROUP BY 1, 2, 3""")
def guided_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts within two hops of a region along two relations."""
    return x.guided_facts(edges(spark, sf_dir), spark.createDataFrame([("r1",)], "node_id string"), ["in_region", "in_nation"], 2)


@query("""WITH d AS (SELECT c_nationkey AS query_id, 'c' || c_custkey AS node_id, c_acctbal AS score, c_mktsegment FROM customer WHERE c_acctbal > 5000), e AS (SELECT c_nationkey AS query_id, 'o' || o_orderkey AS node_id, max(o_totalprice / 50) AS score FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
u AS (SELECT query_id, node_id, score FROM d WHERE c_mktsegment <> 'BUILDING' UNION ALL FROM e), b AS (SELECT query_id, node_id, max(score) AS score FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM b)
SELECT query_id, node_id, round(score, 4) AS score, rank FROM r WHERE rank <= 10""")
def retrieve_with_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct hits that are evidence, merged with what expansion adds."""
    c = table(spark, sf_dir, "customer")
    direct = c.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("query_id"), key("c", "c_custkey"), F.col("c_acctbal").alias("score"))
    more = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("query_id"), key("o", "o_orderkey"), (F.col("o_totalprice") / 50).alias("score"))
    out = x.retrieve(direct, more, c.where("c_mktsegment <> 'BUILDING'").select(key("c", "c_custkey")), 10)
    return out.withColumn("score", F.round("score", 4))


@query("""SELECT query_id::INT AS query_id, tab, score::BIGINT AS score FROM (VALUES (1, 'nation', 5), (1, 'region', 1), (2, 'region', 7), (3, 'nation', 1), (3, 'region', 2)) t(query_id, tab, score)""")
def keyword_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by the words of a question."""
    names = table(spark, sf_dir, "region").select(F.lit("region").alias("tab"), F.explode(F.array(F.lit("r_regionkey"), F.lit("r_name"))).alias("name")).distinct()
    samples = table(spark, sf_dir, "region").agg(F.collect_set("r_name").alias("samples"))
    cols = names.crossJoin(samples).unionByName(spark.createDataFrame([("nation", "n_name", ["none"])], "tab string, name string, samples array<string>"))  # one row
    asked = spark.createDataFrame([(1, "every nation by r_regionkey"), (2, "which region is asia"), (3, "n_name in europe")], "query_id int, text string")
    return x.table_scores(asked, cols)


@query("""SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY 1""")
def join_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL written from tables and foreign keys, and run."""
    for t in ("orders", "customer", "nation"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    keys = {("orders", "customer"): ("o_custkey", "c_custkey"), ("nation", "customer"): ("n_nationkey", "c_nationkey")}
    return spark.sql(x.join_path_sql(["orders", "customer", "nation"], keys, "n_name, count(*) AS n", "o_orderstatus = 'F'") + "\nGROUP BY n_name")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS d FROM lineitem), f AS (SELECT s, min(d) AS d FROM e GROUP BY 1), p AS (SELECT l_partkey AS s, min(l_suppkey) AS d FROM lineitem GROUP BY 1) SELECT f.s AS start, f.d AS first, p.d AS second FROM f JOIN p ON p.s = f.d""")
def first_edge_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: the first outgoing edge, twice."""
    li = table(spark, sf_dir, "lineitem")
    f = li.groupBy(F.col("l_orderkey").alias("start")).agg(F.min("l_partkey").alias("first"))
    p = li.groupBy(F.col("l_partkey").alias("first")).agg(F.min("l_suppkey").alias("second"))
    return f.join(p, "first").select("start", "first", "second")


@query(f"""WITH {GRAPH_SQL}, n AS (SELECT src AS node_id, true AS subject, false AS value FROM edges UNION ALL SELECT dst, false, rel IN ('in_region', 'in_nation', 'placed_by') FROM edges)
SELECT node_id, bool_or(subject) OR NOT bool_or(value) AS traversable FROM n GROUP BY 1""")
def traversable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through which nodes of the whole graph a path may go, if regions, nations and customers are values of attributes."""
    return g.traversable(edges(spark, sf_dir), ["in_region", "in_nation", "placed_by"])


@query("""SELECT a.conv_id, a.turn, length(b.text) > 20 AND contains(a.text, b.text) OR contains(a.text, 'gold:' || a.conv_id) AS leaked FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def gold_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that hold their answer."""
    c = table(spark, sf_dir, "conversations")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    leaked = (F.length("gold") > 20) & F.contains("text", "gold") | F.contains("text", F.concat(F.lit("gold:"), F.col("conv_id").cast("string")))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", leaked.alias("leaked"))


@query("""WITH r AS (SELECT o_custkey, o_orderstatus AS arm, avg(o_totalprice) / 500000 AS m FROM orders GROUP BY 1, 2) SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM r WHERE arm = 'O' AND m < 0.5)""")
def base_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers whose mean of one status, the base arm, is low."""
    o = table(spark, sf_dir, "orders")
    results = o.groupBy("o_custkey", F.col("o_orderstatus").alias("arm")).agg((F.avg("o_totalprice") / 500000).alias("m"))
    return o.join(stats.base_failures(results, "o_custkey", "arm", "O", "m", 0.5), "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("""WITH g AS (SELECT l_orderkey AS id, list_distinct(list(l_suppkey)) AS g FROM lineitem GROUP BY 1), p AS (SELECT l_orderkey AS id, list_distinct(list(l_suppkey)) AS p FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)
SELECT id, round(len(list_intersect(g, p)) / len(g)::DOUBLE, 6) AS recall, len(g) = len(p) AND len(list_intersect(g, p)) = len(g) AS full_match FROM g JOIN p USING (id)""")
def plan_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a gold plan's tables that a plan has, and whether both are the same."""
    li = table(spark, sf_dir, "lineitem")
    gold = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("g"))
    plan = li.where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("p"))
    return gold.join(plan, "id").select("id", F.round(F.size(F.array_intersect("g", "p")) / F.size("g"), 6).alias("recall"), (F.sort_array("g") == F.sort_array("p")).alias("full_match"))


@query("""WITH l AS (SELECT l_orderkey AS q, l_linenumber AS k, 't' || l_suppkey AS t FROM lineitem), g AS (SELECT q, list(t ORDER BY k, t) AS ts FROM l GROUP BY 1), p AS (SELECT q, list(t ORDER BY k, t) AS ts FROM l WHERE k <> 2 GROUP BY 1),
s AS (SELECT g.q, g.ts AS g, coalesce(p.ts, []) AS p FROM g LEFT JOIN p USING (q)),
w AS (SELECT q, list_distinct(g) AS gt, list_distinct(p) AS pt, list_distinct(list_transform(range(1, len(g)), lambda i: g[i] || '->' || g[i + 1])) AS gp, list_distinct(list_transform(range(1, len(p)), lambda i: p[i] || '->' || p[i + 1])) AS pp,
  list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN NOT list_contains(p[1:i - 1], p[i]) THEN p[i] END), lambda x: x IS NOT NULL) AS o, list_distinct(g[2:-2]) AS gb FROM s),
r AS (SELECT q, len(list_intersect(pt, gt)) / len(gt)::DOUBLE AS tr, CASE WHEN len(gp) > 0 THEN len(list_intersect(pp, gp)) / len(gp)::DOUBLE WHEN len(pp) = 0 THEN 1.0 ELSE 0.0 END AS pa,
  CASE WHEN len(gb) > 0 THEN (CASE WHEN len(pp) > 0 AND len(o) > 2 THEN len(list_intersect(o[2:-2], gb)) ELSE 0 END) / len(gb)::DOUBLE ELSE 1.0 END AS br FROM w)
SELECT q AS question_id, round(tr, 3) AS table_recall, round(pa, 3) AS path_accuracy, round(br, 3) AS bridge_recall, tr = 1 AND pa = 1 AS correct FROM r""")
def plan_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: each order's suppliers in their lines' order as a join path, against a plan that leaves the second line out."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("k"), F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("t"))
    names = lambda rows: rows.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda s: s["t"]).alias("tables"))
    path = F.zip_with(F.slice("tables", 1, F.size("tables") - 1), F.slice("tables", 2, F.size("tables")), lambda a, b: F.concat_ws("->", a, b)).alias("path")
    gold = names(li).select("question_id", "tables", path, F.slice("tables", 2, F.greatest(F.size("tables") - 2, F.lit(0))).alias("bridges"))
    out = x.plan_scores(gold, names(li.where("k <> 2")).select("question_id", "tables", path))
    return out.select("question_id", *[F.round(c, 3).alias(c) for c in ("table_recall", "path_accuracy", "bridge_recall")], "correct")


@query("""WITH p AS (SELECT s_suppkey AS q, [s_name, n_name || ' (nation)', 'The ' || r_name] AS path, CASE s_suppkey % 4 WHEN 0 THEN n_name WHEN 1 THEN r_name || '!' WHEN 2 THEN 'ATLANTIS' END AS bridge FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT q AS question_id, q % 4 < 2 AS recalled FROM p""")
def bridge_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the gold bridge stands within a label of each supplier's path to its region."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    p = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    k = F.col("s_suppkey") % 4
    bridge = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat("r_name", F.lit("!"))).when(k == 2, "ATLANTIS")
    path = F.array("s_name", F.concat("n_name", F.lit(" (nation)")), F.concat(F.lit("The "), "r_name"))
    return x.bridge_recalled(p.select(F.col("s_suppkey").alias("question_id"), path.alias("path")), p.select(F.col("s_suppkey").alias("question_id"), bridge.alias("bridge")))


@query()
def near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIT, NEAR or MISS of each part's name among the names of its brand's other type."""
    p = table(spark, sf_dir, "part")
    golds = p.where("p_size < 10").select("p_brand", F.col("p_name").alias("gold")).distinct()
    return closest(p.where("p_size >= 10").select("p_brand", F.col("p_name").alias("name")), golds, "p_brand")


@query()
def legacy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against all turns by character sums and overlap; scores of 0 and less are dropped. The items are a stated query set."""
    v = lambda c: char_sum_vector(F.col(c))
    words = lambda name: F.array_distinct(x.tokens(F.col("text"))).alias(name)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words("words"), v("text").alias("vector"))
    kinds = dict(table(spark, sf_dir, "conversations").dtypes)
    d = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), words("words"), v("text").alias("vector"))
    return blended(d, items, ["conv_id", "turn"], 5, (0.65, 0.35)).select("query_id", *[F.col(c).cast(kinds[c]).alias(c) for c in ("conv_id", "turn")], "score", "rank")
