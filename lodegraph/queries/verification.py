"""Queries of linking and verification, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import verify as v
from lodegraph.registry import query
from lodegraph.sources.tables import table

KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.array("p_name", "p_brand").alias("names"), F.col("p_partkey").alias("ord"))


@query(f"""WITH n AS (SELECT 'p' || p_partkey AS node_id, p_partkey AS ord, unnest([p_name, p_brand]) AS name, unnest([0, 1]) AS k FROM part), a AS (SELECT {KEY.format('name')} AS alias, node_id, ord, k FROM n)
SELECT alias, arg_min(node_id, ord * 2 + k) AS node_id FROM a WHERE length(alias) >= 3 GROUP BY 1""")
def alias_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: who owns each alias."""
    return v.alias_index(part_names(spark, sf_dir))


@query(f"""WITH d AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT name, string_split({KEY.format('name')}, ' ') AS w FROM d),
f AS (SELECT name, w[-1] AS form FROM w WHERE len(w) > 1 AND length(w[-1]) >= 4 UNION ALL SELECT name, array_to_string(list_transform(w[:-2], lambda x: x[1]), ' ') || ' ' || w[-1] FROM w WHERE len(w) > 1 AND length(w[-1]) >= 4),
o AS (SELECT form, min(name) AS name FROM f GROUP BY 1 HAVING count(DISTINCT name) = 1) SELECT form, name FROM o WHERE form NOT IN (SELECT {KEY.format('name')} FROM d)""")
def short_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: short forms that only one name has."""
    return v.short_forms(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct(), [])


@query(f"""WITH c AS (SELECT s_suppkey AS id, 'The ' || n_name || ' office of ' || s_name || ' in ' || r_name AS text FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
w AS (SELECT id, string_split({KEY.format('text')}, ' ') AS w FROM c), g AS (SELECT id, i AS pos, k AS width, array_to_string(w[i + 1:i + k], ' ') AS gram FROM (SELECT id, w, unnest(range(0, len(w))) AS i FROM w), (VALUES (1), (2), (3), (4)) t(k) WHERE i + k <= len(w)),
a AS (SELECT {KEY.format('n_name')} AS alias, 'n' || n_nationkey AS node_id FROM nation UNION ALL SELECT {KEY.format('r_name')}, 'r' || r_regionkey FROM region UNION ALL SELECT {KEY.format('s_name')}, 's' || s_suppkey FROM supplier)
SELECT id, pos, width, node_id FROM g JOIN a ON gram = alias""")
def link_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V4: nations, regions and suppliers named in generated sentences."""
    t = lambda n: table(spark, sf_dir, n)
    s = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    texts = s.select(F.col("s_suppkey").alias("id"), F.format_string("The %s office of %s in %s", "n_name", "s_name", "r_name").alias("text"))
    named = lambda n, p, k, c: t(n).select(v.key(F.col(c)).alias("alias"), F.concat(F.lit(p), F.col(k).cast("string")).alias("node_id"))
    aliases = named("nation", "n", "n_nationkey", "n_name").union(named("region", "r", "r_regionkey", "r_name")).union(named("supplier", "s", "s_suppkey", "s_name"))
    out = v.link(texts, aliases, "id", "text")
    return out.select("id", F.col("pos").cast("long").alias("pos"), F.col("width").cast("long").alias("width"), "node_id")


@query(f"""WITH RECURSIVE i AS (SELECT item_id, string_split({KEY.format('text')}, ' ') AS w FROM benchmark),
n AS (SELECT 'b' || item_id AS node_id, array_to_string(w[1:k], ' ') AS alias, item_id * 2 + 4 - k AS ord FROM i, (VALUES (4), (3)) t(k)),
a AS (SELECT alias, arg_min(node_id, ord) AS node_id FROM n WHERE length(alias) >= 3 GROUP BY 1),
d AS (SELECT doc_id, string_split({KEY.format('text')}, ' ') AS w FROM documents),
g AS (SELECT doc_id, i AS pos, k AS width, array_to_string(w[i + 1:i + k], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d), (VALUES (1), (2), (3), (4)) t(k) WHERE i + k <= len(w)),
c AS (SELECT doc_id, pos, width, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY width DESC, pos) AS k FROM g JOIN a ON gram = alias),
taken AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, []::STRUCT(pos BIGINT, width BIGINT, node_id VARCHAR)[] AS held FROM c
  UNION ALL SELECT t.doc_id, t.k + 1, CASE WHEN len(list_filter(held, lambda h: c.pos < h.pos + h.width AND h.pos < c.pos + c.width)) = 0 THEN list_append(held, {{'pos': c.pos, 'width': c.width, 'node_id': c.node_id}}) ELSE held END FROM taken t JOIN c ON c.doc_id = t.doc_id AND c.k = t.k + 1),
whole AS (SELECT doc_id, arg_max(held, k) AS held FROM taken GROUP BY 1)
SELECT doc_id, h.pos AS pos, h.width AS width, h.node_id AS node_id FROM (SELECT doc_id, unnest(held) AS h FROM whole)""")
def link_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: benchmark items, named by their first four or three words, in whole documents, longest first and without overlaps."""
    first = lambda k: F.array_join(F.slice(F.split(v.key(F.col("text")), " "), 1, k), " ")
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("node_id"), F.array(first(4), first(3)).alias("names"), F.col("item_id").alias("ord"))
    out = v.link(table(spark, sf_dir, "documents"), v.alias_index(items), "doc_id", "text")
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("width").cast("long").alias("width"), "node_id")


CLAIMS_SQL = """cl AS (SELECT o_orderkey AS claim_id, 'c' || o_custkey AS subject, 'IN_NATION' AS rel, o_orderkey % 25 AS said FROM orders),
men AS (SELECT claim_id, 'n' || said AS node_id FROM cl WHERE said > 3 UNION ALL SELECT claim_id, 'n' || c_nationkey FROM cl JOIN customer ON subject = 'c' || c_custkey WHERE said BETWEEN 10 AND 14),
ed AS (SELECT 'c' || c_custkey AS src, 'in_nation' AS rel, 'n' || c_nationkey AS dst FROM customer WHERE c_acctbal > 0)"""


def claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    cl = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), key("c", "o_custkey").alias("subject"), F.lit("IN_NATION").alias("rel"), (F.col("o_orderkey") % 25).alias("said"))
    c = table(spark, sf_dir, "customer")
    true = cl.where("said between 10 and 14").join(c.select(key("c", "c_custkey").alias("subject"), key("n", "c_nationkey").alias("node_id")), "subject").select("claim_id", "node_id")
    men = cl.where("said > 3").select("claim_id", key("n", "said").alias("node_id")).unionByName(true)
    ed = c.where("c_acctbal > 0").select(key("c", "c_custkey").alias("src"), F.lit("in_nation").alias("rel"), key("n", "c_nationkey").alias("dst"))
    return cl, men, ed


@query(f"""WITH {CLAIMS_SQL} SELECT cl.claim_id, CASE WHEN NOT EXISTS (SELECT 1 FROM ed WHERE src = subject) THEN 'NOT_COVERED' WHEN EXISTS (SELECT 1 FROM ed JOIN men ON men.node_id = dst WHERE src = subject AND men.claim_id = cl.claim_id) THEN 'SUPPORTED'
WHEN EXISTS (SELECT 1 FROM men WHERE men.claim_id = cl.claim_id) THEN 'CONTRADICTED' ELSE 'NOT_COVERED' END AS verdict FROM cl""")
def fact_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: claims of where customers are, judged with a subject and a relation."""
    cl, men, ed = claims(spark, sf_dir)
    return v.scoped_verdicts(cl.drop("said"), men, ed).select("claim_id", "verdict")


@query(f"""WITH {CLAIMS_SQL}, e2 AS (SELECT src, dst FROM ed UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), m2 AS (FROM men UNION ALL SELECT claim_id, 'r' || (said % 5) FROM cl),
far AS (SELECT DISTINCT cl.claim_id, b.dst AS node_id FROM cl JOIN e2 a ON a.src = subject JOIN e2 b ON b.src = a.dst)
SELECT cl.claim_id, CASE WHEN NOT EXISTS (SELECT 1 FROM ed WHERE src = subject) THEN 'NOT_COVERED' WHEN EXISTS (SELECT 1 FROM ed JOIN m2 ON m2.node_id = dst WHERE src = subject AND m2.claim_id = cl.claim_id) THEN 'SUPPORTED'
WHEN EXISTS (SELECT 1 FROM far JOIN m2 USING (claim_id, node_id) WHERE claim_id = cl.claim_id) THEN 'SUPPORTED' WHEN EXISTS (SELECT 1 FROM m2 WHERE m2.claim_id = cl.claim_id) THEN 'CONTRADICTED' ELSE 'NOT_COVERED' END AS verdict,
CASE WHEN NOT EXISTS (SELECT 1 FROM ed WHERE src = subject) THEN NULL WHEN EXISTS (SELECT 1 FROM ed JOIN m2 ON m2.node_id = dst WHERE src = subject AND m2.claim_id = cl.claim_id) THEN 1::BIGINT WHEN EXISTS (SELECT 1 FROM far JOIN m2 USING (claim_id, node_id) WHERE claim_id = cl.claim_id) THEN 2::BIGINT END AS hops FROM cl""")
def multi_hop_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5, V6: claims that a second hop, from nation to region, may support."""
    cl, men, ed = claims(spark, sf_dir)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    more = table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("src"), F.lit("in_region").alias("rel"), key("r", "n_regionkey").alias("dst"))
    said = men.unionByName(cl.select("claim_id", F.concat(F.lit("r"), (F.col("said") % 5).cast("string")).alias("node_id")))
    return v.scoped_verdicts(cl.drop("said"), said, ed.unionByName(more), 2)


@query("""WITH h AS (SELECT s_suppkey AS claim_id, 's' || s_suppkey AS src FROM supplier), m AS (SELECT s_suppkey AS claim_id, 'n' || (s_suppkey % 25) AS node_id FROM supplier), e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier)
SELECT claim_id, CASE WHEN EXISTS (SELECT 1 FROM e JOIN m ON m.node_id = e.dst WHERE e.src = h.src AND m.claim_id = h.claim_id) THEN 'SUPPORTED' ELSE 'NOT_COVERED' END AS verdict FROM h""")
def unscoped_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: statements without a relation."""
    s = table(spark, sf_dir, "supplier")
    key = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    e = s.select(key("s", F.col("s_suppkey")).alias("src"), key("n", F.col("s_nationkey")).alias("dst"))
    return v.unscoped_verdicts(s.select(F.col("s_suppkey").alias("claim_id"), key("s", F.col("s_suppkey")).alias("node_id")), s.select(F.col("s_suppkey").alias("claim_id"), key("n", F.col("s_suppkey") % 25).alias("node_id")), e)


BUFFER_SQL = f"""f AS (SELECT DISTINCT l_suppkey AS subject, 'sells' AS rel, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'F'),
sp AS (SELECT o_orderkey AS buffer_id, l_suppkey AS subject, 'sells' AS rel, CASE WHEN l_linenumber % 5 = 0 THEN 'nothing known' ELSE p_name END AS span FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderpriority = '1-URGENT'),
j AS (SELECT *, CASE WHEN NOT EXISTS (SELECT 1 FROM f WHERE f.subject = sp.subject) THEN 'UNLINKED' WHEN EXISTS (SELECT 1 FROM f WHERE f.subject = sp.subject AND {KEY.format('f.name')} = {KEY.format('sp.span')}) THEN 'SUPPORTED'
WHEN EXISTS (SELECT 1 FROM part WHERE {KEY.format('p_name')} = {KEY.format('sp.span')}) THEN 'NOT_IN_GRAPH' ELSE 'UNLINKED' END AS status FROM sp)"""


def spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    named = li.join(p, F.col("p_partkey") == F.col("l_partkey"))
    facts = named.where("l_linestatus = 'F'").select(F.col("l_suppkey").alias("subject"), F.lit("sells").alias("rel"), F.col("p_name").alias("name")).distinct()
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    sp = named.join(urgent, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("buffer_id"), F.col("l_suppkey").alias("subject"), F.lit("sells").alias("rel"), F.when(F.col("l_linenumber") % 5 == 0, "nothing known").otherwise(F.col("p_name")).alias("span"))
    return sp, facts, p.select(F.col("p_name").alias("name"))


@query(f"WITH {BUFFER_SQL} SELECT status, count(*) AS n, count(DISTINCT buffer_id) AS buffers FROM j GROUP BY 1")
def buffer_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of urgent orders against what their suppliers sell."""
    judged, _ = v.buffers(*spans(spark, sf_dir))
    return judged.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("buffer_id").alias("buffers"))


@query(f"WITH {BUFFER_SQL} SELECT a.buffer_id, count(*) AS omitted FROM (SELECT DISTINCT buffer_id, subject FROM sp) a JOIN f ON f.subject = a.subject WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.buffer_id = a.buffer_id AND {KEY.format('sp.span')} = {KEY.format('f.name')}) GROUP BY 1")
def buffer_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: how many facts each buffer leaves out."""
    sp, facts, _ = spans(spark, sf_dir)
    return v.omission_counts(sp, facts)


@query(f"""WITH w AS (SELECT DISTINCT string_split({KEY.format('p_name')}, ' ') AS w FROM part), i AS (SELECT w, unnest(range(0, len(w) + 1)) AS i FROM w) SELECT DISTINCT array_to_string(w[1:i], ' ') AS prefix, coalesce(w[i + 1], '<end>') AS next FROM i""")
def constraint_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which word may follow each beginning of a name."""
    return v.allowed_next(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


@query("""WITH a AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_partkey))) AS x FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), b AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_partkey))) AS y FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT id, len(list_filter(x, lambda e: NOT list_contains(y, e))) AS remove, len(list_filter(y, lambda e: NOT list_contains(x, e))) AS add FROM a JOIN b USING (id)""")
def diff_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer has too much and too little."""
    li = table(spark, sf_dir, "lineitem")
    a = li.where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("x"))
    b = li.where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("y"))
    n = lambda c: F.size(c).cast("long")
    return a.join(b, "id").select("id", n(F.array_except("x", "y")).alias("remove"), n(F.array_except("y", "x")).alias("add"))


@query("""SELECT 'n' || s_nationkey AS dst, round(sum(exp(s_acctbal / 1000 - m) * s_suppkey) / sum(exp(s_acctbal / 1000 - m)), 5) AS message FROM (SELECT *, max(s_acctbal / 1000) OVER (PARTITION BY s_nationkey) AS m FROM supplier) GROUP BY 1""")
def softmax_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages to each nation from its suppliers, by the softmax of their balances."""
    e = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"), (F.col("s_acctbal") / 1000).alias("score"), F.col("s_suppkey").cast("double").alias("value"))
    return v.softmax_messages(e, "score", "value").withColumn("message", F.round("message", 5))


@query("""SELECT l_orderkey AS claim, max(l_discount) AS entail, max(l_tax) AS contradict, round(max(l_discount) - max(l_tax), 6) AS truth FROM lineitem GROUP BY 1""")
def passage_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maxima over passages."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_discount").alias("entail"), F.col("l_tax").alias("contradict"))
    return v.passage_votes(s, "claim").withColumn("truth", F.round("truth", 6))


def _polarity_sql(mention: str) -> str:
    cues = "|".join(v.CUES)
    return f"""CASE WHEN instr(lower(t), lower({mention})) > 0 THEN CASE WHEN len(regexp_extract_all(regexp_split_to_array(substr(lower(t), 1, instr(lower(t), lower({mention})) - 1), ' but | however | although |;|\\.|,')[-1], '\\b(?:{cues})\\b')) % 2 = 1 THEN 'denied' ELSE 'affirmed' END END"""


@query(f"""WITH e AS (SELECT event_id, event_type, 'The user did not ' || event_type || CASE WHEN value > 20 THEN ', but was seen without an error' ELSE ' without cause' END AS t FROM events)
SELECT event_id, {_polarity_sql("event_type")} AS event, {_polarity_sql("'error'")} AS error FROM e""")
def negation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sentences about events deny them."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("The user did not "), "event_type", F.when(F.col("value") > 20, F.lit(", but was seen without an error")).otherwise(F.lit(" without cause")))
    return e.select("event_id", v.polarity(text, F.col("event_type")).alias("event"), v.polarity(text, F.lit("error")).alias("error"))
