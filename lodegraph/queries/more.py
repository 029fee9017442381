"""Queries of schema paths, nearest linking, locators, memory slots, claims and stream validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.text import collapsed
from lodegraph.operators import verify as v
from lodegraph.operators.durable import kept, new_folder
from lodegraph.plans import memory
from lodegraph.plans.store import WorldModelStore
from lodegraph.queries.structure import CLASS_TEXT
from lodegraph.registry import query
from lodegraph.sources import code
from lodegraph.sources.tables import table
from lodegraph.streaming import spans


def class_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "part").select(F.lower("p_type").alias("t")).distinct()
    return code.class_models(types.select(F.concat(F.lit("f/"), "t").alias("path"), F.expr(f"replace('{CLASS_TEXT}', '{{T}}', t)").alias("value")))


@query("""SELECT p_partkey AS path_id, CASE p_partkey % 3 WHEN 0 THEN 'String' WHEN 1 THEN 'Integer' ELSE 'model::' || lower(p_type) END AS reached, p_partkey % 3 <> 2 AS ok FROM part""")
def property_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property paths from a part's class: to a leaf, over another class, and astray."""
    steps = F.when(F.col("p_partkey") % 3 == 0, "$x.owner.name").when(F.col("p_partkey") % 3 == 1, "$x.owner.id").otherwise("$x.nothing.name")
    paths = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path_id"), F.concat(F.lit("model::"), F.lower("p_type")).alias("class"), F.split(F.regexp_extract(steps, r"\$\w+\.([A-Za-z_][\w.]*)", 1), r"\.").alias("steps"))
    return code.path_steps(class_table(spark, sf_dir), paths, 3)


@query("SELECT DISTINCT 'model::' || lower(p_type) AS name, 'owner' AS first, 'id' AS second, 'Integer' AS type FROM part")
def two_hop_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one way to an integer that a class hasn't itself."""
    return code.two_hop_routes(class_table(spark, sf_dir), ["Integer"])


@query("""WITH m AS (SELECT vec_id AS mention_id, CASE WHEN vec_id % 3 = 0 THEN 'Vec-' || vec_id ELSE 'unknown' END AS text, label AS kind, embedding FROM embeddings WHERE vec_id % 50 = 0),
x AS (SELECT mention_id, CASE WHEN text <> 'unknown' THEN 'vec ' || mention_id END AS e FROM m),
n AS (SELECT a.mention_id, max_by('vec ' || b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS node_id FROM m a JOIN embeddings b ON b.label = a.kind WHERE a.text = 'unknown' AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.72 GROUP BY 1)
SELECT mention_id, coalesce(e, node_id) AS node_id, CASE WHEN e IS NOT NULL THEN 'exact' WHEN node_id IS NOT NULL THEN 'nearest' ELSE 'unresolved' END AS how FROM x LEFT JOIN n USING (mention_id)""")
def nearest_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: names by key, others by vector within their kind. Mentions are the stated query set of ids divisible by 50."""
    e = table(spark, sf_dir, "embeddings")
    names = e.select(F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("node_id"), F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("name"), F.col("label").alias("kind"))
    asked = e.where("vec_id % 50 = 0")
    mentions = asked.select(F.col("vec_id").alias("mention_id"), F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("Vec-"), F.col("vec_id").cast("string"))).otherwise("unknown").alias("text"), F.col("label").alias("kind"))
    return v.linked_or_nearest(mentions, names, e.select(F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("node_id"), F.col("embedding").alias("v")), asked.select(F.col("vec_id").alias("mention_id"), F.col("embedding").alias("v")))


@query("""SELECT o_orderpriority AS degradation, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 100000) AS correct, count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 100000) AS wrong, count(*) FILTER (o_totalprice <= 100000) AS unresolved FROM orders GROUP BY 1""")
def linker_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes that were linked right, wrong, and not."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("degradation"), F.lit("F").alias("truth"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderstatus")).alias("found"))
    return v.confusion(o, "truth", "found", "degradation")


@query("""SELECT l_orderkey AS subject, nullif(l_partkey, 0)::VARCHAR AS object, CASE WHEN l_returnflag = 'R' THEN 'denied' ELSE 'affirmed' END AS polarity FROM lineitem WHERE l_partkey <> 0""")
def clean_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claims with both ends, their polarity put right."""
    raw = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("subject"), F.when(F.col("l_partkey") != 0, F.col("l_partkey")).cast("string").alias("object"), F.when(F.col("l_returnflag") == "R", "denied").otherwise(F.col("l_returnflag")).alias("polarity"))
    return v.clean_claims(raw).withColumn("subject", F.col("subject").cast("long"))


@query("""WITH vo AS (SELECT l_orderkey AS q, l_suppkey AS doc, count(*) AS votes FROM lineitem GROUP BY 1, 2), al AS (SELECT DISTINCT l_orderkey AS q, l_suppkey AS doc FROM lineitem WHERE l_returnflag <> 'R'), r AS (SELECT vo.*, row_number() OVER (PARTITION BY q ORDER BY votes DESC, doc) AS k FROM vo JOIN al USING (q, doc)) SELECT q, doc FROM r WHERE k = 1""")
def restricted_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's best supplier among the allowed ones."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("doc"), "l_returnflag")
    return v.located(li.groupBy("q", "doc").agg(F.count(F.lit(1)).alias("votes")), li.where("l_returnflag <> 'R'"), "q", "doc")


@query("""WITH w AS (SELECT doc_id, len(list_filter(['the', 'and', 'of', 'token'], lambda t: list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), t))) AS n FROM documents) SELECT doc_id, n >= 2 AS recalled FROM w""")
def ratio_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether half of the expected terms are present."""
    have = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)
    terms = F.array(*map(F.lit, ["the", "and", "of", "token"]))
    return table(spark, sf_dir, "documents").select("doc_id", (F.size(F.array_intersect(terms, have)) >= 2).alias("recalled"))


@query("""SELECT conv_id, min(turn) FILTER (contains(regexp_replace(text, '\\s+', ' ', 'g'), 'the ')) AS first_turn FROM conversations GROUP BY 1""")
def containment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first turn that contains a gold string."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.min(F.when(F.contains(collapsed(F.col("text")), F.lit("the ")), F.col("turn"))).alias("first_turn"))


@query("SELECT label AS qid, count(*) AS n FROM embeddings GROUP BY 1")
def memory_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots written with their digest, read back and checked."""
    slots = table(spark, sf_dir, "embeddings").select(F.col("label").alias("qid"), F.col("vec_id").alias("slot"), F.col("embedding").alias("vec"))
    path = new_folder(spark, "slots")
    memory.save(slots, path, {"model": "given"})
    return memory.load(spark, path).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, id % 97 AS a, (id * 7919) % 1009 AS b FROM range(0, 5000) t(id)""")
def synthetic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by rule."""
    return spark.range(5000).select("id", (F.col("id") % 97).alias("a"), (F.col("id") * 7919 % 1009).alias("b"))


@query("""WITH r AS (SELECT 'c' || c_custkey AS node_id, 'c' || c_custkey || ' in_nation n' || c_nationkey AS line FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey || ' placed_by c' || o_custkey FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY line) AS k FROM r) SELECT node_id, line FROM k WHERE k <= 15""")
def one_hop_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: fifteen lines around each customer."""
    from lodegraph.operators.graph import Window, incident
    from lodegraph.sources.tables import edges

    around = incident(edges(spark, sf_dir, ("in_nation", "placed_by"))).where("node_id like 'c%'").select("node_id", F.concat_ws(" ", "src", "rel", "dst").alias("line"))
    return around.withColumn("k", F.row_number().over(Window.partitionBy("node_id").orderBy("line"))).where("k <= 15").drop("k")


@query("""WITH half AS (SELECT quantile_disc(o_orderkey, 0.5) AS k FROM orders),
t AS (SELECT o_orderkey AS text_id, o_orderkey <= k AS early, c_custkey, c_name, n.n_name AS said, c_mktsegment, c_acctbal > 0 AS known, o_orderkey % 25 = c_nationkey AS fits, o_orderpriority FROM orders, half, customer, nation n WHERE c_custkey = o_custkey AND n.n_nationkey = o_orderkey % 25),
s AS (SELECT text_id, 0 AS checkpoint, c_name || ' lives in ' || said || '.' AS span, CASE WHEN early AND NOT known THEN 'NOT_COVERED' WHEN fits THEN 'SUPPORTED' ELSE 'CONTRADICTED' END AS verdict, early FROM t
  UNION ALL SELECT text_id, 1, said || ' belongs to ' || r_name || '!', CASE WHEN r_regionkey = n_regionkey THEN 'SUPPORTED' ELSE 'CONTRADICTED' END, early FROM t JOIN nation ON n_name = said JOIN region ON r_regionkey = text_id % 5
  UNION ALL SELECT text_id, 2, 'Its order is ' || o_orderpriority || '.', 'NOT_COVERED', early FROM t)
SELECT text_id, checkpoint, span, verdict, CASE WHEN early THEN 'v1' ELSE 'v2' END AS version FROM s""")
def stream_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts about all orders, judged sentence by sentence against stored facts; a second version of them comes half way, with all customers."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    key = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    things = [c.select(key("c", "c_custkey").alias("node_id"), F.col("c_name").alias("label")), n.select(key("n", "n_nationkey"), "n_name"), r.select(key("r", "r_regionkey"), "r_name")]
    known = reduce(DataFrame.union, things)
    within = n.select(key("n", "n_nationkey").alias("src"), F.lit("in_region").alias("rel"), key("r", "n_regionkey").alias("dst"))
    lives = lambda rows: rows.select(key("c", "c_custkey").alias("src"), F.lit("in_nation").alias("rel"), key("n", "c_nationkey").alias("dst"))
    store = WorldModelStore(spark, new_folder(spark, "facts"))

    said = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("o_orderkey") % 25 == F.col("n_nationkey")).join(r, F.col("o_orderkey") % 5 == F.col("r_regionkey"))
    text = F.concat(F.col("c_name"), F.lit(" lives in "), "n_name", F.lit(". "), "n_name", F.lit(" belongs to "), "r_name", F.lit("! Its order is "), "o_orderpriority", F.lit("."))
    half = table(spark, sf_dir, "orders").agg(F.expr("percentile_disc(0.5) within group (order by o_orderkey)").cast("long").alias("half"))
    texts = kept(said.join(F.broadcast(half)).select(F.col("o_orderkey").cast("long").alias("text_id"), text.alias("text"), (F.col("o_orderkey") <= F.col("half")).alias("early")))  # one row

    path = new_folder(spark, "texts")
    texts.select("text_id", "text").limit(0).write.parquet(path)  # a stream's folder has to be there
    stream = spark.readStream.schema("text_id long, text string").parquet(path)
    validation = spans.SpanValidation(stream, {"lives in": "in_nation", "belongs to": "in_region"}, store, "facts", "world")
    for version, facts, part in (("v1", lives(c.where("c_acctbal > 0")), texts.where("early")), ("v2", lives(c), texts.where("not early"))):
        store.save(known, facts.unionByName(within), "facts", version, "world")
        part.select("text_id", "text").write.mode("append").parquet(path)
        validation.drain()
    return validation.verdicts().select("text_id", "checkpoint", "span", "verdict", "version")
