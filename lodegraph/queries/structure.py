"""Queries of schemas, ontologies, rules, builders and exports, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import graph as g
from lodegraph.plans import builders as b
from lodegraph.plans import rules, runtime
from lodegraph.operators.durable import new_folder
from lodegraph.plans.store import WorldModelStore
from lodegraph.queries import text  # noqa: F401
from lodegraph.registry import ORACLES, query
from lodegraph.sources import code, readers
from lodegraph.sources.tables import GRAPH_SQL, edges, nodes, table


@query("SELECT 'c' || c_custkey AS src, c_mktsegment AS rel, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || c_nationkey, '~' || c_mktsegment, 'c' || c_custkey FROM customer")
def pipe_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples from text lines, both ways."""
    c = table(spark, sf_dir, "customer")
    lines = c.select(F.concat(F.lit(" c"), F.col("c_custkey").cast("string"), F.lit(" | "), "c_mktsegment", F.lit("|n"), F.col("c_nationkey").cast("string")).alias("value")).union(c.select(F.lit("two|fields")))
    return readers.pipe_triples(lines, inverse=True)


#: The kinds of events that questions may be about; any other is an error.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(f"""SELECT event_id AS question_id, CASE WHEN event_type IN ({", ".join(f"'{x}'" for x in EVENT_TYPES)}) THEN event_type ELSE error('unknown category') END AS category, 'what is ' || value AS question FROM events""")
def question_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by fallback fields, categories checked."""
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.concat(F.lit("what is "), F.col("value").cast("string")).alias("query"))
    return readers.questions(raw, EVENT_TYPES).withColumn("question_id", F.col("question_id").cast("long"))


@query(f"WITH {GRAPH_SQL} SELECT src, rel, dst FROM edges WHERE rel <> 'contains' ORDER BY 1, 2, 3")
def typed_edge_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written as tab-separated values and read again, by relation."""
    path = new_folder(spark, "edges")
    edges(spark, sf_dir).toDF("source", "metaedge", "target").write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    return readers.typed_edges(spark, path, ["in_nation", "in_region", "placed_by", "supplied_by"])


@query(f"""WITH {GRAPH_SQL}, ok AS (SELECT * FROM (VALUES ('customer', 'in_nation', 'nation'), ('region', 'in_region', 'nation'), ('order', 'placed_by', 'customer')) t(a, rel, b))
SELECT e.src, e.rel, e.dst FROM edges e JOIN nodes x ON x.node_id = e.src JOIN nodes y ON y.node_id = e.dst WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.rel = e.rel AND (ok.a = x.type AND ok.b = y.type OR ok.a = y.type AND ok.b = x.type))""")
def ontology_edge_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that no allowed triple covers in either order."""
    triples = spark.createDataFrame([("customer", "in_nation", "nation"), ("region", "in_region", "nation"), ("order", "placed_by", "customer")], "a string, rel string, b string")
    return rules.invalid_edges(edges(spark, sf_dir), nodes(spark, sf_dir), triples)


@query(f"WITH {GRAPH_SQL} SELECT node_id, type FROM nodes WHERE type NOT IN ('customer', 'order', 'part')")
def ontology_node_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of types that aren't allowed."""
    allowed = spark.createDataFrame([("customer",), ("order",), ("part",)], "type string")
    return rules.invalid_nodes(nodes(spark, sf_dir), allowed).select("node_id", "type")


@query("SELECT type, count(*) AS n FROM (" + " ".join(["SELECT 'customer' AS type FROM customer UNION ALL SELECT 'supplier' FROM supplier UNION ALL SELECT 'nation' FROM nation UNION ALL SELECT 'region' FROM region UNION ALL SELECT 'order' FROM orders UNION ALL SELECT 'part' FROM part"]) + ") GROUP BY 1")
def kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each kind."""
    return nodes(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {GRAPH_SQL} SELECT t.node_id AS node_id, CASE WHEN bool_or(h.node_id IS NOT NULL) THEN 'Movie' ELSE upper(min(t.rel)[1]) || min(t.rel)[2:] END AS kind FROM (SELECT dst AS node_id, rel FROM edges) t LEFT JOIN (SELECT DISTINCT src AS node_id FROM edges) h USING (node_id) GROUP BY 1""")
def relation_slot_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: a tail's kind by its first incoming relation; heads are Movie."""
    e = edges(spark, sf_dir)
    tails = e.groupBy(F.col("dst").alias("node_id")).agg(F.min("rel").alias("rel"))
    heads = e.select(F.col("src").alias("node_id")).distinct().withColumn("h", F.lit(1))
    return tails.join(heads, "node_id", "left").select("node_id", F.when(F.col("h") == 1, "Movie").otherwise(F.concat(F.upper(F.substring("rel", 1, 1)), F.expr("substring(rel, 2)"))).alias("kind"))


COLUMNS = [("lineitem", "l_orderkey", "bigint"), ("lineitem", "l_shipdate", "timestamp"), ("lineitem", "l_extendedprice", "double"), ("customer", "c_name", "string"), ("customer", "c_acctbal", "double"), ("customer", "c_mktsegment", "string"), ("part", "p_size", "int"), ("part", "p_type", "string"), ("region", "r_name", "string")]


@query("SELECT * FROM (VALUES ('lineitem', 'l_orderkey', 'ID'), ('lineitem', 'l_shipdate', 'TEMPORAL'), ('lineitem', 'l_extendedprice', 'METRIC'), ('customer', 'c_name', 'LABEL'), ('customer', 'c_acctbal', 'METRIC'), ('customer', 'c_mktsegment', 'CATEGORY'), ('part', 'p_size', 'METRIC'), ('part', 'p_type', 'CATEGORY'), ('region', 'r_name', 'LABEL')) t(tab, name, role)")
def semantic_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of columns by their names and types."""
    c = spark.createDataFrame(COLUMNS, "tab string, name string, type string")
    return c.select("tab", "name", rules.semantic_role(F.col("name"), F.col("type")).alias("role"))


@query("SELECT tab, confidence::DOUBLE AS confidence FROM (VALUES ('customer', 0.2), ('lineitem', 1.0), ('part', 0.2), ('region', 0.14)) t(tab, confidence)")
def plan_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each table's roles bear out a plan."""
    c = spark.createDataFrame(COLUMNS, "tab string, name string, type string").select("tab", rules.semantic_role(F.col("name"), F.col("type")).alias("role"))
    return rules.plan_confidence(c, "tab", "role").withColumn("confidence", F.round("confidence", 6))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'quartile') OR contains(lower(text), 'percentile') THEN 'window_quantile' WHEN contains(lower(text), 'growth') OR contains(lower(text), 'change') THEN 'growth_analysis' WHEN contains(lower(text), 'share') OR contains(lower(text), 'percentage') THEN 'share_of_total'
WHEN contains(lower(text), 'top') OR contains(lower(text), 'highest') OR contains(lower(text), 'rank') THEN 'ranking' WHEN contains(lower(text), 'how many') OR contains(lower(text), 'count') THEN 'count' WHEN contains(lower(text), 'average') OR contains(lower(text), 'mean') THEN 'average' WHEN contains(lower(text), 'sum') OR contains(lower(text), 'total') THEN 'sum' ELSE 'selection' END AS intent FROM documents""")
def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: the intent that a text's first keyword by the ladder tells."""
    return table(spark, sf_dir, "documents").select("doc_id", rules.intent(F.col("text")).alias("intent"))


@query("SELECT item_id, CASE WHEN regexp_matches(lower(text), 'born|located|country|city|capital') THEN 'geographic' WHEN regexp_matches(lower(text), 'wrote|author|directed|written') THEN 'authorship' WHEN regexp_matches(lower(text), 'when|year|before|after') THEN 'temporal' ELSE 'generic' END AS hop_type FROM benchmark")
def hop_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of hops that items ask for."""
    return table(spark, sf_dir, "benchmark").select("item_id", rules.hop_type(F.col("text")).alias("hop_type"))


@query("SELECT p_partkey, round(CASE WHEN contains(upper('db::' || p_type || '::' || p_brand), 'ECONOMY') THEN p_retailprice ELSE p_retailprice * 0.1 END, 6) AS score FROM part")
def relevance_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of nodes outside the target family, lowered."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(rules.penalised(F.col("p_retailprice"), F.concat_ws("::", F.lit("db"), "p_type", "p_brand"), F.lit("economy")), 6).alias("score"))


@query("""WITH a AS (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') SELECT 'c' || o_custkey AS subject, 'hypothesis' AS kind FROM a""")
def domain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of both of two relations."""
    o = table(spark, sf_dir, "orders")
    both = o.where("o_orderpriority = '1-URGENT'").select("o_custkey").intersect(o.where("o_orderstatus = 'F'").select("o_custkey"))
    return both.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("subject"), F.lit("hypothesis").alias("kind"))


@query("""SELECT l_suppkey AS subject, count(DISTINCT l_partkey) AS n FROM lineitem SEMI JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 HAVING count(DISTINCT l_partkey) BETWEEN 5 AND 600""")
def degree_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with neither too few nor too many targets."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("subject")).agg(F.countDistinct("l_partkey").alias("n")).where("n between 5 and 600")
    return n.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject")), "subject", "left_semi")


@query("SELECT label, max(spread) > 1e-6 AS informative FROM (SELECT label, dim, max(x) - min(x) AS spread FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY 1, 2) GROUP BY 1")
def slot_informativeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a label's vectors differ at all."""
    d = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg((F.max("x") - F.min("x")).alias("spread"))
    return d.groupBy("label").agg((F.max("spread") > 1e-6).alias("informative"))


@query("SELECT doc_id, regexp_matches(text, '\\b(and|und|et|y)\\b') AND NOT regexp_matches(text, '\\btoken\\b') AS valid FROM documents")
def word_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that have a required word and not a forbidden one."""
    bound = lambda w: rf"(?<![A-Za-z0-9_])(?:{w})(?![A-Za-z0-9_])"
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("text").rlike(bound("and|und|et|y")) & ~F.col("text").rlike(bound("token"))).alias("valid"))


@query("""SELECT o_orderkey, CASE WHEN trim(lower(o_orderstatus)) IN ('', 'none', 'unknown') THEN 'MISSING' WHEN contains(lower(o_orderpriority || ' ' || o_orderstatus), 'urgent') AND contains(lower(o_orderpriority || ' ' || o_orderstatus), 'f') THEN 'RIGHT' ELSE 'WRONG' END AS status FROM orders""")
def answer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: free text against all golds."""
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.text_status(F.concat_ws(" ", "o_orderpriority", "o_orderstatus"), F.array(F.lit("urgent"), F.lit("F"))).alias("status"))


@query("SELECT c_name AS label, 'CUSTOMER' AS kind, regexp_replace(c_mktsegment || ' ' || c_name, '\\s+', ' ', 'g') AS text FROM customer")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that stands for a node: label, summary and keywords, the empty left out."""
    c = table(spark, sf_dir, "customer")
    text = F.concat_ws(" ", F.nullif("c_mktsegment", F.lit("")), F.coalesce(F.nullif(F.lit(""), F.lit("")), F.nullif("c_name", F.lit(""))))
    return c.select(F.col("c_name").alias("label"), F.lit("CUSTOMER").alias("kind"), text.alias("text"))


@query("""WITH n AS (SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS key, p_name, p_type, p_partkey FROM part) SELECT key, arg_min(p_name, p_partkey) AS name, arg_min(p_type, p_partkey) AS kind, count(*) AS mentions FROM n GROUP BY 1""")
def merged_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: names merged by key, the first spelling and kind kept."""
    return b.merged_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("ord")))


@query("SELECT * FROM (SELECT conv_id || ':' || turn AS src, 'follows' AS rel, lead(conv_id || ':' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations) WHERE dst IS NOT NULL")
def sibling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between consecutive turns."""
    c = table(spark, sf_dir, "conversations").withColumn("node", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return b.siblings(c, "conv_id", "turn", "node")


@query("""SELECT a.l_partkey AS a, b.l_partkey AS b, count(DISTINCT a.l_orderkey) AS orders FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(DISTINCT a.l_orderkey) > 1""")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that stand in orders together; an order has few lines, so its pairs are few."""
    return g.together(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")))


@query(f"""WITH {GRAPH_SQL}, k AS (SELECT node_id FROM nodes WHERE type IN ('supplier', 'nation', 'region')), e AS (SELECT * FROM edges WHERE src IN (FROM k) AND dst IN (FROM k)), d AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)
SELECT node_id, degree, row_number() OVER (ORDER BY node_id) - 1 AS id FROM d""")
def view_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: a view's nodes, numbered, with their degree."""
    n, _ = b.view_export(nodes(spark, sf_dir), edges(spark, sf_dir), F.col("type").isin("supplier", "nation", "region"))
    return n


@query("SELECT (SELECT count(*) FROM orders) AS docs, (SELECT count(*) FROM lineitem) AS edges, round((SELECT count(*) FROM lineitem) / (SELECT count(*) FROM orders)::DOUBLE, 6) AS ratio, 'healthy' AS state")
def graph_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: whether a graph has edges enough."""
    return b.graph_health(edges(spark, sf_dir, ("contains",)), table(spark, sf_dir, "orders"))


#: documents with _ for letters and digits outside ASCII, beside which SQL's \\b would see a border.
_BORDERED = "(SELECT doc_id, regexp_replace(text, '[^\\P{L}A-Za-z]|[^\\P{N}0-9]', '_', 'g') AS text FROM documents)"


@query(f"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\b([A-Z][A-Z0-9]{{1,9}}-\\d{{1,6}})\\b', 1)) AS x FROM {_BORDERED}),
e AS (SELECT 'doc::' || doc_id AS src, 'in_collection' AS rel, 'collection::' || source || '::' || lang AS dst FROM documents WHERE lang <> '' UNION ALL SELECT 'doc::' || doc_id, 'references', 'ticket::' || x FROM t WHERE string_split(x, '-')[1] NOT IN ('UTF', 'ISO', 'RFC', 'SHA', 'HTTP', 'COVID'))
SELECT src, rel, dst FROM e UNION ALL SELECT dst, 'has_' || rel, src FROM e""")
def enterprise_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, §2.12: documents with their containers and tickets, both ways; none of their sources has speakers."""
    _, e = b.enterprise_graph(table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.col("lang").alias("container")))
    return e


_CHUNKS = ORACLES["text_sentence_chunks"].rpartition("\nSELECT c.doc_id")


@query(f"""{_CHUNKS[0]}, ch AS (SELECT c.doc_id{_CHUNKS[2]}),
m AS (SELECT DISTINCT doc_id, chunk, lower(x) AS x FROM (SELECT doc_id, chunk, unnest(regexp_extract_all(regexp_replace(text, '[^\\P{{L}}A-Za-z]|[^\\P{{N}}0-9]', '_', 'g'), '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\\b')) AS x FROM ch) WHERE length(x) > 3)
SELECT 'has_chunk' AS rel, count(*) AS n, 0.98::DOUBLE AS score FROM ch UNION ALL SELECT 'mentions', count(*), 0.85 FROM m UNION ALL SELECT 'mentioned_in', count(*), 0.80 FROM m""")
def document_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.12: pages, chunks and entities; edges of each kind and their weight."""
    _, e = b.document_graph(table(spark, sf_dir, "documents"))
    return e.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))


@query("""WITH t AS (SELECT lower(p_name || ' ' || p_brand) AS t, max(p_partkey) AS p FROM part GROUP BY 1), o AS (SELECT l_orderkey AS o, lower(p_name || ' ' || p_brand) AS t FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT DISTINCT 'page::' || (o + 1000000000) AS src, 'links_to' AS rel, 'page::' || p AS dst, 0.95::DOUBLE AS score FROM o JOIN t USING (t)""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.12: pages of orders with links to the pages of their parts, by title; parts of one title are one target."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("title"))
    lines = table(spark, sf_dir, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey"))
    link = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("[["), F.upper("title"), F.lit("]]"))).otherwise(F.concat(F.lit("[["), "title", F.lit("|a part]]")))
    orders = lines.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(link)), " and ").alias("text"))
    pages = orders.select((F.col("l_orderkey") + 1000000000).alias("doc_id"), F.lit(None).cast("string").alias("title"), "text").unionByName(p.select(F.col("p_partkey").cast("long").alias("doc_id"), "title", F.lit("").alias("text")))
    return b.page_links(pages)


@query("""WITH l AS (SELECT lang AS q, 'd' || doc_id AS t, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)
SELECT q AS question_id, 'article::' || t AS src, 'contains' AS rel, 'fact::' || t || '::' || i AS dst FROM l UNION ALL SELECT q, 'fact::' || t || '::' || (i - 1), 'follows', 'fact::' || t || '::' || i FROM l WHERE i > 0""")
def fact_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.12: a graph of each language's documents, their lines as facts: contains and follows."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    facts = d.select(F.col("lang").alias("question_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title"), F.posexplode(F.split("text", "\n")).alias("sent_id", "sentence"))
    return b.fact_graph(facts)[1]


@query("""SELECT DISTINCT * FROM (SELECT conv_id AS question_id, 'para::' || role AS src, 'context' AS rel, lead('para::' || role) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations) WHERE dst IS NOT NULL""")
def paragraph_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.12: a graph of each conversation, its turns as paragraphs titled by their role."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("k"), F.col("role").alias("title"), F.col("text").alias("paragraph"))
    return b.paragraph_graph(c)[1]


@query("SELECT s_suppkey AS node_id, count(*) AS degree FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def stored_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model built, saved, loaded, and asked."""
    store = WorldModelStore(spark, new_folder(spark, "models"))
    n, e = store.get_or_build("tpch", "v1", "suppliers", lambda: (nodes(spark, sf_dir).where("type = 'supplier'"), edges(spark, sf_dir, ("supplied_by",))))
    return e.join(n.select(F.col("node_id").alias("dst")), "dst").groupBy(F.expr("cast(substring(dst, 2) as bigint)").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))


CLASS_TEXT = "Class model::Base { id: Integer[1]; name: String[0..1]; }\nClass model::{T} extends model::Base { owner: model::Base[1]; code: String[1]; name: String[*]; }\n"


@query("""WITH t AS (SELECT DISTINCT 'model::' || lower(p_type) AS name FROM part) SELECT name, 'id' AS property, 'Integer' AS type, 'model::Base' AS owner FROM t UNION ALL SELECT name, 'name', 'String', name FROM t UNION ALL SELECT name, 'owner', 'model::Base', name FROM t UNION ALL SELECT name, 'code', 'String', name FROM t
UNION ALL SELECT 'model::Base', 'id', 'Integer', 'model::Base' UNION ALL SELECT 'model::Base', 'name', 'String', 'model::Base'""")
def inherited_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class models parsed from text, with what they inherit."""
    types = table(spark, sf_dir, "part").select(F.lower("p_type").alias("t")).distinct()
    files = types.select(F.concat(F.lit("f/"), "t").alias("path"), F.expr(f"replace('{CLASS_TEXT}', '{{T}}', t)").alias("value"))
    return code.inherited(code.class_models(files)).drop("distance")


@query("""SELECT DISTINCT 'model::' || lower(p_type) AS name, 'owner' AS property, 'model::Base' AS target FROM part""")
def schema_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties whose type is a class."""
    types = table(spark, sf_dir, "part").select(F.lower("p_type").alias("t")).distinct()
    files = types.select(F.concat(F.lit("f/"), "t").alias("path"), F.expr(f"replace('{CLASS_TEXT}', '{{T}}', t)").alias("value"))
    return code.resolved_types(code.class_models(files)).where("target is not null").select("name", "property", "target")


@query("SELECT 'tpch' AS database, t AS \"table\", c AS \"column\", p::BIGINT AS position FROM (VALUES ('region', 'r_regionkey', 1), ('region', 'r_name', 2), ('nation', 'n_nationkey', 1), ('nation', 'n_name', 2), ('nation', 'n_regionkey', 3)) v(t, c, p)")
def schema_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: a nested schema snapshot, flattened."""
    cols = lambda n: [(f.name, f.dataType.simpleString(), f.nullable, i, []) for i, f in enumerate(table(spark, sf_dir, n).schema.fields, 1)]
    schema = "database_name string, tables array<struct<name:string,columns:array<struct<name:string,data_type:string,is_nullable:boolean,ordinal_position:bigint,sample_values:array<string>>>>>"
    snap = spark.createDataFrame([("tpch", [("region", cols("region")), ("nation", cols("nation"))])], schema)
    return readers.schema_columns(snap).select("database", "table", "column", "position")


@query("""WITH x AS (SELECT src, dst FROM (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem)), one AS (SELECT DISTINCT src, dst FROM x), a AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM one), b AS (SELECT dst AS n, src AS m, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM one)
SELECT a.src AS start, a.dst AS via, b.m AS other FROM a JOIN b ON b.n = a.dst WHERE a.k <= 8 AND b.k <= 5 AND b.m <> a.src""")
def fanout_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: neighbours of neighbours, a fixed number at each level."""
    one = edges(spark, sf_dir, ("contains",)).select("src", "dst").distinct()
    rank = lambda by, of: F.row_number().over(g.Window.partitionBy(by).orderBy(of))
    a = one.withColumn("k", rank("src", "dst")).where("k <= 8").select(F.col("src").alias("start"), F.col("dst").alias("via"))
    c = one.withColumn("k", rank("dst", "src")).where("k <= 5").select(F.col("dst").alias("via"), F.col("src").alias("other"))
    return a.join(c, "via").where("other <> start").select("start", "via", "other")


@query()
def control_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§3.1: a control packet for every benchmark item."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text")
    links = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("src"), F.lit("in").alias("rel"), F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("dst"))
    return runtime.ask(asked, docs, links)
