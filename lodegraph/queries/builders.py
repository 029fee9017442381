"""Queries of samples, services, built corpora, exports and retrieval in rounds, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import context, loops
from lodegraph.operators import graph as g
from lodegraph.operators import retrieval as r
from lodegraph.operators.durable import cached, new_folder, shared_folder
from lodegraph.plans import corpora, report
from lodegraph.registry import query
from lodegraph.sources import code, readers, samples, turtle
from lodegraph.sources.tables import GRAPH_SQL, edges, nodes, table


def key(prefix: str, column: str, name: str = "node_id"):
    return F.concat(F.lit(prefix), F.col(column).cast("string")).alias(name)


def _written(df: DataFrame, kind: str, compressed: bool = False) -> str:
    """df as JSON lines in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.option("compression", "gzip" if compressed else "none").json(path)
    return path


@query("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, l, unnest([0, len(l) - 1]) AS sent_id, unnest([0, 1]) AS k FROM s)
SELECT doc_id::VARCHAR AS question_id, k::BIGINT AS k, 'd' || doc_id AS title, sent_id, md5(l[sent_id + 1]) AS sentence FROM f""")
def fact_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose facts are named by title and sentence number, written as JSON and read with the sentences resolved."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.split("text", "\n").alias("l"))
    title, none = F.concat(F.lit("d"), "id"), F.array(F.array(F.lit("another title's only line")))
    facts = F.struct(F.array(title, title).alias("title"), F.array(F.lit(0), F.size("l") - 1).alias("sent_id"))
    held = F.struct(F.array(F.lit("other"), title).alias("title"), F.concat(none, F.array("l")).alias("sentences"))
    path = _written(d.select("id", F.lit("which?").alias("question"), F.lit("this").alias("answer"), facts.alias("supporting_facts"), held.alias("context")), "facts")
    return samples.fact_samples(spark, path, lines=True).select("question_id", "k", "title", "sent_id", F.md5("sentence").alias("sentence"))


@query("""SELECT conv_id::VARCHAR AS question_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, role AS title, md5(text) AS paragraph FROM conversations""")
def paragraph_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with paragraphs, a conversation each, written as JSON and read."""
    held = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("title"), F.col("text").alias("paragraph")))).alias("p"))
    path = _written(held.select("id", F.transform("p", lambda x: F.struct(x["title"].alias("title"), x["paragraph"].alias("paragraph"))).alias("paragraphs")), "paragraphs")
    return samples.paragraph_samples(spark, path, lines=True).select("question_id", "k", "title", F.md5("paragraph").alias("paragraph"))


@query("SELECT doc_id, md5(text) AS text, n_chars FROM documents")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as gzipped JSON lines, written and read."""
    path = _written(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), "documents", compressed=True)
    return readers.json_documents(spark, f"{path}/*.json.gz", "doc_id long, text string, n_chars long").select("doc_id", F.md5("text").alias("text"), "n_chars")


@query("""WITH e AS (SELECT 'n' || n_nationkey AS source, 'in_region' AS relation, 'r' || n_regionkey AS target FROM nation WHERE n_nationkey % 5 > 0)
SELECT source, relation, target FROM e UNION ALL SELECT target, relation, source FROM e""")
def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph in one JSON object, read with its edges both ways; an edge without a relation is none."""
    n = table(spark, sf_dir, "nation")
    edge = F.struct(key("n", "n_nationkey", "source"), F.when(F.col("n_nationkey") % 5 > 0, "in_region").otherwise("").alias("relation"), key("r", "n_regionkey", "target"))
    whole = n.agg(F.collect_list(F.struct(key("n", "n_nationkey", "id"), F.col("n_name").alias("name"))).alias("nodes"), F.collect_list(edge).alias("edges"))  # a row for each nation
    return readers.graph_json(spark, _written(whole, "graph"))[1].select("source", "relation", "target")


@query("""SELECT 'served::n' || n_nationkey AS service, 'db::Nation' AS class, 'Name,Region' AS columns, 'name,region.name' AS paths FROM nation WHERE n_nationkey % 4 < 3""")
def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service definitions in three ways of labelling columns; where labels are missing, none is read."""
    n = table(spark, sf_dir, "nation")
    start = F.concat(F.lit("|db::Nation.all()->filter(x|1 == "), F.col("n_nationkey").cast("string"), F.lit(")"))
    labelled = F.concat(start, F.lit("->project(~['Name': x|$x.name, 'Region': x|$x.region.name])"))
    labelled = F.when(F.col("n_nationkey") % 4 == 0, F.concat(start, F.lit("->project(~['Name': x|$x.name])->extend(~['Region': x|$x.region.name])"))).when(F.col("n_nationkey") % 4 == 1, F.concat(start, F.lit("->project([x|$x.name, x|$x.region.name], ['Name', 'Region'])"))).when(F.col("n_nationkey") % 4 == 2, F.concat(start, F.lit("->extend(~[Name: x|$x.name])->extend(~[Region: x|$x.region.name])"))).otherwise(F.concat(start, F.lit("->project([x|$x.name, x|$x.region.name], ['Name'])")))
    text = F.concat(F.lit("###Service\nService served::n"), F.col("n_nationkey").cast("string"), F.lit("\n{\n  pattern: '/x/{id}';\n  execution: Single { query: "), labelled, F.lit(";\n }\n}\n"))
    found = code.services(n.select(F.col("n_name").alias("path"), text.alias("value")))
    return found.select("service", "class", F.array_join("columns", ",").alias("columns"), F.array_join("paths", ",").alias("paths"))


@query("""SELECT lower('Region' || n_regionkey) AS domain, 'HAS_' || n_nationkey AS label, CASE WHEN n_nationkey % 2 = 0 THEN 'nation' ELSE 'entitynode' END AS range FROM nation""")
def rdf_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object properties of an ontology in RDF/XML."""
    n = table(spark, sf_dir, "nation")
    base = "http://x.org/o#"
    each = F.concat(F.lit(f'<owl:ObjectProperty rdf:about="{base}p'), F.col("n_nationkey").cast("string"), F.lit('"><rdfs:label>has_'), F.col("n_nationkey").cast("string"), F.lit(f'</rdfs:label><rdfs:domain rdf:resource="{base}Region'), F.col("n_regionkey").cast("string"), F.lit('"/>'), F.when(F.col("n_nationkey") % 2 == 0, F.lit(f'<rdfs:range rdf:resource="{base}Nation"/>')).otherwise(""), F.lit("</owl:ObjectProperty>"))
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'
    files = n.select(F.col("n_name").alias("path"), F.concat(F.lit(head), each, F.lit("</rdf:RDF>")).alias("value"))
    return readers.ontology(readers.rdf_xml(files))[1]


@query("""WITH k AS (SELECT s_suppkey AS k, s_nationkey AS n, s_name FROM supplier)
SELECT 'class' AS kind, 'Sup' || k AS a, NULL AS b, NULL AS c FROM k UNION ALL SELECT 'property', 'sup' || k, 'SELLS AS "' || upper(s_name) || '"; OR NOT', CASE WHEN k % 2 = 0 THEN 'nation' || n ELSE 'entitynode' END FROM k
UNION ALL SELECT 'subclass', 'Sup' || k, 'Nation' || n, NULL FROM k UNION ALL SELECT 'subclass', 'Sup' || k, 'Sup' || (k // 2), NULL FROM k UNION ALL SELECT 'restriction', 'p' || k, 'Sup' || k, NULL FROM k""")
def turtle_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Turtle file of each supplier, with prefixes, lists of predicates and objects, blank nodes, collections and literals of all kinds."""
    s = table(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    text = F.concat(
        F.lit('@prefix : <http://x.org/o#> . # the vocabulary\nPREFIX owl: <http://www.w3.org/2002/07/owl#>\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n@base <http://x.org/> .\n:Sup'), k, F.lit(" a owl:Class ;\n  rdfs:subClassOf :Nation"), n,
        F.lit(" , <o#Sup"), F.floor(F.col("s_suppkey") / 2).cast("string"), F.lit("> ;\n  rdfs:seeAlso [ a owl:Restriction ; owl:onProperty :p"), k, F.lit(" ; owl:someValuesFrom :Sup"), k,
        F.lit(' ] ;\n  rdfs:comment """two\nlines; with , and . and "quotes\\""""@en-GB , \'one\'^^<http://www.w3.org/2001/XMLSchema#string> ; :size 1.5e3 , -2 , .5 , true ; :list ( 1 [ ] ( "x" ) ) ; .\n:p'), k,
        F.lit(' a owl:ObjectProperty ; rdfs:domain :Sup'), k, F.lit(' ; rdfs:label "sells as \\"'), "s_name", F.lit('\\"; or not"@en '), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("; rdfs:range :Nation"), n)).otherwise(""), F.lit(" .\n"),
    )
    found = turtle.local_names(turtle.triples(s.select(F.concat(k, F.lit(".ttl")).alias("path"), text.alias("value"))))
    classes, properties, parents = readers.ontology(found)
    none = F.lit(None).cast("string")
    limits = found.where("p = 'onProperty'").select("s", F.col("o").alias("a")).join(found.where("p = 'someValuesFrom'").select("s", F.col("o").alias("b")), "s")
    parts = [classes.select(F.lit("class").alias("kind"), F.col("name").alias("a"), none.alias("b"), none.alias("c")), properties.select(F.lit("property"), "domain", "label", "range"), parents.select(F.lit("subclass"), "name", "parent", none), limits.select(F.lit("restriction"), "a", "b", none)]
    return reduce(DataFrame.union, parts)


@query("""WITH f AS (SELECT 'r' || (o_orderkey % 7) AS repo, o_orderkey % 5 AS place, o_orderkey % 4 AS body FROM orders),
x AS (SELECT repo, CASE body WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 1 ELSE 3 END AS lines, (body = 2)::INT AS unparsed, CASE body WHEN 1 THEN 3 ELSE 0 END AS findings FROM f WHERE place < 2)
SELECT repo, count(*) AS files, sum(lines)::BIGINT AS lines, sum(unparsed)::BIGINT AS unparsed, sum(findings)::BIGINT AS findings FROM x GROUP BY 1""")
def python_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source trees with a file of each order: code, tests and folders that don't count, files that don't parse; read back as whole files and scanned."""
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    place = pick(["/src/m", "/pkg/sub/m", "/tests/m", "/src/test_m", "/.venv/lib/m"], k % 5)
    body = pick(["x = 1\ny = 2\n", "def f(a=[]):\n    try:\n        pass\n    except:\n        pass\n", "def broken(:\n", "class A:\n    b = 1\n\n"], k % 4)
    path = F.concat(F.lit("r"), (k % 7).cast("string"), place, k.cast("string"), F.lit(".py"))
    return code.python_report(o.select(path.alias("path"), body.alias("value")), F.substring_index("path", "/", 1))


FORWARD = {"in_nation": "{s} is in {o}.", "in_region": "{s} lies in {o}."}
INVERSE = {"in_nation": "{o} has {s}.", "in_region": "{o} spans {s}."}
PLACES = """e AS (SELECT 's' || s_suppkey AS src, 'in_nation' AS rel, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'in_region', 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'called', s_name FROM supplier)"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    e = s.select(key("s", "s_suppkey", "src"), F.lit("in_nation").alias("rel"), key("n", "s_nationkey", "dst"))
    return e.union(table(spark, sf_dir, "nation").select(key("n", "n_nationkey", "src"), F.lit("in_region"), key("r", "n_regionkey", "dst"))).union(s.select(key("s", "s_suppkey", "src"), F.lit("called"), "s_name"))


@query(f"""WITH {PLACES}, k AS (SELECT *, row_number() OVER (ORDER BY src, rel, dst) - 1 AS k FROM e)
SELECT printf('fact::%06d', k) AS passage_id, CASE rel WHEN 'in_nation' THEN src || ' is in ' || dst ELSE src || ' lies in ' || dst END || '.' AS text, src || ',' || dst AS entities FROM k WHERE rel <> 'called'""")
def fact_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.12, S12: a passage for each triple, written as JSON lines and read."""
    path = new_folder(spark, "passages")
    corpora.write_passages(corpora.fact_passages(_places(spark, sf_dir), FORWARD), path)
    return samples.passages(spark, path).select("passage_id", "text", F.array_join("entities", ",").alias("entities"))


@query(f"""WITH {PLACES}, l AS (SELECT src AS subject, 0 AS way, rel, dst AS other, CASE rel WHEN 'in_nation' THEN src || ' is in ' || dst || '.' WHEN 'in_region' THEN src || ' lies in ' || dst || '.' END AS line FROM e
UNION ALL SELECT dst, 1, rel, src, CASE rel WHEN 'in_nation' THEN dst || ' has ' || src || '.' ELSE dst || ' spans ' || src || '.' END FROM e WHERE rel <> 'called')
SELECT 'entity::' || subject AS passage_id, subject || '. ' || string_agg(line, ' ' ORDER BY way, rel, other) AS text, array_to_string(list_sort(list_distinct(list_append(list(other) FILTER (line IS NOT NULL), subject))), ',') AS entities, subject FROM l GROUP BY subject""")
def entity_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.12: a passage for each entity with its facts both ways."""
    return corpora.entity_passages(_places(spark, sf_dir), FORWARD, INVERSE, ["called"]).withColumn("entities", F.array_join("entities", ","))


EXTRACTED = """x AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN ' Customer  ' || o_custkey ELSE 'CUSTOMER ' || o_custkey END AS source, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'Status ' || o_orderstatus END AS target, o_orderpriority AS relation FROM orders),
k AS (SELECT ord, trim(source) AS sn, regexp_replace(lower(trim(source)), '\\s+', ' ', 'g') AS src, CASE WHEN lower(replace(relation, ' ', '_')) = '4-not_specified' THEN 'none' ELSE lower(replace(relation, ' ', '_')) END AS rel, target AS tn, lower(target) AS dst FROM x WHERE target IS NOT NULL)"""


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    source = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" Customer  "), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("CUSTOMER "), F.col("o_custkey").cast("string")))
    target = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("Status "), "o_orderstatus"))
    chunk = F.col("o_orderkey").cast("string")
    return o.select(source.alias("source"), F.lit("buyer").alias("source_kind"), target.alias("target"), F.lit("state").alias("target_kind"), F.col("o_orderpriority").alias("relation"), chunk.alias("chunk_id"), chunk.alias("doc_id"), F.col("o_orderkey").alias("ord"))


@query(f"""WITH {EXTRACTED}, e AS (SELECT src AS node_id, sn AS name, 'buyer' AS kind, 2 * ord AS o FROM k UNION ALL SELECT dst, tn, 'state', 2 * ord + 1 FROM k)
SELECT node_id, arg_min(name, o) AS name, arg_min(kind, o) AS kind, count(*) AS mentions FROM e GROUP BY 1""")
def extracted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.12: nodes of extracted rows, merged by name."""
    return corpora.merged_triples(_extracted(spark, sf_dir), {"4-not_specified": "none"})[0]


@query(f"""WITH {EXTRACTED} SELECT src, rel, dst, min(ord)::VARCHAR AS chunk_id FROM k GROUP BY 1, 2, 3""")
def extracted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.12: edges of extracted rows, once each with where the first comes from."""
    return corpora.merged_triples(_extracted(spark, sf_dir), {"4-not_specified": "none"})[1].select("src", "rel", "dst", "chunk_id")


@query("""WITH m AS (SELECT o_custkey AS q, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders),
h AS (SELECT q, string_agg(doc_id::VARCHAR, ',' ORDER BY k) AS docs FROM m WHERE k < 16 GROUP BY 1),
r AS (SELECT c_custkey AS question_id, c_mktsegment AS category, CASE WHEN c_acctbal < 0 THEN 'I don''t know' ELSE c_name END AS answer, docs, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7|' || c_custkey), c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer JOIN h ON q = c_custkey)
SELECT question_id, category, answer, docs, CASE WHEN n > 1 AND k <= greatest(1, round_even(n * 0.3, 0)) THEN 'test' ELSE 'train' END AS split FROM r""")
def training_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.12, K10: training records with memory, split by category."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    w = g.Window.partitionBy("question_id").orderBy("doc_id")
    memory = o.select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("doc_id")).withColumn("k", F.row_number().over(w) - 1)
    questions = c.select(F.col("c_custkey").alias("question_id"), F.col("c_mktsegment").alias("category"), F.col("c_name").alias("query"), F.col("c_name").alias("answer"), (F.col("c_acctbal") < 0).alias("unanswerable"))
    records = corpora.training_records(questions, memory, o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("text")))
    out = corpora.split_records(records, 0.3, "7")
    return out.select("question_id", "category", "answer", F.array_join(F.transform("memory_doc_ids", lambda x: x.cast("string")), ",").alias("docs"), "split")


@query(f"""WITH {GRAPH_SQL} SELECT rel, count(*) AS n, (SELECT count(*) FROM nodes) AS num_nodes FROM edges GROUP BY rel""")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: the graph as JSON lines, GraphML and a manifest; what the manifest, read again, says of its relations."""
    path = new_folder(spark, "export")
    corpora.export_graph(nodes(spark, sf_dir).select("node_id", "label", F.col("type").alias("kind")), edges(spark, sf_dir), path, {"corpus": "orders"}, compression="gzip")
    m = spark.read.text(f"{path}/manifest").select(F.from_json("value", "num_nodes long, relation_distribution map<string,long>").alias("m"))
    return m.select(F.explode("m.relation_distribution").alias("rel", "n"), F.col("m.num_nodes").alias("num_nodes"))


@query("""SELECT 'r' || n_regionkey AS start, 's' || s_suppkey AS node_id FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def chain_by_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each region, by the walk's least paths that go against two relations."""
    e = _places(spark, sf_dir).where("rel <> 'called'")
    return g.chain_by_walk(e, table(spark, sf_dir, "region").select(key("r", "r_regionkey")), ["~in_region", "~in_nation"])


KEYWORDS = "['region', 'nation', 'widget', 'small', 'asia', 'contains']"


@query(f"""WITH {GRAPH_SQL}, w AS (SELECT node_id, label, list_distinct(regexp_extract_all(lower(label), '[a-z0-9]+')) AS w FROM nodes),
best AS (SELECT node_id FROM w WHERE len(list_intersect(w, {KEYWORDS})) > 0 ORDER BY len(list_intersect(w, {KEYWORDS})) / len(w)::DOUBLE DESC, node_id LIMIT 50),
f AS (SELECT e.src, e.rel, e.dst FROM edges e JOIN w a ON a.node_id = e.src JOIN w b ON b.node_id = e.dst WHERE e.src IN (FROM best) OR e.dst IN (FROM best)
  OR len(list_intersect(list_distinct(regexp_extract_all(lower(a.label || ' ' || e.rel || ' ' || b.label), '[a-z0-9]+')), {KEYWORDS})) >= 2)
SELECT DISTINCT src, rel, dst FROM f ORDER BY src, rel, dst LIMIT 50""")
def keyword_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that a question's words point to."""
    return context.keyword_subgraph(nodes(spark, sf_dir), edges(spark, sf_dir), [w.strip(" '") for w in KEYWORDS.strip("[]").split(",")])


D2 = "pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored vectors, and those of ids divisible by 50 as the stated query set; a vector's label is its text."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("node_id"), "embedding", F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"))
    return v, v.where("node_id % 50 = 0").withColumnRenamed("node_id", "query_id")


@query(f"""SELECT a.vec_id AS query_id, b.vec_id AS node_id, round(0.7 / (1 + {D2}) + 0.3 * (1 + (a.label = b.label)::INT) / 2, 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND (b.vec_id = a.vec_id + 1 OR b.vec_id = a.vec_id * 2 + 3)""")
def named_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: scores of two nodes that each query names; one that isn't stored is skipped."""
    v, q = _vectors(spark, sf_dir)
    asked = q.select("query_id", F.explode(F.array(F.col("query_id") + 1, F.col("query_id") * 2 + 3, F.lit(-1).cast("long"))).alias("node_id"))
    return loops.named_scores(asked, q, v).withColumn("score", F.round("score", 5))


@query("""WITH n AS (SELECT max(vec_id) AS top FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS node_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s) WHERE rank <= 20),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS e FROM d WHERE node_id % 3 > 0),
st AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings, n WHERE vec_id < top UNION ALL SELECT vec_id + 1, vec_id FROM embeddings, n WHERE vec_id < top),
seed AS (SELECT query_id, node_id AS seed, score FROM d WHERE rank <= 5),
one AS (SELECT DISTINCT query_id, seed, b AS node_id FROM seed JOIN st ON a = seed),
met AS (SELECT query_id, seed, node_id, 1 AS hops FROM one WHERE node_id % 3 > 0 UNION ALL SELECT DISTINCT query_id, seed, b, 2 FROM one JOIN st ON a = node_id WHERE node_id % 3 = 0 AND b % 3 > 0),
c AS (SELECT query_id, node_id, count(DISTINCT seed) AS support, min(hops) AS hops FROM met m WHERE seed <> node_id AND NOT EXISTS (SELECT 1 FROM e WHERE e.query_id = m.query_id AND e.node_id = m.node_id AND e.e <= 5) GROUP BY 1, 2),
sp AS (SELECT query_id, CASE WHEN max(score) > min(score) THEN max(score) - min(score) ELSE greatest(max(score), 0) END AS spread FROM seed GROUP BY 1),
x AS (SELECT query_id, node_id, s.score + 0.5 * least(support, 5) / 5 / hops * spread AS score FROM c JOIN s USING (query_id, node_id) JOIN sp USING (query_id) WHERE s.score >= 0.05),
x5 AS (SELECT query_id, node_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS k FROM x) WHERE k <= 5),
p AS (SELECT query_id, node_id, score, (e > 5)::INT AS class FROM e UNION ALL SELECT query_id, node_id, score, 0 FROM x5),
b AS (SELECT query_id, node_id, min((class, -score)) AS b FROM p GROUP BY 1, 2), k AS (SELECT query_id, node_id, -b[2] AS score, row_number() OVER (PARTITION BY query_id ORDER BY b, node_id) AS rank FROM b)
SELECT query_id, node_id, round(score, 5) AS score, rank FROM k WHERE rank <= 5""")
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five evidence vectors for each query, out of four times as many hits and their neighbours in a chain of ids; ids divisible by three are no evidence."""
    v, q = _vectors(spark, sf_dir)
    direct = r.nearest(v.withColumnRenamed("node_id", "vec_id"), q, 20).withColumnRenamed("vec_id", "node_id")
    n = v.select("node_id")
    chain = n.join(n.select((F.col("node_id") - 1).alias("node_id")), "node_id").select(F.col("node_id").alias("src"), F.lit("next").alias("rel"), (F.col("node_id") + 1).alias("dst"))

    def score(pairs: DataFrame) -> DataFrame:
        both = pairs.join(v.select("node_id", "embedding"), "node_id").join(q.select("query_id", F.col("embedding").alias("_q")), "query_id")
        return both.select("query_id", "node_id", r.cosine(F.col("_q"), F.col("embedding")).alias("score"))

    out = loops.retrieve(direct, chain, v.where("node_id % 3 > 0"), score, 5)
    return out.withColumn("score", F.round("score", 5))


@query("""WITH d AS (SELECT conv_id * 100 + turn AS node_id, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations), q AS (SELECT item_id AS query_id, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark),
a AS (SELECT * FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(q.w, d.w)) DESC, node_id) AS rank FROM q, d WHERE len(list_intersect(q.w, d.w)) > 0) WHERE rank <= 3),
q2 AS (SELECT query_id, list_distinct(regexp_extract_all(lower(concat_ws(' ', any_value(q.text), string_agg(d.text, ' ' ORDER BY rank))), '[a-z0-9]+')) AS w FROM q LEFT JOIN a USING (query_id) LEFT JOIN d USING (node_id) GROUP BY 1),
b AS (SELECT * FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(q2.w, d.w)) DESC, node_id) AS rank FROM q2, d WHERE len(list_intersect(q2.w, d.w)) > 0) WHERE rank <= 3)
SELECT query_id, 1::BIGINT AS step, rank, node_id FROM a UNION ALL SELECT query_id, 2, rank, node_id FROM b""")
def iterative_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, the stated query set, against all turns by shared words, then again with what was found."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("node_id"), "text")
    words = lambda df, k: df.select(k, F.explode(F.array_distinct(context.tokens(F.col("text")))).alias("w"))
    held = words(turns, "node_id")

    def search(queries: DataFrame) -> DataFrame:
        shared = held.join(words(queries, "query_id"), "w").groupBy("query_id", "node_id").agg(F.count(F.lit(1)).alias("n"))
        return r.top_k(shared, "query_id", "n", "node_id", 3)

    return loops.iterative(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), search, turns)


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS q, 'p' || l_partkey AS name FROM lineitem), a AS (SELECT q, name FROM t WHERE hash(q) IS NOT NULL AND CAST(name[2:] AS BIGINT) % 3 = 0 UNION ALL SELECT DISTINCT q, 'x' || (q % 5) FROM t UNION ALL SELECT DISTINCT q, 'y' || (q % 3) FROM t),
m AS (SELECT q, name, row_number() OVER (PARTITION BY q ORDER BY name) AS k FROM t ANTI JOIN a USING (q, name)), x AS (SELECT q, name, row_number() OVER (PARTITION BY q ORDER BY name) AS k FROM a ANTI JOIN t USING (q, name))
SELECT q AS question_id, name FROM a ANTI JOIN (SELECT q, name FROM x WHERE k <= 3) USING (q, name) UNION ALL SELECT q, name FROM m WHERE k <= 3""")
def corrected_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of an order's parts, corrected in three rounds by a model that mends one omission and one invention at a time."""
    supported = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), F.col("l_partkey").alias("part")).distinct()
    said = supported.where("part % 3 = 0").select("question_id", "name")
    wrong = lambda p, m: supported.select("question_id", F.concat(F.lit(p), (F.col("question_id") % m).cast("string")).alias("name")).distinct()

    def ask(findings: DataFrame) -> DataFrame:
        mended = F.array_union(F.array_except("answer", F.slice("extra", 1, 1)), F.slice("missing", 1, 1))
        return findings.select("question_id", F.explode(mended).alias("name"))

    return loops.corrected(said.union(wrong("x", 5)).union(wrong("y", 3)), supported.select("question_id", "name"), ask)


@query()
def constrained_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often names of a brand's parts, said as the next brand would, must be held to the brand's own."""
    p = table(spark, sf_dir, "part").select("p_brand", F.split("p_name", " ").alias("name")).distinct().groupBy("p_brand").agg(F.sort_array(F.collect_set("name")).alias("names"))
    own = p.withColumn("answer_id", F.row_number().over(g.Window.orderBy("p_brand")).cast("long"))  # a row for each brand
    said = own.select((F.col("answer_id") + 1).alias("answer_id"), F.flatten(F.transform(F.slice("names", 1, 4), lambda x, i: F.when(i > 0, F.concat(F.array(F.lit(",")), x)).otherwise(x))).alias("tokens"))
    return loops.interventions(own.join(said, "answer_id"))


ARMS = "SELECT o_orderstatus AS arm, o_totalprice / 500000 AS price, CASE WHEN o_orderstatus <> 'F' THEN o_custkey / 10000 END AS customer FROM orders"


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(status.alias("arm"), (F.col("o_totalprice") / 500000).alias("price"), F.when(status != "F", F.col("o_custkey") / 10000).alias("customer"))


@query(f"""WITH r AS (SELECT arm, avg(price) AS price, avg(customer) AS customer FROM ({ARMS}) GROUP BY 1), t AS (SELECT arm, '| ' || arm || ' | ' || printf('%.3f', price) || ' | ' || coalesce(printf('%.3f', customer), 'n/a') || ' |' AS line FROM r)
SELECT 0::BIGINT AS k, '| arm | price | customer |' AS line UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT row_number() OVER (ORDER BY arm) + 1, line FROM t""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: mean metrics by arm as Markdown, n/a where an arm has none."""
    lines = report.markdown(_arms(spark, sf_dir), "arm", ["price", "customer"]).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "k long, line string")


@query(f"""SELECT arm, round(avg(price), 6) AS price, count(*) AS n, (SELECT count(*) FROM orders) AS counted FROM ({ARMS}) GROUP BY 1""")
def run_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: a run's results with the manifest beside them, both read again."""
    path = new_folder(spark, "run")
    arms = _arms(spark, sf_dir)
    payload = arms.groupBy("arm").agg(F.round(F.avg("price"), 6).alias("price"), F.count(F.lit(1)).alias("n"))
    report.write_artifact(payload, report.manifest(spark, "prices", {"metric": "price"}, {"orders": arms.count()}), path)
    described = spark.read.text(f"{path}/manifest").select(F.get_json_object("value", "$.counts.orders").cast("long").alias("counted"))
    return spark.read.schema("arm string, price double, n long").json(f"{path}/payload").join(F.broadcast(described))  # one row


@query("""SELECT CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'dsid_' || n_nationkey END AS doc_id, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'page__' || n_nationkey END AS slug, CASE WHEN n_nationkey % 5 = 0 THEN 'unknown' ELSE 'r' || n_regionkey END AS source,
CASE WHEN n_nationkey % 5 > 1 THEN 'box' ELSE '' END AS container, 'text of ' || n_name AS text FROM nation""")
def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of a tree, named by id and title, at three depths."""
    root = new_folder(spark, "tree")
    for n in table(spark, sf_dir, "nation").collect():  # a file for each nation
        k = n.n_nationkey
        folder = ["", f"r{n.n_regionkey}/", f"r{n.n_regionkey}/box/"][min(2, k % 5)]
        name = ("none_" if k % 3 == 0 else "dsid_") + f"{k}" + ("" if k % 4 == 0 else f"__page__{k}")
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}{name}.txt")
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
        out.write(bytearray(f"text of {n.n_name}".encode()))
        out.close()
    return readers.document_tree(spark, root)


@query("""SELECT 'dsid_' || (n_nationkey % 10) AS doc_id, min('page' || n_nationkey) AS slug FROM nation GROUP BY 1""")
def first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: of each document id's files the first."""
    n = table(spark, sf_dir, "nation")
    return readers.first_files(n.select(F.concat(F.lit("dsid_"), (F.col("n_nationkey") % 10).cast("string")).alias("doc_id"), F.concat(F.lit("page"), F.col("n_nationkey").cast("string")).alias("slug")))


@query("""WITH q AS (SELECT r_regionkey AS query_id, 'who is in ' || lower(r_name) || ' or has order' || r_regionkey AS text FROM region), e AS (SELECT n_name AS src, 'within' AS rel, r_name AS dst, 'k' || n_nationkey AS chunk_id FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'order' || o_orderkey, 'placed', 'c' || o_custkey, 'o' || o_orderkey FROM orders),
k AS (SELECT 'k' || n_nationkey AS chunk_id, n_name || ' lies here' AS text FROM nation), w AS (SELECT query_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: length(x) > 3)) AS w FROM q),
m AS (SELECT DISTINCT query_id, src, rel, dst, chunk_id FROM e JOIN w ON contains(lower(src), w) OR contains(lower(dst), w) OR contains(lower(rel), w)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, rel, dst, chunk_id) AS rank FROM m) SELECT query_id, rank, src, rel, dst, r.chunk_id, coalesce(trim(substr(text, 1, 250)), 'Chunk text not found') AS snippet FROM r LEFT JOIN k ON k.chunk_id = r.chunk_id WHERE rank <= 3""")
def audit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.12: from a question to edges of its words and the text that they come from."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    questions = region.select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("who is in "), F.lower("r_name"), F.lit(" or has order"), F.col("r_regionkey").cast("string")).alias("text"))
    places = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("src"), F.lit("within").alias("rel"), F.col("r_name").alias("dst"), key("k", "n_nationkey", "chunk_id"))
    orders = table(spark, sf_dir, "orders").select(key("order", "o_orderkey", "src"), F.lit("placed").alias("rel"), key("c", "o_custkey", "dst"), key("o", "o_orderkey", "chunk_id"))
    return context.audit_links(questions, places.unionByName(orders), nation.select(key("k", "n_nationkey", "chunk_id"), F.concat("n_name", F.lit(" lies here")).alias("text")))


@query("SELECT item_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM benchmark")
def cached_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is built of a table's contents is built once, and read the second time."""
    items, folder = table(spark, sf_dir, "benchmark").select("item_id", "text"), shared_folder(spark)
    cached(items, folder, "counts", lambda df: df.select("item_id", F.size(context.tokens(F.col("text"))).cast("long").alias("n")))

    def again(df: DataFrame) -> DataFrame:
        raise AssertionError("built twice")

    return cached(items.orderBy(F.desc("item_id")), folder, "counts", again)
