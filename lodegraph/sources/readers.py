"""Readers of the formats that corpora, graphs and questions come in. All list and open files through Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.sources.turtle import local_names, triples


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Line-delimited for .jsonl and any .gz, blank lines skipped; a list or one object for .json; else an error."""
    if path.endswith((".jsonl", ".gz")):
        reader = spark.read
    elif path.endswith(".json"):
        reader = spark.read.option("multiLine", True)
    else:
        raise ValueError(f"not a JSON document file: {path}")
    return (reader.schema(schema) if schema else reader).json(path)


def document_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, slug, source, container, text) of all .txt below folder.

    source is the first folder or `unknown`, container the second if there are three levels;
    the name splits at its first `__`; an id that doesn't begin with dsid_ is empty.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    root = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    place = F.split(F.substring_index(F.input_file_name(), root + "/", -1), "/")
    name = F.regexp_replace(F.element_at(place, -1), r"\.txt$", "")
    parts = raw.select(F.col("value").alias("text"), place.alias("p"), name.alias("name"))
    head = F.substring_index("name", "__", 1)
    return parts.select(
        F.when(head.startswith("dsid_"), head).otherwise("").alias("doc_id"),
        F.when(F.instr("name", "__") > 0, F.expr("substring(name, instr(name, '__') + 2)")).otherwise("").alias("slug"),
        F.when(F.size("p") > 1, F.get("p", F.lit(0))).otherwise("unknown").alias("source"),
        F.when(F.size("p") > 2, F.get("p", F.lit(1))).otherwise("").alias("container"),
        "text",
    )


def first_files(tree: DataFrame) -> DataFrame:
    """(doc_id, slug): of each id's files the first by name."""
    return tree.where("doc_id <> ''").groupBy("doc_id").agg(F.min("slug").alias("slug"))


QUESTION_FIELDS = {"question_id": ["question_id", "id"], "category": ["question_type", "category", "type"], "question": ["question", "query"]}


def questions(raw: DataFrame, known: list[str]) -> DataFrame:
    """(question_id, category, question) by the first field that is there; an unknown category is an error."""
    def first(names: list[str]) -> Column:
        there = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in raw.columns]
        return F.coalesce(*there) if there else F.lit(None).cast("string")

    out = raw.select(*[first(names).alias(k) for k, names in QUESTION_FIELDS.items()])
    checked = F.when(F.col("category").isin(known), F.col("category")).otherwise(F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce("category", F.lit("none")))))
    return out.withColumn("category", checked)


def pipe_triples(lines: DataFrame, strip: bool = True, inverse: bool = False) -> DataFrame:
    """(src, rel, dst) of lines (value) with three fields between pipes; others are skipped."""
    parts = F.split("value", r"\|")
    field = (lambda i: F.trim(F.get("p", F.lit(i)))) if strip else (lambda i: F.get("p", F.lit(i)))
    out = lines.select(parts.alias("p")).where("size(p) = 3").select(*[field(i).alias(n) for i, n in enumerate(("src", "rel", "dst"))])
    if inverse:
        out = out.unionByName(out.select(F.col("dst").alias("src"), F.concat(F.lit("~"), "rel").alias("rel"), F.col("src").alias("dst")))
    return out


def typed_edges(spark: SparkSession, path: str, kept: list[str] | None = None) -> DataFrame:
    """(src, rel, dst) of a tab-separated edge list with a header, gzipped or not."""
    raw = spark.read.option("sep", "\t").option("header", True).schema("source string, metaedge string, target string").csv(path)
    out = raw.select(F.col("source").alias("src"), F.col("metaedge").alias("rel"), F.col("target").alias("dst"))
    return out.where(F.col("rel").isin(kept)) if kept is not None else out


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes, and edges in both orientations; edges without a source, relation or target are dropped."""
    schema = "nodes array<struct<id:string,name:string,kind:string,count:long>>, edges array<struct<source:string,relation:string,target:string,source_doc_id:string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    nodes = raw.select(F.explode("nodes").alias("n")).select("n.*")
    edges = raw.select(F.explode("edges").alias("e")).select("e.*").where("source <> '' and relation <> '' and target <> ''")
    back = edges.select(F.col("target").alias("source"), "relation", F.col("source").alias("target"), "source_doc_id")
    return nodes, edges.unionByName(back)


def turtle(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes, object properties (domain, label, range; EntityNode by default) and subclasses of Turtle files (value, and path if there is one)."""
    return ontology(local_names(triples(files if "path" in files.columns else files.withColumn("path", F.lit("")))))


def ontology(t: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes, object properties and subclasses of triples (s, p, o) of local names."""
    is_a = t.where("p in ('type', 'a')")
    classes = is_a.where("o = 'Class'").select(F.col("s").alias("name")).distinct()
    value = lambda p, n: t.where(F.col("p") == p).groupBy("s").agg(F.min("o").alias(n))
    props = is_a.where("o = 'ObjectProperty'").select("s").distinct().join(value("domain", "domain"), "s", "left").join(value("range", "range"), "s", "left").join(value("label", "label"), "s", "left")
    props = props.select(F.lower(F.coalesce("domain", F.lit("EntityNode"))).alias("domain"), F.upper(F.coalesce("label", "s")).alias("label"), F.lower(F.coalesce("range", F.lit("EntityNode"))).alias("range"))
    return classes, props, t.where("p = 'subClassOf'").select(F.col("s").alias("name"), F.col("o").alias("parent"))


def rdf_xml(files: DataFrame) -> DataFrame:
    """(s, p, o) of RDF/XML files (path, value): local names of subjects, predicates, resources and literals. Typed and nested nodes count; a file that is no XML is an error."""
    rdf = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
    local = lambda x: x.replace("}", "#").replace("/", "#").rsplit("#", 1)[-1].rsplit(":", 1)[-1]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        def node(element, rows: list) -> str:
            """The subject's name; its statements go to rows."""
            name = local(element.get(f"{rdf}about") or element.get(f"{rdf}ID") or element.get(f"{rdf}nodeID") or f"_{len(rows)}")
            if element.tag != f"{rdf}Description":
                rows.append((name, "type", local(element.tag)))
            for x in element:
                value = x.get(f"{rdf}resource") or x.get(f"{rdf}nodeID")
                rows.append((name, local(x.tag), local(value) if value else node(x[0], rows) if len(x) else (x.text or "").strip()))
            return name

        for f in frames:
            rows: list = []
            for text in f["value"]:
                for element in ElementTree.fromstring(text):
                    node(element, rows)
            yield pd.DataFrame(rows, columns=["s", "p", "o"])

    return files.select("path", "value").mapInPandas(parse, "s string, p string, o string")


def schema_columns(snapshot: DataFrame) -> DataFrame:
    """(database, table, column, data_type, nullable, position, samples) of nested schema snapshots."""
    t = snapshot.select("database_name", F.explode("tables").alias("t")).select("database_name", "t.name", F.explode("t.columns").alias("c"))
    return t.select(F.col("database_name").alias("database"), F.col("name").alias("table"), F.col("c.name").alias("column"), F.col("c.data_type").alias("data_type"), F.col("c.is_nullable").alias("nullable"), F.col("c.ordinal_position").alias("position"), F.col("c.sample_values").alias("samples"))
