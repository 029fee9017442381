"""Corpus builders: documents and tables to nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import text as t
from lodegraph.operators.durable import numbered
from lodegraph.plans.rules import container_edge


def document_graph(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = 256, overlap: int = 32) -> tuple[DataFrame, DataFrame]:
    """Page, chunk and entity nodes; has_chunk .98, mentions .85 and mentioned_in .80 edges. Entities are capitalised runs by lower-cased, underscored id."""
    base = docs.select(F.concat(F.lit("page::"), F.col(id_col).cast("string")).alias("page"), F.col(text_col).alias("text"))
    chunks = base.select("page", F.posexplode(t.sentence_chunks(F.col("text"), chunk_words, overlap)).alias("k", "chunk")).select("page", F.concat_ws("::", "page", F.lit("chunk"), F.col("k").cast("string")).alias("node_id"), "chunk")
    found = chunks.select("node_id", F.explode(t.title_runs(F.col("chunk"))).alias("label")).select("node_id", "label", F.concat(F.lit("entity::"), t.node_id_key(F.col("label"))).alias("entity")).dropDuplicates(["node_id", "entity"])
    entities = found.groupBy("entity").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("mentions"))
    nodes = base.select(F.col("page").alias("node_id"), F.lit("page").alias("type"), F.col("page").alias("label")).unionByName(chunks.select("node_id", F.lit("chunk").alias("type"), F.substring("chunk", 1, 80).alias("label"))).unionByName(entities.select(F.col("entity").alias("node_id"), F.lit("entity").alias("type"), "label"))
    edge = lambda d, a, rel, b, w: d.select(F.col(a).alias("src"), F.lit(rel).alias("rel"), F.col(b).alias("dst"), F.lit(w).alias("score"))
    edges = [edge(chunks, "page", "has_chunk", "node_id", 0.98), edge(found, "node_id", "mentions", "entity", 0.85), edge(found, "entity", "mentioned_in", "node_id", 0.80)]
    return nodes, reduce(DataFrame.unionByName, edges)


def page_links(docs: DataFrame, most: int = 100) -> DataFrame:
    """(src, rel, dst, score) of docs (doc_id, title, text): links_to edges from a page to those whose titles its first `most` [[links]] name, whatever their case, at .95; once each, and none to itself.

    Of pages with one title the one with the greatest doc_id is meant. Titles are joined, so no map of them is held anywhere.
    """
    page = F.concat(F.lit("page::"), F.col("doc_id").cast("string"))
    titled = docs.where("title is not null").groupBy(F.lower("title").alias("t")).agg(F.max("doc_id").alias("doc_id")).select("t", page.alias("dst"))
    named = docs.select(page.alias("src"), F.explode(F.array_distinct(F.transform(F.slice(t.wiki_links(F.col("text")), 1, most), lambda x: F.lower(x)))).alias("t"))
    return named.join(titled, "t").where("src <> dst").select("src", F.lit("links_to").alias("rel"), "dst", F.lit(0.95).alias("score")).distinct()


def fact_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each question's own graph, facts (question_id, title, sent_id, sentence): articles contain their facts, and a fact follows the one before it of its article."""
    once = facts.groupBy("question_id", "title", "sent_id").agg(F.first("sentence").alias("sentence"))
    article, fact = F.concat(F.lit("article::"), "title"), F.concat_ws("::", F.lit("fact"), "title", F.col("sent_id").cast("string"))
    nodes = once.select("question_id", article.alias("node_id"), F.lit("article").alias("type"), F.col("title").alias("text")).distinct().unionByName(once.select("question_id", fact.alias("node_id"), F.lit("fact").alias("type"), F.col("sentence").alias("text")))
    held = once.select("question_id", article.alias("src"), F.lit("contains").alias("rel"), fact.alias("dst"))
    nxt = F.lead(fact).over(Window.partitionBy("question_id", "title").orderBy("sent_id"))
    return nodes, held.unionByName(once.select("question_id", fact.alias("src"), F.lit("follows").alias("rel"), nxt.alias("dst")).where("dst is not null"))


def paragraph_graph(paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each question's own graph, paragraphs (question_id, k, title, paragraph): a context edge leads from each to the next by k. Paragraphs of one title are one node, with the last one's text."""
    name = F.concat(F.lit("para::"), F.coalesce("title", F.concat(F.lit("para-"), F.col("k").cast("string"))))
    nodes = paragraphs.groupBy("question_id", name.alias("node_id")).agg(F.max_by("paragraph", "k").alias("text"))
    nxt = F.lead(name).over(Window.partitionBy("question_id").orderBy("k"))
    return nodes, paragraphs.select("question_id", name.alias("src"), F.lit("context").alias("rel"), nxt.alias("dst")).where("dst is not null").distinct()


def enterprise_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text, source, container) with container, ticket and speaker edges, each with its reverse has_<rel>."""
    doc = F.concat(F.lit("doc::"), F.col("doc_id").cast("string"))
    kind = container_edge(F.col("source"))
    held = docs.where("container <> ''").select(doc.alias("src"), kind["rel"].alias("rel"), F.concat_ws("::", kind["kind"], "source", "container").alias("dst"), kind["kind"].alias("type"))
    named = docs.select(doc.alias("src"), F.explode(t.tickets(F.col("text"))).alias("x")).select("src", F.lit("references").alias("rel"), F.concat(F.lit("ticket::"), "x").alias("dst"), F.lit("ticket").alias("type"))
    said = docs.where(F.lower("source").isin("slack", "fireflies")).select(doc.alias("src"), F.explode(t.speakers(F.col("text"))).alias("x")).select("src", F.lit("spoken_by").alias("rel"), F.concat(F.lit("person::"), t.node_id_key(F.col("x"))).alias("dst"), F.lit("person").alias("type"))
    ahead = held.unionByName(named).unionByName(said).distinct()
    edges = ahead.select("src", "rel", "dst").unionByName(ahead.select(F.col("dst").alias("src"), F.concat(F.lit("has_"), "rel").alias("rel"), F.col("src").alias("dst")))
    nodes = docs.select(doc.alias("node_id"), F.lit("document").alias("type")).unionByName(ahead.select(F.col("dst").alias("node_id"), "type").distinct())
    return nodes, edges


def merged_names(mentions: DataFrame) -> DataFrame:
    """(key, name, kind, mentions) of (name, kind, ord): names by their normalised key; the first spelling and kind stay."""
    k = F.trim(F.regexp_replace(F.lower("name"), r"\s+", " "))
    return mentions.groupBy(k.alias("key")).agg(F.min_by("name", "ord").alias("name"), F.min_by("kind", "ord").alias("kind"), F.count(F.lit(1)).alias("mentions"))


def siblings(items: DataFrame, group: str, order: str, node: str, rel: str = "follows") -> DataFrame:
    """Edges from each item to the next of its group."""
    nxt = F.lead(node).over(Window.partitionBy(group).orderBy(order))
    return items.select(F.col(node).alias("src"), F.lit(rel).alias("rel"), nxt.alias("dst")).where("dst is not null")


def view_export(nodes: DataFrame, edges: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """Nodes that hold keep and have an edge within the view, numbered from 0 by id, with their degree; edges by number."""
    seen = nodes.where(keep).select("node_id")
    inner = edges.join(seen.withColumnRenamed("node_id", "src"), "src", "left_semi").join(seen.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "rel", "dst")
    ends = inner.select(F.col("src").alias("node_id")).union(inner.select("dst")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    ids = numbered(ends, ["node_id"]).select("node_id", "degree", F.col("number").alias("id"))
    at = ids.select("node_id", "id")
    out = inner.join(at.toDF("src", "source"), "src").join(at.toDF("dst", "target"), "dst").select("source", "rel", "target")
    return ids, out


def graph_health(edges: DataFrame, docs: DataFrame, low: float = 0.5) -> DataFrame:
    """One row: documents, edges, edges to a document, and empty, sparse or healthy."""
    e, d = edges.agg(F.count(F.lit(1)).alias("edges")), docs.agg(F.count(F.lit(1)).alias("docs"))
    ratio = F.when(F.col("docs") > 0, F.col("edges") / F.col("docs")).otherwise(0.0)
    return e.crossJoin(d).select("docs", "edges", F.round(ratio, 6).alias("ratio"), F.when(ratio == 0, "empty").when(ratio < low, "sparse").otherwise("healthy").alias("state"))  # one row each
