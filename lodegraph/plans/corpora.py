"""Corpora and files made of graphs: passages of triples, merged extractions, training records, graph exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.operators.durable import kept, numbered


def _filled(template: Column, s: str, o: str) -> Column:
    """A template's {s} and {o} as they stand, filled in."""
    return F.replace(F.replace(template, F.lit("{s}"), F.col(s)), F.lit("{o}"), F.col(o))


def _templates(spark: SparkSession, by_relation: dict[str, str]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(by_relation.items()), "rel string, template string"))  # a row for each relation


def fact_passages(triples: DataFrame, forward: dict[str, str]) -> DataFrame:
    """(passage_id, text, entities, triple): a passage for each of triples (src, rel, dst) whose relation has a template. Numbers count all triples by src, rel, dst."""
    each = numbered(triples.select("src", "rel", "dst"), ["src", "rel", "dst"]).join(_templates(triples.sparkSession, forward), "rel")
    return each.select(F.format_string("fact::%06d", "number").alias("passage_id"), _filled(F.col("template"), "src", "dst").alias("text"), F.array("src", "dst").alias("entities"), F.array("src", "rel", "dst").alias("triple"))


def entity_passages(triples: DataFrame, forward: dict[str, str], inverse: dict[str, str], attributes: list[str]) -> DataFrame:
    """(passage_id, text, entities, subject): a passage for each end of triples: its name, what it relates to, then what relates to it, by relation and name.

    Tails of attribute relations are values: no passage says what they belong to. An entity's passage holds all of its facts, so it is as long as its degree.
    """
    spark = triples.sparkSession
    ahead = triples.select(F.col("src").alias("subject"), F.lit(0).alias("way"), "rel", F.col("dst").alias("other"))
    back = triples.where(~F.col("rel").isin(attributes)).select(F.col("dst").alias("subject"), F.lit(1).alias("way"), "rel", F.col("src").alias("other"))
    said = ahead.join(_templates(spark, forward), "rel", "left").withColumn("line", _filled(F.col("template"), "subject", "other")).unionByName(back.join(_templates(spark, inverse), "rel", "left").withColumn("line", _filled(F.col("template"), "other", "subject")))
    own = said.groupBy("subject").agg(F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("way", "rel", "other", "line")))).alias("x"))
    text = F.array_join(F.concat(F.array(F.concat("subject", F.lit("."))), F.transform("x", lambda x: x["line"])), " ")
    return own.select(F.concat(F.lit("entity::"), "subject").alias("passage_id"), text.alias("text"), F.sort_array(F.array_distinct(F.concat(F.array("subject"), F.transform("x", lambda x: x["other"])))).alias("entities"), "subject")


def write_passages(passages: DataFrame, path: str) -> None:
    """A line of JSON for each passage."""
    passages.write.json(path)


def merged_triples(rows: DataFrame, canonical: dict[str, str] | None = None, by_document: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, name, kind, mentions) and edges (src, rel, dst, source_kind, target_kind, chunk_id, doc_id) of extracted rows.

    rows (source, source_kind, target, target_kind, relation, chunk_id, doc_id, ord). A row with an empty field is none. Names merge by
    lower case and single spaces, the first spelling and kind stay; of equal edges, or equal ones of a document, the first stays with its provenance.
    """
    fields = ["source", "source_kind", "target", "target_kind", "relation"]
    whole = rows.select(*[F.trim(F.col(c)).alias(c) for c in fields], "chunk_id", "doc_id", "ord")
    for c in fields:
        whole = whole.where(F.coalesce(F.col(c), F.lit("")) != "")
    key = lambda c: F.regexp_replace(F.lower(F.col(c)), r"\s+", " ")
    rel = F.replace(F.lower("relation"), F.lit(" "), F.lit("_"))
    fixed = F.create_map(*[F.lit(x) for kv in (canonical or {"": ""}).items() for x in kv])
    keyed = whole.select(key("source").alias("src"), F.coalesce(F.try_element_at(fixed, rel), rel).alias("rel"), key("target").alias("dst"), *fields[:4], "chunk_id", "doc_id", "ord")
    ends = keyed.select(F.col("src").alias("node_id"), F.col("source").alias("name"), F.col("source_kind").alias("kind"), (2 * F.col("ord")).alias("o")).unionByName(keyed.select(F.col("dst").alias("node_id"), F.col("target").alias("name"), F.col("target_kind").alias("kind"), (2 * F.col("ord") + 1).alias("o")))
    nodes = ends.groupBy("node_id").agg(F.min_by("name", "o").alias("name"), F.min_by("kind", "o").alias("kind"), F.count(F.lit(1)).alias("mentions"))
    first = keyed.groupBy("src", "rel", "dst", *["doc_id"] * by_document).agg(F.min_by(F.struct("source_kind", "target_kind", "chunk_id", *[] if by_document else ["doc_id"]), "ord").alias("e"))
    return nodes, first.select("src", "rel", "dst", "e.source_kind", "e.target_kind", "e.chunk_id", "doc_id" if by_document else "e.doc_id")


def first_by_digest(items: DataFrame, group: str, key: str, n: Column, seed: str) -> DataFrame:
    """items with chosen: of each group the n(total) first by the digest of seed and key.

    Digests are dealt to 4096 ranges; the counts of the ranges tell in which the last of the chosen lies, and only its rows are ordered. Ties by key.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    dealt = kept(items.withColumns({"_d": digest, "_b": F.substring(digest, 1, 3)}))
    w = Window.partitionBy(group).orderBy("_b")  # at most 4096 rows to a group
    counts = dealt.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    bounds = counts.select(group, "_b", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("total")).withColumn("_want", n)
    ranked = dealt.join(bounds, [group, "_b"]).withColumn("_k", F.row_number().over(Window.partitionBy(group, "_b").orderBy("_d", key)) + F.col("_before"))
    return ranked.withColumn("chosen", F.col("_k") <= F.col("_want")).drop("_d", "_b", "_before", "_want", "_k", "total")


def training_records(questions: DataFrame, memory: DataFrame, texts: DataFrame, doc_chars: int = 1200, max_slots: int = 16) -> DataFrame:
    """(question_id, category, query, answer, memory_doc_ids, memory_texts) of questions (question_id, category, query, answer, unanswerable) with memory (question_id, k, doc_id) whose texts (doc_id, text) are known.

    The first max_slots documents count, each cut at doc_chars, which is the slot's size. Questions without an answer or without memory give no record; an unanswerable one is to be declined.
    """
    slots = memory.where(F.col("k") < max_slots).join(texts.select("doc_id", F.substring("text", 1, doc_chars).alias("text")), "doc_id")
    held = slots.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("k", "doc_id", "text"))).alias("m"))
    asked = questions.where(F.trim(F.coalesce("answer", F.lit(""))) != "")
    answer = F.when(F.col("unanswerable"), "I don't know").otherwise(F.trim("answer"))
    return asked.join(held, "question_id").select("question_id", "category", "query", answer.alias("answer"), F.transform("m", lambda x: x["doc_id"]).alias("memory_doc_ids"), F.transform("m", lambda x: x["text"]).alias("memory_texts"))


def with_distractors(records: DataFrame, share: float, seed: str) -> DataFrame:
    """records in which a share of the slots, rounded, holds another record's first text: the slots and the record are drawn by digests. A record's own documents are no distractors."""
    pool = kept(numbered(records.select(F.col("memory_doc_ids")[0].alias("_doc"), F.col("memory_texts")[0].alias("_text")).distinct(), ["_doc"]))
    n = pool.count()
    if not n:
        return records
    slot = records.select("question_id", F.posexplode("memory_doc_ids").alias("k", "own"), F.size("memory_doc_ids").alias("n"), "memory_doc_ids")
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("question_id").cast("string"), F.col("k").cast("string")))
    drawn = slot.withColumn("_k", F.row_number().over(Window.partitionBy("question_id").orderBy(order, "k"))).where(F.col("_k") <= F.bround(F.col("n") * share))
    drawn = drawn.withColumn("number", F.conv(F.substring(order, 1, 15), 16, 10).cast("long") % n).join(pool, "number").where(~F.array_contains("memory_doc_ids", F.col("_doc")))
    put = drawn.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct(F.col("_doc").alias("d"), F.col("_text").alias("t"))))).alias("put"))
    found = records.join(put, "question_id", "left")
    fill = lambda c, f: F.transform(c, lambda x, i: F.coalesce(F.try_element_at(F.col("put"), i)[f], x)).alias(c)
    return found.select(*[c for c in records.columns if not c.startswith("memory_")], fill("memory_doc_ids", "d"), fill("memory_texts", "t"))


def split_records(records: DataFrame, test_share: float, seed: str) -> DataFrame:
    """records with split, train or test: of each category the share, rounded and one at least, of all but single records are for the test."""
    n = F.when(F.col("total") > 1, F.greatest(F.lit(1), F.bround(F.col("total") * test_share))).otherwise(0)
    return first_by_digest(records, "category", "question_id", n, seed).withColumn("split", F.when(F.col("chosen"), "test").otherwise("train")).drop("chosen")


def write_split(records: DataFrame, path: str, settings: dict) -> dict:
    """train and test as JSON lines, and the manifest that says what they are; returns the manifest."""
    records.write.partitionBy("split").json(f"{path}/records")
    counts = {r.split: r.n for r in records.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    manifest = {**settings, "n_train": counts.get("train", 0), "n_test": counts.get("test", 0)}
    records.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, line): a GraphML document, its lines in order of part and id. nodes (node_id, label, kind), edges (src, rel, dst)."""
    spark = nodes.sparkSession
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    keys = "".join(f'<key id="{k}" for="{on}" attr.name="{k}" attr.type="string"/>' for k, on in (("label", "node"), ("kind", "node"), ("relation", "edge")))
    head = spark.createDataFrame([(0, "", '<?xml version="1.0" encoding="UTF-8"?>'), (1, "", f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'), (4, "", "</graph></graphml>")], "part int, id string, line string")
    node = nodes.select(F.lit(2).alias("part"), F.col("node_id").alias("id"), F.format_string('<node id="%s"><data key="label">%s</data><data key="kind">%s</data></node>', escaped("node_id"), escaped("label"), escaped("kind")).alias("line"))
    edge = edges.select(F.lit(3).alias("part"), F.concat_ws("|", "src", "rel", "dst").alias("id"), F.format_string('<edge source="%s" target="%s"><data key="relation">%s</data></edge>', escaped("src"), escaped("dst"), escaped("rel")).alias("line"))
    return head.unionByName(node).unionByName(edge)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, settings: dict, failures: dict[str, int] | None = None, compression: str = "none") -> dict:
    """nodes and edges as JSON lines, GraphML as text whose files make one document in order of their names, and a manifest, which is returned.

    The manifest has the settings, the numbers of nodes and edges, edges of each relation, the most frequent first, and how often each step failed.
    Text repeats itself much: with a compression (gzip) nodes, edges and GraphML take a small part of their size.
    """
    nodes, edges = kept(nodes), kept(edges)
    nodes.write.json(f"{path}/nodes", compression=compression)
    edges.write.json(f"{path}/edges", compression=compression)
    lines = graphml_lines(nodes, edges)
    lines.repartitionByRange("part", "id").sortWithinPartitions("part", "id").select("line").write.text(f"{path}/graphml", compression=compression)
    relations = {r.rel: r.n for r in edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rel").collect()}  # a row for each relation
    manifest = {**settings, "num_nodes": nodes.count(), "num_edges": sum(relations.values()), "relation_distribution": relations, "failures": failures or {}}
    nodes.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest
