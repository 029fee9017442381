"""Verdicts on a stream of generated texts: spans are parsed, joined with the newest version of the facts, and judged by their checkpoint.

A text comes with its facts nowhere near it, so each micro-batch asks the store for the newest version and joins
with that one alone; what was judged stays as it was judged. A batch writes its own folder and overwrites
it when it is tried again, so each span has one verdict. No state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.durable import new_folder
from lodegraph.operators.verify import CONTRADICTED, NOT_COVERED, SUPPORTED, key
from lodegraph.plans.store import WorldModelStore

VERDICTS = "text_id long, checkpoint long, span string, verdict string, version string, batch long"


def parsed(texts: DataFrame, relations: dict[str, str]) -> DataFrame:
    """(text_id, checkpoint, span, subject, rel, object) of texts (text_id, text): a row for each sentence, numbered from 0.

    relations: phrases and the relation that each stands for; the first phrase by order that a sentence has with something on either side
    gives its three parts. A sentence without one has none.
    """
    sentences = texts.select("text_id", F.posexplode(F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")).alias("checkpoint", "span"))
    bare = F.regexp_replace("span", r"[.!?]+$", "")
    parts = [(rel, F.split(bare, f" {phrase} ", 2)) for phrase, rel in relations.items()]
    said = F.coalesce(*[F.when((F.size(p) == 2) & (F.trim(p[0]) != "") & (F.trim(p[1]) != ""), F.struct(key(p[0]).alias("subject"), F.lit(rel).alias("rel"), key(p[1]).alias("object"))) for rel, p in parts])
    return sentences.withColumn("said", said).select("text_id", F.col("checkpoint").cast("long").alias("checkpoint"), "span", "said.subject", "said.rel", "said.object")


def judged(spans: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """spans with verdict, by the names of nodes (node_id, label) and edges (src, rel, dst).

    Without a fact of the subject and the relation a span isn't covered; the object of one supports it; any other contradicts it.
    """
    named = nodes.select(F.col("node_id"), key(F.col("label")).alias("name"))
    facts = edges.join(named.select(F.col("node_id").alias("src"), F.col("name").alias("subject")), "src").join(named.select(F.col("node_id").alias("dst"), F.col("name").alias("object")), "dst").select("subject", "rel", "object").distinct()
    known = facts.select("subject", "rel").distinct().withColumn("_k", F.lit(1))
    both = spans.join(known, ["subject", "rel"], "left").join(facts.withColumn("_f", F.lit(1)), ["subject", "rel", "object"], "left")
    return both.select(*spans.columns, F.when(F.col("_k").isNull(), NOT_COVERED).when(F.col("_f").isNull(), CONTRADICTED).otherwise(SUPPORTED).alias("verdict"))


class SpanValidation:
    """Verdicts of a stream of texts (text_id, text); `drain` takes in what has come since it was called last, and `verdicts` reads all so far."""

    def __init__(self, texts: DataFrame, relations: dict[str, str], store: WorldModelStore, source: str, model_id: str):
        self.texts, self.relations, self.store, self.source, self.model_id = texts, relations, store, source, model_id
        self.at = new_folder(texts.sparkSession, "spans")

    def _batch(self, texts: DataFrame, batch: int) -> None:
        version = self.store.list_versions(self.source)[-1]
        nodes, edges = self.store.load(self.source, version, self.model_id)
        out = judged(parsed(texts, self.relations), nodes, edges)
        out.select("text_id", "checkpoint", "span", "verdict", F.lit(version).alias("version"), F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{self.at}/out/b{batch}")

    def drain(self) -> SpanValidation:
        self.texts.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.at}/state").trigger(availableNow=True).start().awaitTermination()
        return self

    def verdicts(self) -> DataFrame:
        return self.texts.sparkSession.read.schema(VERDICTS).parquet(f"{self.at}/out/*")
