"""Questions to control packets: capture, intent, retrieval, rules, checks and fusion as one plan, a nested row for each question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators import graph as g
from lodegraph.operators import retrieval as r
from lodegraph.plans.rules import hop_type, intent


def ask(questions: DataFrame, docs: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, intent, hop_type, memories, relations, graph_weight, token_weight) of questions (query_id, text).

    docs (doc_id, text) are scored by BM25; edges name them as node ids. memories: the k best with scale-free scores;
    relations: their incident edges, each once.
    """
    scored = r.top_k(r.bm25(docs, questions).withColumn("score", F.round("score", 9)), "query_id", "score", "doc_id", k)
    best = scored.withColumn("share", F.col("score") / F.max("score").over(r.Window.partitionBy("query_id")))
    memories = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("node_id"), F.round("share", 6).alias("score")))).alias("memories"), F.avg("share").alias("m"))
    around = g.incident(edges).join(best.select("query_id", F.col("doc_id").cast("string").alias("node_id")), "node_id")
    relations = around.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("src", "rel", "dst"))).alias("relations"))
    graph, token = r.fusion_weight(F.coalesce("m", F.lit(0.0)), F.lit(1), F.coalesce(F.size("relations"), F.lit(0)))
    packet = questions.select("query_id", "text").join(memories, "query_id", "left").join(relations, "query_id", "left")
    return packet.select("query_id", intent(F.col("text")).alias("intent"), hop_type(F.col("text")).alias("hop_type"), "memories", "relations", graph.alias("graph_weight"), token.alias("token_weight"))
