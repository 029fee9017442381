"""Roles, intents, penalties and plan checks as ordered case expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.durable import kept

#: Nodes that are sent to all executors; more are joined.
SENT_NODES = 200_000
#: Keyword and role, the first that matches; keyword and intent; container kinds and their edges.
ROLES = [("date", "TEMPORAL"), ("time", "TEMPORAL"), ("key", "ID"), ("id", "ID"), ("price", "METRIC"), ("amount", "METRIC"), ("total", "METRIC"), ("quantity", "METRIC"), ("balance", "METRIC"), ("name", "LABEL"), ("status", "CATEGORY"), ("type", "CATEGORY"), ("segment", "CATEGORY")]
INTENTS = [("quartile", "window_quantile"), ("percentile", "window_quantile"), ("growth", "growth_analysis"), ("change", "growth_analysis"), ("share", "share_of_total"), ("percentage", "share_of_total"), ("top", "ranking"), ("highest", "ranking"), ("rank", "ranking"), ("how many", "count"), ("count", "count"), ("average", "average"), ("mean", "average"), ("sum", "sum"), ("total", "sum")]
CONTAINERS = [("slack", "channel", "in_channel"), ("confluence", "space", "in_space"), ("linear", "project", "in_project"), ("jira", "project", "in_project"), ("github", "repo", "in_repo"), ("gmail", "person", "authored_by"), ("google_drive", "drive", "in_drive")]
HOPS = [("born|located|country|city|capital", "geographic"), ("wrote|author|directed|written", "authorship"), ("when|year|before|after", "temporal")]


def ladder(text: Column, rungs: list[tuple[str, str]], default: str | Column) -> Column:
    """The first rung whose keyword the lower-cased text contains."""
    out, lowered = None, F.lower(text)
    for keyword, value in rungs:
        here = F.instr(lowered, keyword) > 0
        out = F.when(here, value) if out is None else out.when(here, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def semantic_role(name: Column, data_type: Column) -> Column:
    """By keyword; numbers are metrics otherwise."""
    return ladder(name, ROLES, F.when(data_type.isin("int", "bigint", "double", "float", "decimal"), "METRIC").otherwise("CATEGORY"))


def intent(question: Column) -> Column:
    return ladder(question, INTENTS, "selection")


def hop_type(question: Column) -> Column:
    lowered, out = F.lower(question), None
    for pattern, value in HOPS:
        out = F.when(lowered.rlike(pattern), value) if out is None else out.when(lowered.rlike(pattern), value)
    return out.otherwise("generic")


def container_edge(source: Column) -> Column:
    """struct(kind, rel) of a source's container."""
    out = None
    for key, kind, rel in CONTAINERS:
        value = F.struct(F.lit(kind).alias("kind"), F.lit(rel).alias("rel"))
        out = F.when(F.lower(source) == key, value) if out is None else out.when(F.lower(source) == key, value)
    return out.otherwise(F.struct(F.lit("collection").alias("kind"), F.lit("in_collection").alias("rel")))


def penalised(score: Column, node_id: Column, family: Column, penalty: float = 0.1) -> Column:
    """score times the penalty where the target family isn't in the node's id."""
    return F.when(family.isNull() | (F.instr(F.upper(node_id), F.upper(family)) > 0), score).otherwise(score * penalty)


def plan_confidence(columns: DataFrame, plan: str, role: str) -> DataFrame:
    """(plan, confidence): the product of 0.5 without a date, 0.4 without both a metric and a key, 0.7 without a metric."""
    has = lambda r: F.bool_or(F.col(role) == r)
    agg = columns.groupBy(plan).agg(has("TEMPORAL").alias("d"), has("METRIC").alias("m"), has("ID").alias("k"))
    factor = lambda ok, f: F.when(ok, 1.0).otherwise(f)
    return agg.select(plan, (factor(F.col("d"), 0.5) * factor(F.col("m") & F.col("k"), 0.4) * factor(F.col("m"), 0.7)).alias("confidence"))


def invalid_nodes(nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Nodes whose type, `concept` if missing, isn't allowed (type). Without allowed types every node is valid."""
    typed = nodes.withColumn("_t", F.coalesce(F.nullif("type", F.lit("")), F.lit("concept")))
    none = allowed.limit(1).groupBy().agg((F.count(F.lit(1)) == 0).alias("_none"))
    return typed.join(allowed.select(F.col("type").alias("_t")), "_t", "left_anti").crossJoin(none).where("not _none").drop("_t", "_none")  # one row


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (src, rel, dst), once for each pair of nodes that have their ends' ids: none if one is missing, several if nodes share an id.

    Ends are made distinct in each task before they are shuffled; those that aren't one node, few as a rule, go to the edges.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"), F.lit(0).alias("n"), F.lit(True).alias("end"))
    known = nodes.select("node_id", F.lit(1).alias("n"), F.lit(False).alias("end"))
    odd = kept(ends.union(known).groupBy("node_id").agg(F.sum("n").alias("n"), F.max("end").alias("end")).where("end and n <> 1").select("node_id", "n"))
    found = odd.limit(SENT_NODES + 1).count()
    plain = edges.where("src is not null and dst is not null").select("src", "rel", "dst")
    if not found:
        return plain
    sent = F.broadcast(odd) if found <= SENT_NODES else odd
    joined = plain.join(sent.toDF("src", "_s"), "src", "left").join(sent.toDF("dst", "_d"), "dst", "left")
    times = (F.coalesce("_s", F.lit(1)) * F.coalesce("_d", F.lit(1))).cast("int")
    return joined.select("src", "rel", "dst", F.explode(F.array_repeat(F.lit(1), times)).alias("_k")).drop("_k")


def invalid_edges(edges: DataFrame, nodes: DataFrame, triples: DataFrame) -> DataFrame:
    """Edges whose types and relation aren't among the triples (a, rel, b) in either order. Without triples every edge is valid.

    triples is an ontology, few enough to be sent. A relation that none of them has is a violation whatever the types, so only the others' edges look these up.
    """
    allowed = F.broadcast(triples.select("rel").distinct())
    none = triples.limit(1).groupBy().agg((F.count(F.lit(1)) == 0).alias("_none"))
    kind = nodes.select("node_id", F.coalesce(F.nullif("type", F.lit("")), F.lit("concept")).alias("t"))
    named = edges.join(allowed, "rel", "left_semi")
    typed = named.join(kind.withColumnsRenamed({"node_id": "src", "t": "ta"}), "src").join(kind.withColumnsRenamed({"node_id": "dst", "t": "tb"}), "dst")
    both = triples.select("a", "rel", "b").union(triples.select("b", "rel", "a")).distinct().toDF("ta", "rel", "tb")
    wrong = typed.join(F.broadcast(both), ["ta", "rel", "tb"], "left_anti").select("src", "rel", "dst")
    other = between(edges.join(allowed, "rel", "left_anti"), nodes)
    return wrong.unionByName(other).crossJoin(none).where("not _none").drop("_none")  # one row


def text_status(answer: Column, golds: Column) -> Column:
    """MISSING if blank, none or unknown; RIGHT if all golds are in it; else WRONG."""
    plain = F.lower(F.trim(answer))
    return F.when(answer.isNull() | plain.isin("", "none", "unknown"), "MISSING").when(F.forall(golds, lambda g: F.contains(plain, F.lower(g))), "RIGHT").otherwise("WRONG")
