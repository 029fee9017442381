"""Contexts and answers drawn from the graph: paths to terms, subgraphs, guided facts, retrieval with expansion, plan scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import normalize_answer, tokens
from lodegraph.operators.durable import kept
from lodegraph.operators.graph import incident
from lodegraph.operators.retrieval import QUERY_BLOCK


def paths_to_terms(edges: DataFrame, nodes: DataFrame, starts: DataFrame, terms: list[str], depth: int = 4, width: int = 20) -> DataFrame:
    """(start, node_id, hops, path, matches): simple paths to nodes (node_id, label, and summary if there is one) that have a term in either, the shortest and best matching first. Nothing but the first `width` is the feature.

    A longer path is looked for only while there are fewer than `width`, and a path goes on only where it can still reach a match: the nodes near matches are plain sets, each found when a
    path first has to go on. Edges meet the matches and the ends of paths before they meet the paths, so that where either is a small table the edges aren't shuffled.
    """
    said = F.concat_ws(" ", "label", *(["summary"] if "summary" in nodes.columns else []))
    hit = kept(nodes.select("node_id", F.size(F.array_intersect(F.array_distinct(tokens(said)), F.array(*[F.lit(t) for t in terms]))).cast("long").alias("matches")).where("matches > 0"))
    step = incident(edges).select("node_id", "other")
    near = [hit.select("node_id")]
    paths = kept(starts.select(F.col("node_id").alias("start"), "node_id", F.array("node_id").alias("path")).distinct())
    found: list[DataFrame] = []

    def grown(front: DataFrame, ends: DataFrame | None) -> DataFrame:
        along = step.join(front, "node_id", "left_semi")
        if ends is not None:
            along = along.join(ends.withColumnRenamed("node_id", "other"), "other", "left_semi")
        more = paths.join(along, "node_id").where(~F.array_contains("path", F.col("other")))
        return more.select("start", F.col("other").alias("node_id"), F.concat("path", F.array("other")).alias("path")).distinct()

    for hop in range(1, depth + 1):
        left, front = depth - hop, kept(paths.select("node_id").distinct())
        matched = grown(front, hit.select("node_id")).join(hit, "node_id").select("start", "node_id", F.lit(hop).cast("long").alias("hops"), F.array_join("path", ">").alias("path"), "matches")
        found.append(kept(matched))
        if not left or found[-1].count() >= width:
            break
        while left < min(3, depth) and len(near) <= left:
            near.append(kept(near[-1].join(step, "node_id").select(F.col("other").alias("node_id")).union(near[-1]).distinct()))
        paths = kept(grown(front, near[left] if left < len(near) else None))
        if paths.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).orderBy("hops", F.desc("matches"), "path").limit(width)


def bridge_recalled(paths: DataFrame, gold: DataFrame) -> DataFrame:
    """(question_id, recalled) for gold (question_id, bridge): whether a label on the question's path, paths (question_id, path array of labels), has the bridge's name within it, both normalised; not without a bridge."""
    name = normalize_answer(F.col("bridge"))
    on = F.exists(F.coalesce("path", F.array().cast("array<string>")), lambda x: F.contains(normalize_answer(x), name))
    return gold.join(paths, "question_id", "left").groupBy("question_id").agg(F.bool_or(F.coalesce(F.col("bridge").isNotNull() & on, F.lit(False))).alias("recalled"))


def plan_scores(gold: DataFrame, plans: DataFrame) -> DataFrame:
    """(question_id, table_recall, path_accuracy, bridge_recall, correct) of plans (question_id, tables, path) by gold (question_id, tables, path, bridges); arrays, a path's steps written a->b, names compared in lower case and without their schema `public`.

    Bridges of a plan are the tables inside its path, in the order in which they first appear, that it also lists. Without a gold path a plan is right by having none.
    """
    low = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.replace(F.lower(F.trim(x)), F.lit("public."), F.lit(""))))
    steps = lambda c: F.filter(low(c), lambda x: F.contains(x, F.lit("->")))
    share = lambda a, b, none: F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(b)).otherwise(none)
    g = gold.select("question_id", low(F.col("tables")).alias("gt"), low(F.col("path")).alias("gp"), low(F.col("bridges")).alias("gb"))
    p = plans.select("question_id", low(F.col("tables")).alias("pt"), steps(F.col("path")).alias("pp"))
    both = g.join(p, "question_id", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("pt", "pp")})
    order = F.array_distinct(F.transform(F.flatten(F.transform("pp", lambda x: F.split(x, "->", 2))), lambda x: F.trim(x)))
    inner = F.when(F.size("o") > 2, F.slice("o", 2, F.greatest(F.size("o") - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    scored = both.withColumn("o", order).withColumns({"table_recall": share(F.col("pt"), F.col("gt"), F.lit(1.0)), "path_accuracy": share(F.col("pp"), F.col("gp"), F.when(F.size("pp") == 0, 1.0).otherwise(0.0)), "bridge_recall": share(F.array_intersect(inner, "pt"), F.col("gb"), F.lit(1.0))})
    return scored.select("question_id", "table_recall", "path_accuracy", "bridge_recall", ((F.col("table_recall") == 1) & (F.col("path_accuracy") == 1)).alias("correct"))


def bridge(path: Column) -> Column:
    """The middle of a path of three nodes or more."""
    return F.when(F.size(path) >= 3, F.get(path, F.floor(F.size(path) / 2).cast("int")))


def subgraph(edges: DataFrame, seeds: DataFrame, near: int = 10, most: int | None = None) -> DataFrame:
    """(src, rel, dst): edges at the seeds, then those at the seeds' first `near` neighbours by id; each once."""
    around = incident(edges)
    first = around.join(seeds.select("node_id").distinct(), "node_id")
    others = first.select(F.col("other").alias("node_id")).distinct().join(seeds.select("node_id"), "node_id", "left_anti").orderBy("node_id").limit(near)
    second = around.join(others, "node_id")
    both = first.select("src", "rel", "dst", F.lit(0).alias("_o")).unionByName(second.select("src", "rel", "dst", F.lit(1).alias("_o"))).groupBy("src", "rel", "dst").agg(F.min("_o").alias("_o"))
    return (both if most is None else both.orderBy("_o", "src", "rel", "dst").limit(most)).select("src", "rel", "dst")


def keyword_subgraph(nodes: DataFrame, edges: DataFrame, words: list[str], most: int = 50, few: int = 10) -> DataFrame:
    """(src, rel, dst): at most `most` edges of the question's words, at one of the nodes whose labels (node_id, label) have the largest share of words in the question, or with two of its words in their own names.

    With fewer than `few`, the first edges instead. Edges come by src, rel, dst.
    """
    asked = F.array(*map(F.lit, sorted(set(words))))
    own = F.array_distinct(tokens(F.col("label")))
    best = nodes.select("node_id", (F.size(F.array_intersect(own, asked)) / F.size(own)).alias("s")).where("s > 0").orderBy(F.desc("s"), "node_id").limit(most).select("node_id")
    at = lambda c: edges.join(F.broadcast(best.withColumnRenamed("node_id", c)), c, "left_semi").select("src", "rel", "dst")
    name = lambda c: nodes.select(F.col("node_id").alias(c), F.col("label").alias(f"{c}_label"))
    near = kept(at("src").union(at("dst")).distinct().orderBy("src", "rel", "dst").limit(most))
    # of the others only those can be found that come before the last of enough near ones: they alone meet the labels
    last = near.agg(F.when(F.count(F.lit(1)) >= most, F.max(F.struct("src", "rel", "dst"))).alias("_last"))
    ahead = edges.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.struct("src", "rel", "dst") <= F.col("_last"))).drop("_last")  # one row
    named = ahead.join(name("src"), "src", "left").join(name("dst"), "dst", "left")
    said = F.concat_ws(" ", F.coalesce("src_label", "src"), "rel", F.coalesce("dst_label", "dst"))
    worded = named.where(F.size(F.array_intersect(F.array_distinct(tokens(said)), asked)) >= 2).select("src", "rel", "dst")
    found = near.union(worded).distinct().orderBy("src", "rel", "dst").limit(most)
    found = kept(found)
    return found if found.count() >= few else edges.select("src", "rel", "dst").distinct().orderBy("src", "rel", "dst").limit(most)


def audit_links(questions: DataFrame, edges: DataFrame, chunks: DataFrame, most: int = 3, chars: int = 250) -> DataFrame:
    """(query_id, rank, src, rel, dst, chunk_id, snippet): for each of questions (query_id, text) the first `most` edges (src, rel, dst, chunk_id), by themselves, that hold one of its words, with the text that they come from (chunk_id, text).

    Words have more than three characters and may stand inside of names. The questions are a stated query set: blocks of them meet all edges.
    """
    asked = questions.select("query_id", F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 3)).alias("words"))
    n = max(1, -(-asked.count() // QUERY_BLOCK))
    lowered = edges.select("src", "rel", "dst", "chunk_id", F.array(F.lower("src"), F.lower("dst"), F.lower("rel")).alias("_in"))
    w = Window.partitionBy("query_id").orderBy("src", "rel", "dst", "chunk_id")
    parts = []
    for b in range(n):
        own = F.broadcast(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b))
        met = lowered.join(own, F.exists("words", lambda x: F.exists(F.col("_in"), lambda y: F.contains(y, x))))
        parts.append(met.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most).drop("_in", "words"))
    snippet = F.coalesce(F.trim(F.substring("text", 1, chars)), F.lit("Chunk text not found")).alias("snippet")
    return reduce(DataFrame.unionByName, parts).join(chunks.select("chunk_id", "text"), "chunk_id", "left").select("query_id", "rank", "src", "rel", "dst", "chunk_id", snippet)


def guided_facts(edges: DataFrame, starts: DataFrame, relations: list[str], hops: int) -> DataFrame:
    """(src, rel, dst, hop, degree): facts met by a search along some relations, each at its first hop, with the other end's degree."""
    around = incident(edges)
    degree = around.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    step = around.where(F.col("rel").isin(relations))
    frontier = seen = starts.select("node_id").distinct()
    facts = None
    for h in range(1, hops + 1):
        met = kept(frontier.join(step, "node_id").select("src", "rel", "dst", F.col("other").alias("node_id"), F.lit(h).cast("long").alias("hop")))
        facts = met if facts is None else facts.unionByName(met)
        frontier = met.select("node_id").distinct().join(seen, "node_id", "left_anti")
        seen = seen.union(frontier)
    return facts.join(degree, "node_id").groupBy("src", "rel", "dst").agg(F.min("hop").alias("hop"), F.max("degree").alias("degree"))


def retrieve(direct: DataFrame, expanded: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    """(query_id, node_id, score, rank): direct hits that are evidence and what expansion adds, the best score of each; k of them."""
    both = direct.join(evidence.select("node_id"), "node_id", "left_semi").select("query_id", "node_id", "score").unionByName(expanded.select("query_id", "node_id", "score"))
    best = both.groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")).cast("long")).where(F.col("rank") <= k)


def table_scores(questions: DataFrame, columns: DataFrame) -> DataFrame:
    """(query_id, tab, score): 5 for a table's name in the question, 3 for a part of it, 1 for each column's name, 2 for each sample value. columns (tab, name, samples)."""
    asked = questions.select("query_id", F.explode(F.array_distinct(tokens(F.col("text"), "[a-z0-9_]+"))).alias("w"))
    tabs = columns.select("tab").distinct()
    whole = tabs.select("tab", F.lower("tab").alias("w"), F.lit(5).alias("s"))
    parts = tabs.select("tab", F.explode(F.array_distinct(F.split(F.lower("tab"), "_"))).alias("w"), F.lit(3).alias("s")).where("w <> lower(tab)")
    cols = columns.select("tab", F.lower("name").alias("w"), F.lit(1).alias("s"))
    values = columns.select("tab", F.explode("samples").alias("v")).select("tab", F.lower("v").alias("w"), F.lit(2).alias("s")).distinct()
    keyed = whole.union(parts).union(cols).union(values)
    return asked.join(keyed, "w").groupBy("query_id", "tab").agg(F.sum("s").alias("score"))


def join_path_sql(tables: list[str], keys: dict[tuple[str, str], tuple[str, str]], select: str, where: str = "") -> str:
    """Spark SQL that joins tables in order, each to one before it by a foreign key in either direction."""
    lines = [f"SELECT {select}", f"FROM {tables[0]}"]
    for k, t in enumerate(tables[1:], 1):
        on = next(((a, b) for p in tables[:k] for a, b in ([keys[p, t]] if (p, t) in keys else [keys[t, p][::-1]] if (t, p) in keys else [])), None)
        if on is None:
            raise ValueError(f"no foreign key leads to {t}")
        lines.append(f"JOIN {t} ON {on[0]} = {on[1]}")
    return "\n".join(lines + ([f"WHERE {where}"] if where else []))
