"""Retrieval and answers in rounds: retrieval with expansion, iterative retrieval, correction, constrained decoding. Models are injected."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import token_overlap
from lodegraph.operators.durable import kept
from lodegraph.operators.graph import incident
from lodegraph.operators.retrieval import squared_distance


def named_scores(asked: DataFrame, queries: DataFrame, stored: DataFrame) -> DataFrame:
    """(query_id, node_id, score) of the nodes that are asked for (query_id, node_id), on the scale of a search: seven tenths closeness of vectors, three tenths token overlap.

    queries and stored hold (query_id or node_id, embedding, text). Nodes that aren't stored are skipped.
    """
    q = queries.select("query_id", F.col("embedding").alias("_q"), F.col("text").alias("_t"))
    both = asked.select("query_id", "node_id").distinct().join(stored.select("node_id", "embedding", "text"), "node_id").join(q, "query_id")
    return both.select("query_id", "node_id", (0.7 / (1 + squared_distance(F.col("_q"), F.col("embedding"))) + 0.3 * token_overlap(F.col("_t"), F.col("text"))).alias("score"))


def expand_scored(seeds: DataFrame, edges: DataFrame, evidence: DataFrame, selected: DataFrame, score: Callable[[DataFrame], DataFrame], k: int, weight: float = 0.5, floor: float = 0.05) -> DataFrame:
    """(query_id, node_id, score): the k best of each query that its seeds (query_id, node_id, score) lead to.

    A neighbour that is evidence is one hop away, evidence behind a neighbour that isn't, two. score(pairs) scores candidates on
    the seeds' scale; to it comes at most weight of the spread of the seeds' scores, by how many seeds lead there, five at most, and how near.
    """
    step = incident(edges).select("node_id", "other").distinct()
    known = evidence.select("node_id").distinct()
    begin = seeds.select("query_id", F.col("node_id").alias("seed"), "node_id")
    one = kept(begin.join(step, "node_id").select("query_id", "seed", F.col("other").alias("node_id")).distinct())
    near = one.join(known, "node_id", "left_semi").withColumn("hops", F.lit(1))
    far = one.join(known, "node_id", "left_anti").join(step.join(known.withColumnRenamed("node_id", "other"), "other", "left_semi"), "node_id").select("query_id", "seed", F.col("other").alias("node_id")).distinct().withColumn("hops", F.lit(2))
    met = near.unionByName(far).where("seed <> node_id").join(selected.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    counted = kept(met.groupBy("query_id", "node_id").agg(F.countDistinct("seed").alias("support"), F.min("hops").alias("hops")))
    spread = seeds.groupBy("query_id").agg(F.max("score").alias("_hi"), F.min("score").alias("_lo")).select("query_id", F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.greatest("_hi", F.lit(0.0))).alias("_spread"))
    scored = counted.join(score(counted.select("query_id", "node_id")), ["query_id", "node_id"]).where(F.col("score") >= floor).join(spread, "query_id")
    boosted = F.col("score") + weight * F.least("support", F.lit(5)) / 5 / F.col("hops") * F.col("_spread")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return scored.select("query_id", "node_id", boosted.alias("score")).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def retrieve(direct: DataFrame, edges: DataFrame, evidence: DataFrame, score: Callable[[DataFrame], DataFrame], k: int, expand: bool = True) -> DataFrame:
    """(query_id, node_id, score, rank): k evidence nodes for each query of direct hits (query_id, node_id, score, rank), which hold more than k as not all hits are evidence.

    The k best hits that are evidence and what the k best hits lead to compete by score; further evidence fills what is left.
    """
    found = direct.join(evidence.select("node_id").distinct(), "node_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy("rank")
    ranked = kept(found.withColumn("_e", F.row_number().over(w)).select("query_id", "node_id", "score", "_e"))
    selected = ranked.where(F.col("_e") <= k)
    pool = ranked.select("query_id", "node_id", "score", F.when(F.col("_e") <= k, 0).otherwise(1).alias("_class"))
    if expand:
        more = expand_scored(direct.where(F.col("rank") <= k), edges, evidence, selected, score, k)
        pool = pool.unionByName(more.withColumn("_class", F.lit(0)))
    best = pool.groupBy("query_id", "node_id").agg(F.min(F.struct("_class", (-F.col("score")).alias("_s"))).alias("b"))
    last = Window.partitionBy("query_id").orderBy("b._class", "b._s", "node_id")
    return best.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= k).select("query_id", "node_id", (-F.col("b._s")).alias("score"), "rank")


def iterative(questions: DataFrame, search: Callable[[DataFrame], DataFrame], texts: DataFrame, steps: int = 2, k: int = 3) -> DataFrame:
    """(query_id, step, rank, node_id) of questions (query_id, text): what each step retrieves.

    search(queries) gives (query_id, node_id, rank) for queries (query_id, text). After a step, the question and the texts (node_id, text) that
    it found, k at most, are the next step's query. Each step is kept, so the plan doesn't grow with the steps.
    """
    now, out = questions.select("query_id", "text"), None
    for step in range(1, steps + 1):
        hits = kept(search(now).where(F.col("rank") <= k).select("query_id", F.lit(step).cast("long").alias("step"), F.col("rank").cast("long").alias("rank"), "node_id"))
        out = hits if out is None else out.unionByName(hits)
        context = hits.join(texts.select("node_id", "text"), "node_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("c"))
        said = F.array_join(F.transform("c", lambda x: x["text"]), " ")
        now = questions.select("query_id", "text").join(context, "query_id", "left").select("query_id", F.concat_ws(" ", "text", said).alias("text"))
    return out


def corrected(answers: DataFrame, supported: DataFrame, ask: Callable[[DataFrame], DataFrame], rounds: int = 3) -> DataFrame:
    """(question_id, name): answers (question_id, name) after at most so many rounds of correction.

    A round asks the model about the questions that have support (question_id, name) and whose answer differs from it: ask gets (question_id,
    missing, extra, answer), sorted arrays, and gives (question_id, name), the new answer. A question rests once its answer agrees, or didn't change.
    """
    names = lambda df, c: df.groupBy("question_id").agg(F.sort_array(F.collect_set("name")).alias(c))
    truth = kept(names(supported, "truth"))
    none = F.array().cast("array<string>")
    now = kept(names(answers, "answer").join(truth, "question_id", "full").select("question_id", F.coalesce("answer", none).alias("answer"), "truth", F.col("truth").isNotNull().alias("open")))
    for _ in range(rounds):
        differs = now.where("open").select("question_id", F.sort_array(F.array_except("truth", "answer")).alias("missing"), F.sort_array(F.array_except("answer", "truth")).alias("extra"), "answer").where("size(missing) + size(extra) > 0")
        asked = kept(differs)
        if asked.isEmpty():
            break
        given = names(ask(asked), "given")
        both = now.join(asked.select("question_id", F.lit(True).alias("asked")), "question_id", "left").join(given, "question_id", "left")
        new = F.when(F.col("asked"), F.coalesce("given", none)).otherwise(F.col("answer"))
        now = kept(both.select("question_id", new.alias("answer"), "truth", (F.coalesce("asked", F.lit(False)) & (new != F.col("answer"))).alias("open")))
    return now.select("question_id", F.explode("answer").alias("name"))


class NameAutomaton:
    """The tokens that may follow when an answer must be names of a list, separated, none twice.

    first and rest are the names' tokens at the answer's beginning and after a name, the separator included. Of names that fit, the longest counts as said.
    """

    def __init__(self, first: list[list], rest: list[list], end, least: int = 1, most: int | None = None):
        self.first, self.rest, self.end, self.least = first, rest, end, least
        self.most = len(first) if most is None else most

    def read(self, said: list) -> tuple[set[int], list]:
        """The names that are said, and the tokens since the last of them."""
        used: set[int] = set()
        at = 0
        while at < len(said):
            forms = self.rest if used else self.first
            fit = [i for i, x in enumerate(forms) if i not in used and x and said[at : at + len(x)] == x]
            if not fit:
                break
            name = max(fit, key=lambda i: (len(forms[i]), -i))
            at += len(forms[name])
            used.add(name)
        return used, said[at:]

    def allowed(self, said: list) -> set:
        """Tokens that go on with a name that isn't said yet; the end only between names and after `least` of them, or where nothing else may follow."""
        used, begun = self.read(said)
        forms = self.rest if used else self.first
        out = {x[len(begun)] for i, x in enumerate(forms) if i not in used and len(x) > len(begun) and x[: len(begun)] == begun} if len(used) < self.most else set()
        if not out or not begun and len(used) >= self.least:
            out.add(self.end)
        return out


def interventions(answers: DataFrame, separator: str = ",", end: str = "<end>", least: int = 1) -> DataFrame:
    """(answer_id, n_steps, n_blocked, rate) of answers (answer_id, names array<array<string>>, tokens array<string>): steps at which the model's own token isn't allowed, each judged after the tokens before it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, names, said in zip(f["answer_id"], f["names"], f["tokens"], strict=True):
                first = [list(x) for x in names]
                automaton, said = NameAutomaton(first, [[separator, *x] for x in first], end, least), list(said)
                blocked = sum(t not in automaton.allowed(said[:k]) for k, t in enumerate(said))
                rows.append((i, len(said), blocked, blocked / len(said) if said else 0.0))
            yield pd.DataFrame(rows, columns=["answer_id", "n_steps", "n_blocked", "rate"])

    return answers.select("answer_id", "names", "tokens").mapInPandas(run, "answer_id long, n_steps long, n_blocked long, rate double")
