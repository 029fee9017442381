"""Linking and verification: text to entities, claims to verdicts.

Candidates come from joins on normalised n-grams, never from a scan of all aliases for each
text. What is sequential by nature, taking the longest match first and consuming it, is
a fold over one text's own candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.operators.durable import kept
from lodegraph.operators.graph import incident

SUPPORTED, CONTRADICTED, NOT_COVERED = "SUPPORTED", "CONTRADICTED", "NOT_COVERED"
#: Negation cues, longest first, and what ends their scope.
CUES = ["no evidence of", "does not", "did not", "do not", "is not", "was not", "are not", "cannot", "without", "never", "not", "no"]
BOUNDARIES = [" but ", " however ", " although ", ";", ".", ","]


def key(text: Column) -> Column:
    """Lower case, everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def alias_index(nodes: DataFrame, order: str = "ord") -> DataFrame:
    """(alias, node_id): label, name or title and the aliases of nodes (node_id, names array, ord); normalised, of three characters at least. The first node by order owns an alias."""
    named = nodes.select("node_id", order, F.posexplode("names").alias("k", "name")).select("node_id", order, "k", key(F.col("name")).alias("alias")).where("length(alias) >= 3")
    return named.groupBy("alias").agg(F.min_by("node_id", F.struct(order, "k", "node_id")).alias("node_id"))


def short_forms(names: DataFrame, stop: list[str]) -> DataFrame:
    """(form, name): last words and initials with the last word of names (name), where one name alone has them and they are no name themselves."""
    w = F.split(key(F.col("name")), " ")
    last = F.element_at(w, -1)
    initials = F.array_join(F.transform(F.slice(w, 1, F.size(w) - 1), lambda x: F.substring(x, 1, 1)), " ")
    forms = names.where(F.size(w) > 1).select("name", F.explode(F.array(last, F.concat_ws(" ", initials, last))).alias("form"), last.alias("last"))
    fit = forms.where((F.length("last") >= 4) & ~F.col("last").isin(stop))
    once = fit.groupBy("form").agg(F.countDistinct("name").alias("n"), F.min("name").alias("name")).where("n = 1").select("form", "name")
    return once.join(names.select(key(F.col("name")).alias("form")), "form", "left_anti")


def ngrams(texts: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(id, pos, width, gram): all runs of up to `most` words of the normalised text."""
    words = texts.select(id_col, F.split(key(F.col(text_col)), " ").alias("w")).where("size(w) > 0")
    at = words.select(id_col, "w", F.posexplode("w").alias("pos", "_"))
    grams = at.select(id_col, "pos", "w", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("width")).where(F.col("pos") + F.col("width") <= F.size("w"))
    return grams.select(id_col, "pos", "width", F.array_join(F.slice("w", F.col("pos") + 1, F.col("width")), " ").alias("gram"))


def longest_matches(candidates: DataFrame, id_col: str, max_hits: int | None = None) -> DataFrame:
    """Of candidates (id, pos, width, node_id), those that a longest-first pass without overlaps takes: by width, then place."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("width")).alias("w"), F.col("pos").alias("p"), F.col("node_id").alias("n"))))
    none = F.array().cast("array<struct<w:int,p:int,n:string>>")
    clear = lambda a, x: ~F.exists(a, lambda y: (x["p"] < y["p"] - y["w"]) & (y["p"] < x["p"] - x["w"]))
    taken = F.aggregate(ordered, none, lambda a, x: F.when(clear(a, x), F.concat(a, F.array(x))).otherwise(a))
    out = candidates.groupBy(id_col).agg(taken.alias("t")).select(id_col, F.posexplode("t").alias("k", "t"))
    kept = out if max_hits is None else out.where(F.col("k") < max_hits)
    return kept.select(id_col, F.col("t.p").alias("pos"), (-F.col("t.w")).alias("width"), F.col("t.n").alias("node_id"))


def link(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str, most: int = 4, max_hits: int | None = None) -> DataFrame:
    """(id, pos, width, node_id): the entities of each text by alias (alias, node_id), longest match first."""
    found = ngrams(texts, id_col, text_col, most).join(aliases.withColumnRenamed("alias", "gram"), "gram").select(id_col, "pos", "width", "node_id")
    return longest_matches(found, id_col, max_hits)


def scoped_verdicts(claims: DataFrame, mentions: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(claim_id, verdict, hops) of claims (claim_id, subject, rel) by the entities that they mention (claim_id, node_id).

    Without an edge of the relation the claim isn't covered; if an end of one is mentioned, or within more hops
    reached, it is supported; any other mention contradicts it; none leaves it uncovered. Relations compare without case.
    """
    expected = claims.join(edges.select(F.col("src").alias("subject"), F.lower("rel").alias("_r"), F.col("dst").alias("node_id")), "subject").where(F.col("rel").isNull() | (F.lower("rel") == F.col("_r"))).select("claim_id", "node_id").distinct()
    hit = mentions.join(expected, ["claim_id", "node_id"], "left_semi").groupBy("claim_id").agg(F.lit(1).alias("direct"))
    state = claims.select("claim_id", "subject").join(expected.groupBy("claim_id").agg(F.lit(1).alias("expects")), "claim_id", "left").join(hit, "claim_id", "left").join(mentions.groupBy("claim_id").agg(F.lit(1).alias("mentions")), "claim_id", "left")
    if hops > 1:
        step = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other"))
        frontier = claims.select("claim_id", F.col("subject").alias("node_id"))
        seen, reached = frontier, None
        for h in range(1, hops + 1):
            frontier = kept(frontier.join(step, "node_id").select("claim_id", F.col("other").alias("node_id")).join(seen, ["claim_id", "node_id"], "left_anti").distinct())
            seen = seen.union(frontier)
            level = frontier.withColumn("far", F.lit(h))
            reached = level if reached is None else reached.unionByName(level)
        far = mentions.join(reached, ["claim_id", "node_id"]).groupBy("claim_id").agg(F.min("far").alias("far"))
        state = state.join(far, "claim_id", "left")
    else:
        state = state.withColumn("far", F.lit(None).cast("int"))
    verdict = F.when(F.col("expects").isNull(), NOT_COVERED).when(F.col("direct").isNotNull() | F.col("far").isNotNull(), SUPPORTED).when(F.col("mentions").isNotNull(), CONTRADICTED).otherwise(NOT_COVERED)
    return state.select("claim_id", verdict.alias("verdict"), F.when(F.col("expects").isNotNull(), F.when(F.col("direct").isNotNull(), 1).otherwise(F.col("far"))).cast("long").alias("hops"))


def unscoped_verdicts(heads: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """(claim_id, verdict): supported if an edge leads from the head (claim_id, node_id) to another mention; uncovered otherwise."""
    others = mentions.withColumnRenamed("node_id", "dst")
    joined = heads.withColumnRenamed("node_id", "src").join(edges.select("src", "dst").distinct(), "src").join(others, ["claim_id", "dst"], "left_semi").select("claim_id").distinct().withColumn("_y", F.lit(1))
    return heads.select("claim_id").distinct().join(joined, "claim_id", "left").select("claim_id", F.when(F.col("_y") == 1, SUPPORTED).otherwise(NOT_COVERED).alias("verdict"))


def buffers(spans: DataFrame, facts: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statuses of spans (buffer_id, subject, rel, span) and omissions.

    facts (subject, rel, name); vocabulary (name). A span is SUPPORTED if it is a fact of its subject, NOT_IN_GRAPH if it is a
    known name but no such fact, else UNLINKED; all are UNLINKED if the subject has no facts. Omitted: facts that no span states.
    """
    has = facts.select("subject", "rel").distinct().withColumn("_h", F.lit(1))
    fact = facts.select("subject", "rel", key(F.col("name")).alias("_k")).distinct().withColumn("_f", F.lit(1))
    names = vocabulary.select(key(F.col("name")).alias("_k")).distinct().withColumn("_v", F.lit(1))
    keyed = spans.withColumn("_k", key(F.col("span"))).join(has, ["subject", "rel"], "left").join(fact, ["subject", "rel", "_k"], "left").join(names, "_k", "left")
    status = F.when(F.col("_h").isNull(), "UNLINKED").when(F.col("_f").isNotNull(), SUPPORTED).when(F.col("_v").isNotNull(), "NOT_IN_GRAPH").otherwise("UNLINKED")
    judged = keyed.select("buffer_id", "subject", "rel", "span", "_k", status.alias("status"))
    asked = spans.select("buffer_id", "subject", "rel").distinct().join(facts.select("subject", "rel", "name", key(F.col("name")).alias("_k")).distinct(), ["subject", "rel"])
    omitted = asked.join(judged.select("buffer_id", "_k"), ["buffer_id", "_k"], "left_anti").select("buffer_id", "name")
    return judged.drop("_k"), omitted


def omission_counts(spans: DataFrame, facts: DataFrame) -> DataFrame:
    """(buffer_id, omitted): how many facts each buffer leaves out, the omissions of `buffers` counted: those of its subjects less those that one of its spans states.

    No fact becomes a row for each buffer that asks for its subject: only a buffer's own spans meet its subjects.
    """
    fact = facts.select("subject", "rel", "name", key(F.col("name")).alias("_k")).distinct()
    own = spans.select("buffer_id", "subject", "rel", key(F.col("span")).alias("_k"))
    asked = own.select("buffer_id", "subject", "rel").distinct()
    of_all = asked.join(fact.groupBy("subject", "rel").agg(F.count(F.lit(1)).alias("_n")), ["subject", "rel"]).select("buffer_id", "_n")
    said = asked.join(own.select("buffer_id", "_k").where("_k is not null").distinct(), "buffer_id")
    known = fact.groupBy("subject", "rel", "_k").agg((-F.count(F.lit(1))).alias("_n"))
    stated = said.join(known, ["subject", "rel", "_k"]).select("buffer_id", "_n")
    return of_all.unionByName(stated).groupBy("buffer_id").agg(F.sum("_n").alias("omitted")).where("omitted > 0")


def allowed_next(names: DataFrame) -> DataFrame:
    """(prefix, next): the tokens that may follow each prefix of the names (name); the end is allowed after a whole name, as <end>."""
    w = names.select(F.split(key(F.col("name")), " ").alias("w"))
    at = w.select("w", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("i"))
    return at.select(F.array_join(F.slice("w", 1, F.col("i")), " ").alias("prefix"), F.coalesce(F.get("w", F.col("i")), F.lit("<end>")).alias("next")).distinct()


def polarity(text: Column, mention: Column) -> Column:
    """denied if an odd number of negation cues has the mention's first occurrence in its scope; null without the mention.

    A cue's scope runs to the nearest boundary; cues are taken longest first and don't overlap.
    """
    lowered = F.lower(text)
    at = F.instr(lowered, F.lower(mention))
    before = F.substring(lowered, F.lit(1), at - 1)
    ends = "|".join(x.replace(".", "\\.") for x in BOUNDARIES)
    scope = F.element_at(F.split(before, ends), -1)
    cues = F.regexp_extract_all(scope, F.lit("(?<![a-z])(?:" + "|".join(CUES) + ")(?![a-z])"), 0)
    return F.when(at > 0, F.when(F.size(cues) % 2 == 1, "denied").otherwise("affirmed"))


def softmax_messages(edges: DataFrame, score: str, value: str) -> DataFrame:
    """(dst, message): for each destination the values of its sources, weighed by the softmax of their scores."""
    w = Window.partitionBy("dst")
    e = edges.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return e.groupBy("dst").agg((F.sum(F.col("_e") * F.col(value)) / F.sum("_e")).alias("message"))


def passage_votes(scored: DataFrame, claim: str) -> DataFrame:
    """(claim, entail, contradict, truth): maxima over a claim's passages, and their difference."""
    out = scored.groupBy(claim).agg(F.max("entail").alias("entail"), F.max("contradict").alias("contradict"))
    return out.withColumn("truth", F.col("entail") - F.col("contradict"))


def reachable(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node_id, depth): what seeds (node_id) reach along or against edges, by the least depth."""
    step = incident(edges).select("node_id", "other")
    frontier = seen = seeds.select("node_id").distinct()
    out = frontier.withColumn("depth", F.lit(0))
    for h in range(1, hops + 1):
        frontier = kept(frontier.join(step, "node_id").select(F.col("other").alias("node_id")).join(seen, "node_id", "left_anti").distinct())
        seen = seen.union(frontier)
        out = out.unionByName(frontier.withColumn("depth", F.lit(h)))
    return out.where("depth > 0")


def linked_or_nearest(mentions: DataFrame, names: DataFrame, vectors: DataFrame, mention_vectors: DataFrame, threshold: float = 0.72) -> DataFrame:
    """(mention_id, node_id, how): the first node by id whose alphanumeric key equals the mention's; else the nearest by cosine at the threshold or above, of the mention's kind; else none.

    mentions (mention_id, text, kind), names (node_id, name, kind), vectors (node_id, v), mention_vectors (mention_id, v).
    Mentions without an exact name are a stated query set; each meets the vectors of its kind.
    """
    alnum = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    index = names.groupBy(alnum(F.col("name")).alias("_k")).agg(F.min("node_id").alias("node_id"))
    exact = mentions.withColumn("_k", alnum(F.col("text"))).join(index, "_k").select("mention_id", "node_id", F.lit("exact").alias("how"))
    rest = mentions.join(exact, "mention_id", "left_anti").join(mention_vectors.withColumnRenamed("v", "_m"), "mention_id")
    length = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x))
    inner = F.aggregate(F.zip_with("_m", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    near = rest.join(names.select("node_id", "kind").join(vectors, "node_id"), "kind").withColumn("_s", inner / (length(F.col("_m")) * length(F.col("v")))).where(F.col("_s") >= threshold)
    best = near.groupBy("mention_id").agg(F.max(F.struct("_s", "node_id")).alias("_b")).select("mention_id", F.col("_b.node_id").alias("node_id"), F.lit("nearest").alias("how"))
    found = exact.unionByName(best)
    return mentions.select("mention_id").join(found, "mention_id", "left").select("mention_id", "node_id", F.coalesce("how", F.lit("unresolved")).alias("how"))


def confusion(probes: DataFrame, truth: str, found: str, by: str) -> DataFrame:
    """(by, correct, wrong, unresolved) of linked probes."""
    n = lambda c: F.count(F.when(c, 1))
    t, f = F.col(truth), F.col(found)
    return probes.groupBy(by).agg(n(f.eqNullSafe(t)).alias("correct"), n(f.isNotNull() & (f != t)).alias("wrong"), n(f.isNull()).alias("unresolved"))


def clean_claims(raw: DataFrame) -> DataFrame:
    """Claims with a subject and an object; a polarity that is neither affirmed nor denied becomes affirmed."""
    kept = raw.where("trim(coalesce(subject, '')) <> '' and trim(coalesce(object, '')) <> ''")
    return kept.withColumn("polarity", F.when(F.col("polarity").isin("affirmed", "denied"), F.col("polarity")).otherwise("affirmed"))


def located(votes: DataFrame, allowed: DataFrame, query_col: str, doc_col: str) -> DataFrame:
    """(query, doc): of each query's votes (query, doc, votes) the best document among its allowed ones (query, doc)."""
    kept = votes.join(allowed.select(query_col, doc_col).distinct(), [query_col, doc_col], "left_semi")
    w = Window.partitionBy(query_col).orderBy(F.desc("votes"), doc_col)
    return kept.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(query_col, doc_col)
