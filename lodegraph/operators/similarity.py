"""Exact joins of similar sets and of similar names, by prefixes of their rarest elements.

Two sets whose similarity reaches a threshold share so many elements that, in any common order, each has one of them near its
beginning. Rarest first, these prefixes hold few common elements, so candidates are the pairs that meet on one, with sizes and places
that still allow the threshold. Where elements are few and common, as characters are, candidates must meet on two. All is equi-joins;
no pair is dropped that reaches the threshold.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.operators.durable import kept

JACCARD, DICE = "jaccard", "dice"
#: What rounding may add to a bound; bounds are lowered by it.
SLACK = 1e-9


def _required(measure: str, threshold: float, a: Column, b: Column) -> Column:
    """How many elements sets of sizes a and b must share."""
    need = (a + b) * (threshold / (1 + threshold)) if measure == JACCARD else (a + b) * (threshold / 2)
    return F.greatest(F.ceil(need - SLACK), F.lit(1))


def _least_ratio(measure: str, threshold: float) -> float:
    """The least ratio of the sizes, and so the least share of a set that it must share."""
    return threshold if measure == JACCARD else threshold / (2 - threshold)


def similar_sets(left: DataFrame, right: DataFrame, threshold: float, measure: str = JACCARD, meet: int = 1, keys: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
    """(keys..., a, b, na, nb, same) of left and right (id, items array of distinct strings, keys...) within equal keys: all pairs that reach the threshold.

    With ordered, left and right are the same table and each pair comes once, a < b. meet: 1, or 2 where items are few and common. Empty sets are in no pair.
    """
    ratio = _least_ratio(measure, threshold)
    sides = [left] if ordered else [left, right]
    both = sides[0].select("items") if ordered else left.select("items").unionByName(right.select("items"))
    frequency = both.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("df"))

    def ranked(side: DataFrame) -> DataFrame:
        rows = side.select("id", *keys, F.explode("items").alias("item")).join(frequency, "item")
        order = F.transform(F.sort_array(F.collect_list(F.struct("df", "item"))), lambda x: x["item"])
        return kept(rows.groupBy("id", *keys).agg(order.alias("items")).withColumn("n", F.size("items")))

    def prefixes(side: DataFrame, name: str) -> DataFrame:
        least = F.greatest(F.ceil(F.col("n") * ratio - SLACK), F.lit(1)).cast("int")
        head = side.withColumn("least", least).withColumn("head", F.slice("items", 1, F.least(F.col("n"), F.col("n") - least + meet)))
        one = lambda x, i: F.struct(x.alias("k"), i.alias("p"))
        if meet == 1:
            found = F.transform("head", one)
        else:
            two = F.flatten(F.transform("head", lambda x, i: F.transform(F.filter("head", lambda y, j: j > i), lambda y: F.struct(F.concat_ws("\0", x, y).alias("k"), i.alias("p")))))
            found = F.when(F.col("least") < 2, F.concat(two, F.transform("head", one))).otherwise(two)
        return head.select(*keys, F.col("id").alias(name), F.col("n").alias(f"n{name}"), F.explode(found).alias("m")).select(*keys, name, f"n{name}", F.col("m.k").alias("_k"), F.col("m.p").alias(f"p{name}"))

    ranks = [ranked(s) for s in sides]
    a, b = ranks[0], ranks[-1]
    na, nb = F.col("na"), F.col("nb")
    need = _required(measure, threshold, na, nb)
    rest = F.least(na - F.col("pa"), nb - F.col("pb"))  # the first item of those shared leaves room for all of them
    met = prefixes(a, "a").join(prefixes(b, "b"), [*keys, "_k"]).where((na * ratio <= nb + SLACK) & (nb * ratio <= na + SLACK) & (rest >= need))
    if ordered:
        met = met.where("a < b")
    pairs = met.select(*keys, "a", "b").distinct()
    sets = lambda side, name: side.select(*keys, F.col("id").alias(name), F.col("items").alias(f"_{name}"))
    whole = pairs.join(sets(a, "a"), [*keys, "a"]).join(sets(b, "b"), [*keys, "b"])
    counted = whole.select(*keys, "a", "b", F.size("_a").alias("na"), F.size("_b").alias("nb"), F.size(F.array_intersect("_a", "_b")).alias("same"))
    return counted.where(F.col("same") >= _required(measure, threshold, na, nb))


def characters(text: Column) -> Column:
    """The characters of a text, each with how often it stood before, so that the set tells the multiset."""
    one = F.split(text, "")
    return F.when(F.length(text) > 0, F.transform(one, lambda c, i: F.concat_ws("#", c, F.size(F.filter(F.slice(one, 1, i), lambda d: d == c)).cast("string")))).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's similarity, which no expression has."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def closest(names: DataFrame, golds: DataFrame, key: str, threshold: float = 0.82) -> DataFrame:
    """(key, gold, verdict, best, ratio) for golds (key, gold) by the names of their key (key, name), both in lower case with single spaces.

    HIT if one is equal; NEAR, with the most similar name, if its sequence similarity reaches the threshold; else MISS. That similarity is at most Dice's of the multisets of
    characters, so only names that reach the threshold by it are compared.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    asked = kept(golds.select(key, "gold", plain(F.col("gold")).alias("_g")).distinct())
    known = names.select(key, plain(F.col("name")).alias("_n")).where("_n <> ''").distinct()
    hit = asked.join(known.withColumnRenamed("_n", "_g"), [key, "_g"], "left_semi").select(key, "gold", F.col("_g").alias("best"), F.lit(1.0).alias("ratio"))
    open_ = asked.join(known.withColumnRenamed("_n", "_g"), [key, "_g"], "left_anti")
    as_set = lambda rows, c: rows.select(key, F.col(c).alias("id"), characters(F.col(c)).alias("items")).distinct()
    near = similar_sets(as_set(open_, "_g"), as_set(known, "_n"), threshold, DICE, 2, (key,))
    scored = near.withColumn("ratio", sequence_ratio("a", "b")).where(F.col("ratio") >= threshold)
    best = scored.groupBy(key, F.col("a").alias("_g")).agg(F.max(F.struct("ratio")).alias("_m"), F.min_by("b", F.struct(-F.col("ratio"), "b")).alias("best")).select(key, "_g", "best", F.col("_m.ratio").alias("ratio"))
    found = hit.unionByName(open_.join(best, [key, "_g"]).select(key, "gold", "best", "ratio"))
    verdict = F.when(F.col("ratio").isNull(), "MISS").when(F.col("ratio") == 1, "HIT").otherwise("NEAR")
    return golds.select(key, "gold").distinct().join(found, [key, "gold"], "left").select(key, "gold", verdict.alias("verdict"), "best", "ratio")
