"""Evaluation statistics: counts, means and closed forms as expressions; resampling by hashed indices.

Every statistic is an aggregate of item rows; only aggregates reach the driver, and only
where a caller collects them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean(value: str) -> Column:
    """Without nulls; 0 if none is left."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def recall_at(ranked: DataFrame, targets: DataFrame, item: str, candidate: str, ks: list[int]) -> DataFrame:
    """(item, k, hit): whether one of the first k candidates (item, candidate, rank) is a target (item, candidate)."""
    hit = ranked.join(targets.select(item, candidate).distinct(), [item, candidate], "left_semi").groupBy(item).agg(F.min("rank").alias("first"))
    k = F.explode(F.array(*[F.lit(int(x)) for x in ks])).alias("k")
    return targets.select(item).distinct().select(item, k).join(hit, item, "left").select(item, "k", F.coalesce(F.col("first") <= F.col("k"), F.lit(False)).cast("int").alias("hit"))


def auc(scored: DataFrame, groups: list[str], score: str, positive: str) -> DataFrame:
    """(groups..., auc): the chance that a positive scores above a negative, ties half; 0.5 where a class is missing.

    Rank sums over distinct scores: rows of one score are counted first, so the windows hold distinct scores.
    """
    tied = scored.groupBy(*groups, score).agg(F.sum(F.when(F.col(positive), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(positive), 0).otherwise(1)).alias("n"))
    w = Window.partitionBy(*groups).orderBy(score)
    below = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = tied.withColumn("won", F.col("p") * (below + F.col("n") / 2))
    out = won.groupBy(*groups).agg(F.sum("won").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.select(*groups, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).otherwise(0.5).alias("auc"))


def transitions(before: DataFrame, after: DataFrame, item: str, status: str, statuses: list[str]) -> DataFrame:
    """(before, one column for each status after): how items moved."""
    both = before.select(item, F.col(status).alias("before")).join(after.select(item, F.col(status).alias("after")), item)
    return both.groupBy("before").pivot("after", statuses).agg(F.count(F.lit(1))).na.fill(0)


#: Items of a block of a bootstrap, roughly; resamples that are drawn at once hold at most so many counts.
BLOCK, AT_ONCE = 250_000, 2_000_000


def resampled_means(items: DataFrame, value: str, resamples: int, seed: int) -> DataFrame:
    """(b, m): the mean of each resample of all items, as many drawn with replacement as there are.

    How many of a resample's draws fall into each block of items follows a multinomial law, which every block's task draws for itself from the same
    seed. Within its block a task draws how often each distinct value comes, and sends one sum for each resample. No draw is a row.
    """
    plain = items.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    total = plain.count()
    if not total:
        return items.sparkSession.createDataFrame([], "b long, m double")
    parts = max(1, -(-total // BLOCK))
    dealt = plain.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int"))
    sizes = {r["block"]: r["n"] for r in dealt.groupBy("block").agg(F.sum("n").alias("n")).collect()}  # a row for each block
    blocks = sorted(sizes)
    share = np.array([sizes[k] for k in blocks]) / total

    def sums(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("v")
        at = blocks.index(int(f["block"].iloc[0]))
        draws = np.random.default_rng(seed).multinomial(total, share, size=resamples)[:, at]
        rng, v, p = np.random.default_rng([seed, at]), f["v"].to_numpy(), f["n"].to_numpy() / f["n"].sum()
        step = max(1, AT_ONCE // len(v))
        out = np.concatenate([rng.multinomial(draws[k : k + step], p) @ v for k in range(0, resamples, step)])
        return pd.DataFrame({"b": np.arange(resamples), "s": out})

    return dealt.groupBy("block").applyInPandas(sums, "b long, s double").groupBy("b").agg((F.sum("s") / total).alias("m"))


def bootstrap(paired: DataFrame, diff: str, resamples: int = 10_000, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """(mean, low, high, n, excludes_zero): the paired bootstrap's interval of the mean difference, by the order of the resamples' means."""
    order = resampled_means(paired, diff, resamples, seed).select("m", (F.row_number().over(Window.orderBy("m", "b")) - 1).alias("k"))  # one row for each resample
    low, high = int(alpha / 2 * resamples), min(resamples - 1, int((1 - alpha / 2) * resamples))
    bounds = order.agg(F.max(F.when(F.col("k") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("k") == high, F.col("m"))).alias("high"))
    whole = paired.agg(F.avg(diff).alias("mean"), F.count(diff).alias("n"))
    return whole.crossJoin(bounds).select("mean", "low", "high", "n", ((F.col("low") > 0) | (F.col("high") < 0)).alias("excludes_zero"))  # one row each


def bootstrap_mean(scores: DataFrame, score: str, resamples: int = 1000, seed: int = 42, ci: float = 0.95) -> DataFrame:
    """(mean, low, high, n) of one sample's scores, by interpolated percentiles of the resamples' means, rounded to four places; zeros without scores."""
    q = lambda p: F.round(F.coalesce(F.percentile("m", F.lit(p)), F.lit(0.0)), 4)
    bounds = resampled_means(scores, score, resamples, seed).agg(q((1 - ci) / 2).alias("low"), q((1 + ci) / 2).alias("high"))
    return scores.agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("mean"), F.count(score).alias("n")).crossJoin(bounds).select("mean", "low", "high", "n")  # one row each


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact p of discordant counts: twice the binomial tail at 1/2, at most 1; 1 without discordance.

    Each term's logarithm follows from the one before, so the tail takes as many steps as it has terms.
    """
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    first = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i)
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), first, step, lambda acc: acc["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = hits / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def holm(tests: DataFrame, groups: list[str], p: str, name: str) -> DataFrame:
    """tests with `adjusted`: the step-down running maximum of min(1, (m - i) p)."""
    w = Window.partitionBy(*groups).orderBy(p, name)
    m = F.count(F.lit(1)).over(Window.partitionBy(*groups))
    stepped = tests.withColumn("_s", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)))
    return stepped.withColumn("adjusted", F.max("_s").over(w)).drop("_s")


def detectable(sd: Column, n: Column, z_power: float = 0.84) -> Column:
    return (1.96 + z_power) * sd / F.sqrt(n)


def required_n(sd: Column, effect: Column, z_power: float = 0.84) -> Column:
    return F.ceil(F.pow((1.96 + z_power) * sd / effect, 2)).cast("long")


def stratified(items: DataFrame, category: str, item: str, n: int, seed: str) -> DataFrame:
    """Of each category its share of n items, at least one, by the order of a seeded digest. A sample is the feature here."""
    sizes = items.groupBy(category).agg(F.count(F.lit(1)).alias("_c"))
    total = sizes.agg(F.sum("_c").alias("_t"))
    quota = sizes.crossJoin(F.broadcast(total)).select(category, F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_c") / F.col("_t")).cast("int")).alias("_q"))  # total is one row
    w = Window.partitionBy(category).orderBy(F.sha2(F.concat(F.col(item).cast("string"), F.lit(seed)), 256), item)
    return items.withColumn("_k", F.row_number().over(w)).join(F.broadcast(quota), category).where("_k <= _q").drop("_k", "_q")


def quota_sample(items: DataFrame, relation: str, item: str, each: int, total: int, seed: str) -> DataFrame:
    """At most `each` items of a relation and `total` of all, in the order of a seeded digest."""
    h = F.sha2(F.concat(F.col(item).cast("string"), F.lit(seed)), 256)
    w = Window.partitionBy(relation).orderBy(h, item)
    return items.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= each).orderBy(h, item).limit(total).drop("_k")


def base_failures(results: DataFrame, item: str, arm: str, base: str, metric: str, below: float) -> DataFrame:
    """(item) whose base arm has a metric under `below`; an item that the base arm didn't answer is none."""
    return results.where((F.col(arm) == base) & (F.col(metric) < below)).select(item).distinct()


def compared(results: DataFrame, run: str, baseline: str, keys: list[str], metric: str) -> DataFrame:
    """(keys..., metric, base, gain): every run's metric against the baseline's."""
    base = results.where(F.col(run) == baseline).select(*keys, F.col(metric).alias("base"))
    return results.where(F.col(run) != baseline).join(base, keys, "left").select(run, *keys, metric, "base", (F.col(metric) - F.col("base")).alias("gain"))


def grand_total(rows: DataFrame, key: str, counts: list[str], label: str = "TOTAL") -> DataFrame:
    """A row for each key and one for all."""
    out = rows.rollup(key).agg(*[F.sum(c).alias(c) for c in counts], F.grouping(key).alias("_g"))
    return out.withColumn(key, F.when(F.col("_g") == 1, label).otherwise(F.col(key).cast("string"))).drop("_g")


def set_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two results are equal as sets, and as bags."""
    differs = lambda x, y: x.limit(0) if x is y else x.exceptAll(y)
    sets = reduce(DataFrame.unionAll, [a.subtract(b), b.subtract(a)]).agg(F.count(F.lit(1)).alias("s"))
    bags = reduce(DataFrame.unionAll, [differs(a, b), differs(b, a)]).agg(F.count(F.lit(1)).alias("g"))
    return sets.crossJoin(bags).select((F.col("s") == 0).alias("same_set"), (F.col("g") == 0).alias("same_bag"))  # one row each
