"""Suffix ranks of many sequences by distributed prefix doubling, and the intervals of their suffix array.

A position's rank at length L orders its next L symbols among all positions'. The
rank at 2L is that of the pair (rank at L here, rank at L one length on). Only
positions whose rank is shared stay: a stretch that occurs once has no longer repeat.
So a round's rows are the repeats of its length, and rounds end when none is left.
Equal ranks are neighbours in the suffix array; a group of them is an interval
whose longest common prefix is L symbols or more. `longest` narrows these intervals to exact
lengths by going back through the rounds: a prefix grows by each power of two, from the
largest down, by which it is still shared.

A symbol that is in more than a thousandth of all rows is dealt to many tasks (`join_hot`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import discard, join_hot, materialise

PLACE = ["rk", "ord", "pos"]


def _ranked(rows: DataFrame, by: list[str], keep: list[str] = PLACE, ordered: bool = True) -> DataFrame:
    """Of rows whose key stands at two places at least, the columns `keep` and r, the key's rank. Ranks keep the keys' order, unless only equality is asked for, and have gaps. A place given twice counts once."""
    place = F.xxhash64("rk", "pos")
    counted = rows.groupBy(*by).agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"), F.count(F.lit(1)).alias("_n")).where("_lo <> _hi")
    ranks = materialise((counted.orderBy(*by) if ordered else counted).select(*by, F.monotonically_increasing_id().alias("_rank"), "_n"))
    out = materialise(join_hot(rows, ranks, by, "_n").select(*keep, F.col("_rank").alias("r")).distinct())
    discard(ranks)
    return out


def first_ranks(symbols: DataFrame, by: list[str]) -> DataFrame:
    """(rk, ord, pos, r) at length 1 of symbols (rk, ord, pos, by...). rk names a sequence, ord orders sequences."""
    return _ranked(symbols, by)


def longer(ranks: DataFrame, step: int) -> DataFrame:
    """Ranks of stretches longer by `step` than those of `ranks`, at most twice as long: pairs of ranks `step` apart.

    A stretch that would run past its sequence's end is like no other.
    """
    ahead = ranks.select("rk", "ord", (F.col("pos") - step).alias("pos"), F.col("r").alias("r2"))
    return _ranked(ranks.join(ahead, PLACE), ["r", "r2"])


def at_length(first: DataFrame, length: int) -> DataFrame:
    """Ranks at a length, by doubling and one step that overlaps."""
    now, reached = first, 1
    while reached < length:
        step = min(reached, length - reached)
        before, now, reached = now, longer(now, step), reached + step
        if before is not first:
            discard(before)
    return now


def all_lengths(first: DataFrame) -> list[tuple[int, DataFrame]]:
    """(length, ranks) for each power of two that has repeats."""
    out, length = [], 1
    while not first.isEmpty():
        out.append((length, first))
        first, length = longer(first, length), 2 * length
    return out


def longest(levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """(rk, longest) of `all_lengths`, at least one: the length of each sequence's longest stretch that stands elsewhere too.

    It is the largest longest common prefix of one of the sequence's suffixes with a neighbour in the suffix array. A class is
    the interval of all places with a stretch in common; q marks those at which a sequence's longest may begin. From
    the highest level of a sequence's ranks down, classes split by what follows. A sequence asks on in the longer class if one of its
    places is there, else in the one before; classes in which nobody asks are dropped, so a place is in one class for each level at most.
    """
    tops = materialise(reduce(DataFrame.unionByName, [r.select("rk", F.lit(length).alias("top")).distinct() for length, r in levels]).groupBy("rk").agg(F.max("top").alias("top")))
    now = None
    for length, ranks in reversed(levels):
        asks = tops.where(F.col("top") == length).select("rk", F.lit(True).alias("q"))
        begun = ranks.join(asks, "rk", "left").select(*PLACE, F.lit(length).alias("len"), F.coalesce("q", F.lit(False)).alias("q"), F.lit(2 * length).alias("level"), F.col("r").alias("c"))
        before, grown = now, None
        if now is None:
            now = begun
        else:
            on = ranks.select("rk", "ord", F.col("pos").alias("_at"), F.col("r").alias("r2"))
            ahead = now.withColumn("_at", F.col("pos") + F.col("len")).join(on, ["rk", "ord", "_at"])
            grown = _ranked(ahead, ["level", "c", "r2"], [*PLACE, "len", "q"], ordered=False)
            moved = grown.where("q").select("rk", F.lit(True).alias("_moved")).distinct()
            stay = now.join(moved, "rk", "left").withColumn("q", F.col("q") & F.col("_moved").isNull()).drop("_moved")
            grown_on = grown.select(*PLACE, (F.col("len") + length).alias("len"), "q", F.lit(2 * length + 1).alias("level"), F.col("r").alias("c"))
            now = begun.unionByName(stay).unionByName(grown_on)
        asked = materialise(now.groupBy("level", "c").agg(F.max("q").alias("_any"), F.count(F.lit(1)).alias("_n")).where("_any"))
        now = materialise(join_hot(now, asked, ["level", "c"], "_n").drop("_any", "_n"))
        discard(asked, *[x for x in (before, grown) if x is not None])
    return now.where("q").groupBy("rk").agg(F.max("len").cast("long").alias("longest"))


def later_copies(ranks: DataFrame) -> DataFrame:
    """(rk, pos) of every repeat but the first of its group, by sequence order and place."""
    first = materialise(ranks.groupBy("r").agg(F.min(F.struct("ord", "rk", "pos")).alias("first"), F.count(F.lit(1)).alias("_n")))
    return join_hot(ranks, first, ["r"], "_n").where("first.ord <> ord or first.rk <> rk or first.pos <> pos").select("rk", "pos")
