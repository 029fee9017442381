"""Reach by bitmaps: which of many starts reach a node, a bit for each start.

Starts are numbered; SEEDS of them share a bucket, and a node that any start of a bucket reaches has one row for it, with WORDS longs of bits. A step
along the edges ORs the rows of a node's neighbours, which merges on the map side and stays in whole-stage code. So a hop
costs edges times buckets, not starts times the degree of the hubs that they share. Where only some ends are asked for, the search
is two-sided: the nodes that lie near enough to the ends are found as plain sets, and the forward levels keep to them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.durable import discard, kept, numbered

WORDS = 16
SEEDS = 64 * WORDS
#: More edges lead to a hub.
HUB = 1000
#: How many times the ends asked for are worked out to find a floor.
AHEAD = 40
#: Hubs that hits are classed by, a bit for each, and how many classes may be met with each other.
HUBS, CLASSES = 64, 2000
#: Up to three steps, a node may serve as a hub from this part of HUB on: hits meet there by lists otherwise, by the square of their number.
EARLY = 16
#: Longs of a sieve, a power of two.
SIEVE = 1 << 20
BITS = [f"b{i}" for i in range(WORDS)]


def bucket(number: str) -> Column:
    return F.floor(F.col(number) / SEEDS).cast("long")


def seeds_as_bits(starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of starts (node_id): (node_id, number) and (node_id, bucket, BITS)."""
    known = kept(numbered(starts.select("node_id").distinct(), ["node_id"]))
    return known, known.select("node_id", *as_bits("number"))


def as_bits(number: str) -> list[Column]:
    """bucket and BITS of a number."""
    bit = F.expr(f"shiftleft(1L, cast({number} % 64 as int))")
    at = F.floor((F.col(number) % SEEDS) / 64)
    return [bucket(number).alias("bucket"), *[F.when(at == i, bit).otherwise(F.lit(0).cast("long")).alias(b) for i, b in enumerate(BITS)]]


def as_word(number: str) -> list[Column]:
    """at and w of a number: which long its bit is in, and the long. One column of bits is compiled where BITS, on many rows, are interpreted."""
    return [F.expr(f"cast({number} div 64 as long)").alias("at"), F.expr(f"shiftleft(1L, cast({number} % 64 as int))").alias("w")]


def gathered(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node_id", "at").agg(F.bit_or("w").alias("w"))


#: Of a hash _h, which long of a sieve a node's three bits are in, and these; never null, so that no filter works them out first.
_AT = f"shiftrightunsigned(_h, 20) & {SIEVE - 1}L"
_BITS = "shiftleft(1L, cast(_h & 63 as int)) | shiftleft(1L, cast(shiftright(_h, 6) & 63 as int)) | shiftleft(1L, cast(shiftright(_h, 12) & 63 as int))"


def _sieve(members: DataFrame) -> DataFrame:
    """(_at, _m): members (node_id) as bits of hashes, SIEVE rows at most."""
    return kept(members.select(F.xxhash64("node_id").alias("_h")).select(F.expr(_AT).alias("_at"), F.expr(_BITS).alias("_m")).groupBy("_at").agg(F.bit_or("_m").alias("_m")))


def sifted(rows: DataFrame, column: str, sieve: DataFrame) -> DataFrame:
    """Of rows those whose column may be a member: all members and few others, so that an exact join shuffles little else."""
    there = rows.withColumn("_h", F.xxhash64(column)).withColumn("_at", F.expr(_AT)).join(F.broadcast(sieve), "_at")  # SIEVE rows at most
    return there.where(F.bitwise_not("_m").bitwiseAND(F.expr(_BITS)) == 0).drop("_h", "_at", "_m")


def merged(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.groupBy("node_id", "bucket").agg(*[F.bit_or(b).alias(b) for b in BITS], *more)


def ones() -> Column:
    """How many bits a row has."""
    return reduce(lambda a, b: a + b, [F.bit_count(b) for b in BITS]).cast("long")


def levels(step: DataFrame, seeds: DataFrame, hops: int, ends: DataFrame | None = None, spare: int = 0) -> list[DataFrame]:
    """(node_id, bucket, BITS) for each number of hops from 1 on: the starts from which a walk of just so many steps (node_id, other) leads to the node.

    With ends (node_id) the last level holds these alone, and those before it only nodes from which ends can still be reached. The spare last levels are left out.
    """
    near: dict[int, DataFrame] = {}
    if ends is not None:
        near[0] = ends.select("node_id").distinct()
        for k in range(1, hops // 2 + 1):
            if k < hops:
                near[k] = kept(near[k - 1].join(step, "node_id").select(F.col("other").alias("node_id")).union(near[k - 1]).distinct())
    frontier, out = seeds, []
    for hop in range(1, hops + 1 - spare):
        along = step
        if hops - hop in near:  # before the join, so that hubs' other edges never meet the bits
            along = step.join(near[hops - hop].withColumnRenamed("node_id", "other"), "other")
        frontier = kept(merged(frontier.join(along, "node_id").select(F.col("other").alias("node_id"), "bucket", *BITS)))
        out.append(frontier)
    discard(*[n for k, n in near.items() if k])
    return out


def support(step: DataFrame, starts: DataFrame, hops: int, ends: DataFrame | None = None) -> DataFrame:
    """(node_id, support, min_hops): how many starts (node_id) reach a node within hops, by how few steps; with ends, of these alone."""
    _, seeds = seeds_as_bits(starts)
    found = [level.withColumn("hop", F.lit(h)) for h, level in enumerate(levels(step, seeds, hops, ends), 1)]
    if ends is not None:
        found = [level.join(ends.select("node_id").distinct(), "node_id", "left_semi") for level in found[:-1]] + found[-1:]
    once = merged(reduce(DataFrame.unionByName, found), F.min("hop").alias("hop"))
    return once.groupBy("node_id").agg(F.sum(ones()).alias("support"), F.min("hop").cast("long").alias("min_hops"))


def top_support(step: DataFrame, starts: DataFrame, hops: int, ends: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows of `support` at ends (node_id), by support, then hops, then id.

    The last step, to the many ends, is first taken with counts instead of bits: what the neighbours of an end have between them is as much as it can have. The
    ends with the largest bounds are worked out with bits; their limit-th support is a floor, and only ends whose bound reaches it are worked out then.
    """
    _, seeds = seeds_as_bits(starts)
    wanted = kept(ends.select("node_id").distinct())
    found = levels(step, seeds, hops, wanted if hops > 2 else None, 1)
    last = found[-1] if found else seeds
    into = kept(step.join(wanted.withColumnRenamed("node_id", "other"), "other", "left_semi").select("node_id", "other"))
    early = [level.join(wanted, "node_id", "left_semi").withColumn("hop", F.lit(h)) for h, level in enumerate(found, 1)]
    counts = last.groupBy("node_id").agg(F.sum(ones()).alias("c"))
    sums = reduce(DataFrame.unionByName, [into.join(counts, "node_id").select(F.col("other").alias("node_id"), "c"), *[level.select("node_id", ones().alias("c")) for level in early]])
    bound = kept(sums.groupBy("node_id").agg(F.sum("c").alias("most")))

    def exact(who: DataFrame) -> DataFrame:
        own = into.join(who.select(F.col("node_id").alias("other")), "other", "left_semi")
        ending = merged(last.join(own, "node_id").select(F.col("other").alias("node_id"), "bucket", *BITS)).withColumn("hop", F.lit(hops))
        once = merged(reduce(DataFrame.unionByName, [ending, *[level.join(who.select("node_id"), "node_id", "left_semi") for level in early]]), F.min("hop").alias("hop"))
        counted = once.groupBy("node_id").agg(F.sum(ones()).alias("support"), F.min("hop").cast("long").alias("min_hops"))
        return counted.orderBy(F.desc("support"), "min_hops", "node_id").limit(limit)

    if bound.count() <= AHEAD * limit:
        return exact(bound)
    first = exact(kept(bound.orderBy(F.desc("most")).limit(AHEAD * limit)))
    floor = first.agg(F.min("support").alias("floor"))
    return exact(kept(bound.join(F.broadcast(floor), F.col("most") >= F.col("floor")).select("node_id")))  # one row


def pair_steps(step: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """pairs (a, b) with steps long, the length of the shortest path, null if it is longer than most.

    Up to three steps, pairs whose b few edges lead to are searched pair by pair; the others by bits.
    """
    if most > 3:
        return _steps_by_bits(step, pairs, most)
    into = kept(step.groupBy(F.col("other").alias("b")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HUB).select("b"))
    asked = kept(pairs.select("a", "b").distinct())
    light, heavy = asked.join(into, "b", "left_anti"), kept(asked.join(into, "b", "left_semi"))
    found = _steps_of_pairs(step, light.select("a", "b"), into, most)
    if not heavy.isEmpty():
        found = found.unionByName(_steps_by_bits(step, heavy.select("a", "b"), most))
    return pairs.join(found, ["a", "b"], "left").select("a", "b", F.when(F.col("a") == F.col("b"), F.lit(0).cast("long")).otherwise(F.col("steps")).alias("steps"))


def _steps_of_pairs(step: DataFrame, pairs: DataFrame, hubs: DataFrame, most: int) -> DataFrame:
    """(a, b, steps) of those pairs (a, b), once each, that lie within most steps, three at most. No b is one of hubs (b).

    The nodes y before a pair's b are few, so (a, y) is asked of what is one step and two steps from a. For two, the nodes before y are looked up among the first steps of a;
    where y is a hub the first steps of a go on to hubs instead.
    """
    pairs = kept(pairs)
    first = kept(pairs.select(F.col("a").alias("node_id")).distinct().join(step, "node_id").select(F.col("node_id").alias("a"), F.col("other").alias("x")).distinct())
    parts = [pairs.join(first.withColumnRenamed("x", "b"), ["a", "b"], "left_semi").withColumn("h", F.lit(1))]
    if most > 1:
        before = pairs.select("b").distinct().join(step.select(F.col("other").alias("b"), F.col("node_id").alias("y")), "b").distinct()
        asked = kept(pairs.join(before, "b").select("a", "b", "y"))
        parts.append(asked.join(first.withColumnRenamed("x", "y"), ["a", "y"], "left_semi").select("a", "b", F.lit(2).alias("h")))
    if most > 2:
        hub = hubs.withColumnRenamed("b", "y")
        ways = asked.select("a", "y").distinct()
        edge = step.select(F.col("node_id").alias("x"), F.col("other").alias("y"))
        plain = ways.join(hub, "y", "left_anti").join(edge, "y").join(first, ["a", "x"], "left_semi").select("a", "y")
        busy = first.join(edge.join(hub, "y", "left_semi"), "x").select("a", "y").join(ways, ["a", "y"], "left_semi")
        far = plain.unionByName(busy).distinct()
        parts.append(asked.join(far, ["a", "y"], "left_semi").select("a", "b", F.lit(3).alias("h")))
    return reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(F.min("h").cast("long").alias("steps"))


def _steps_by_bits(step: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """As `pair_steps`; a pair looks its own bit up in the rows of b."""
    known, seeds = seeds_as_bits(pairs.select(F.col("a").alias("node_id")))
    numbers = known.select(F.col("node_id").alias("a"), "number", bucket("number").alias("bucket"))
    found = [level.withColumn("h", F.lit(h)) for h, level in enumerate(levels(step, seeds, most, pairs.select(F.col("b").alias("node_id"))), 1)]
    own = F.array(*BITS)[((F.col("number") % SEEDS) / 64).cast("int")]
    hit = F.expr("shiftright({w}, cast(number % 64 as int)) & 1L".replace("{w}", "w")) == 1
    asked = pairs.select("a", "b").distinct().join(numbers, "a")
    met = asked.join(reduce(DataFrame.unionByName, found).withColumnRenamed("node_id", "b"), ["b", "bucket"]).withColumn("w", own).where(hit)
    least = met.groupBy("a", "b").agg(F.min("h").cast("long").alias("steps"))
    return pairs.join(least, ["a", "b"], "left").select("a", "b", F.when(F.col("a") == F.col("b"), F.lit(0).cast("long")).otherwise(F.col("steps")).alias("steps"))


def distances(step: DataFrame, hits: DataFrame, most: int) -> DataFrame:
    """(steps, n): how many pairs of two hits (node_id) lie so many steps apart, null for more than most. Pairs are counted, never made.

    Edges must lead both ways in step. Nodes with more than HUB hits around them would hand all of these on to each of their neighbours, so ways through them are no bits:
    hits with the same distances to the hubs are a class, and classes meet. Only what a hit reaches past all hubs is kept as bits, and counted where its class doesn't reach it already.
    """
    known, seeds = seeds_as_bits(hits)
    total = known.agg(F.count(F.lit(1)).cast("long").alias("k"))
    parts = _few_steps(step, known, most) if most <= 3 else _many_steps(step, known, seeds, most)
    within = reduce(DataFrame.unionByName, parts).unionByName(total.select(F.lit(0).cast("long").alias("h"), F.col("k").alias("x"))).unionByName(total.select(F.lit(most + 1).cast("long").alias("h"), (F.col("k") * F.col("k")).alias("x")))
    ahead = within.withColumnsRenamed({"h": "g", "x": "y"}).withColumn("g", F.col("g") + 1)
    counted = within.join(ahead, F.col("h") == F.col("g")).select(F.when(F.col("h") <= most, F.col("h")).alias("steps"), ((F.col("x") - F.col("y")) / 2).cast("long").alias("n"))  # a row for each number of steps
    return counted.where("n > 0")


def _most_met(around: DataFrame, floor: int) -> DataFrame:
    """Of (node_id, n) the nodes that serve as hubs, by more than floor hits around them."""
    return kept(around.where(F.col("n") > floor).orderBy(F.desc("n"), "node_id").limit(HUBS).select("node_id"))


def _met(placed: DataFrame, most: int) -> list[DataFrame]:
    """(u, class, n, own) for each number of steps: classes whose members meet through a hub, by how many pairs in both orders, own of these of a hit with itself."""
    sizes = kept(placed.groupBy("class", *_within(most)).agg(F.count(F.lit(1)).alias("n")))
    pairs = sizes.alias("u").join(F.broadcast(sizes.alias("v")), F.lit(True))  # CLASSES rows at most
    own = F.when(F.col("u.class") == F.col("v.class"), F.col("u.n")).otherwise(F.lit(0)).alias("own")
    return [kept(pairs.where(reduce(lambda a, b: a | b, [F.col(f"u.c{i}").bitwiseAND(F.col(f"v.c{h - i}")) != 0 for i in range(h + 1)])).select(F.col("u.class").alias("u"), F.col("v.class").alias("class"), (F.col("u.n") * F.col("v.n")).alias("n"), own)) for h in range(most + 1)]


def _covered(met: DataFrame, bits: DataFrame) -> DataFrame:
    """(class, bucket, _BITS): the hits that a class meets through a hub. bits (class, bucket, BITS)."""
    return kept(met.join(bits, "class").groupBy(F.col("u").alias("class"), "bucket").agg(*[F.bit_or(b).alias(f"_{b}") for b in BITS]))


def _class_bits(seeds: DataFrame, placed: DataFrame) -> DataFrame:
    return kept(merged(seeds.join(placed, "node_id").select(F.col("class").alias("node_id"), "bucket", *BITS)).withColumnRenamed("node_id", "class"))


def _few_steps(step: DataFrame, known: DataFrame, most: int) -> list[DataFrame]:
    """(h, x) for 1 to most, three at most: how many hits lie within h steps of each other, in both orders and each with itself.

    Two hits next to one node are two steps apart: each node hands a hit next to it the list of those of a larger number, so bits are only made where a hit gathers them. For three steps
    two nodes next to hits must be next to each other. All edges are read, but only those that a sieve lets through are joined or shuffled.
    """
    whole = known.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.max("number"), F.lit(0)).alias("last")).first()
    near = sifted(step, "node_id", _sieve(known)).join(known, "node_id").select("other", F.col("number").cast("int" if whole.last < 1 << 31 else "long").alias("a"))
    near = kept(near.repartition("other").distinct()).where("other is not null")
    sizes = kept(near.groupBy("other").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("other", "node_id"))
    busy = kept(sizes.where(F.col("n") > HUB).select(F.col("node_id").alias("other")))
    plain = near.join(busy, "other", "left_anti")
    lists = kept(plain.groupBy("other").agg(F.sort_array(F.collect_list("a")).alias("near")))  # of HUB numbers at most
    hubs = _most_met(sizes, HUB // EARLY)
    seeds = known.select("node_id", *as_bits("number"))
    met = None
    if not hubs.isEmpty():
        hubs, placed = _hub_classes(step, known, hubs, most, (near.join(busy, "other"), lists, sizes))
        bits = _class_bits(seeds, placed)
        met = _met(placed, most)
        placed = kept(placed.join(known, "node_id").select(F.col("number").alias("node_id"), "class"))
    along = F.broadcast(hubs)  # HUBS rows at most
    ends = known.select(F.col("node_id").alias("other"), F.col("number").alias("b"))
    so_far = kept(gathered(near.join(ends, "other").where("a < b").select(F.col("a").cast("long").alias("node_id"), *as_word("b"))))
    # busy nodes that aren't hubs hand on bits
    others = near.join(busy.join(along.withColumnRenamed("node_id", "other"), "other", "left_anti"), "other")
    parts, one = [], F.lit(1).cast("long")
    for h in range(1, most + 1):
        more = []
        if h == 2:
            tails = lists.join(along.withColumnRenamed("node_id", "other"), "other", "left_anti").select(F.col("near"), F.posexplode("near").alias("i", "node_id")).select(F.col("node_id").cast("long").alias("node_id"), F.expr("slice(near, i + 2, size(near))").alias("after")).where(F.size("after") > 0)
            more.append(gathered(tails.repartition("node_id").select("node_id", F.explode("after").alias("b")).select("node_id", *as_word("b"))))
            if not busy.isEmpty():
                more.append(_handed(gathered(others.select(F.col("other").alias("node_id"), *as_word("a"))), others))
        if h == 3:
            outer = known.join(along, "node_id", "left_anti").select(F.col("number").alias("a"))
            through = kept((near if met is None else near.join(outer, "a")).select(F.col("other").alias("node_id")).distinct().join(along, "node_id", "left_anti"))
            sieve = _sieve(through)
            inner = kept(sifted(sifted(step, "node_id", sieve), "other", sieve))
            inner = kept(inner.join(through, "node_id", "left_semi").join(through.withColumnRenamed("node_id", "other"), "other", "left_semi").distinct())
            if not inner.isEmpty():
                first = gathered(near.join(inner.select(F.col("node_id").alias("other")).distinct(), "other").select(F.col("other").alias("node_id"), *as_word("a")))
                more.append(_handed(gathered(first.join(inner, "node_id").select(F.col("other").alias("node_id"), "at", "w")), near))
        if more:
            so_far = kept(gathered(reduce(DataFrame.unionByName, [so_far, *more])))
        if met is None:
            x = so_far.agg((F.coalesce(F.sum(F.bit_count("w").cast("long")), F.lit(0)) * 2 + whole.k).alias("x"))
        else:
            words = F.posexplode(F.array(*[f"_{b}" for b in BITS])).alias("i", "_w")
            covered = _covered(met[h], bits).select("class", "bucket", words).where("_w <> 0").select("class", (F.col("bucket") * WORDS + F.col("i")).alias("at"), "_w")
            past = F.bit_count(F.col("w").bitwiseAND(F.bitwise_not(F.coalesce("_w", F.lit(0).cast("long"))))).cast("long")
            x = so_far.join(placed, "node_id").join(covered, ["class", "at"], "left").agg((F.coalesce(F.sum(past), F.lit(0)) * 2 + whole.k).alias("x")).unionByName(met[h].agg((F.coalesce(F.sum("n"), F.lit(0)) - F.coalesce(F.sum("own"), F.lit(0))).alias("x"))).agg(F.sum("x").alias("x"))
        parts.append(x.select((one * h).alias("h"), "x"))
    return parts


def _handed(words: DataFrame, near: DataFrame) -> DataFrame:
    """(node_id, at, w): to each hit, near (other, a), the bits (node_id, at, w) of the nodes next to it, of larger numbers only."""
    rows = words.withColumnRenamed("node_id", "other").join(near.select("other", F.col("a").cast("long").alias("a")), "other").where("at >= a div 64")
    return gathered(rows.select(F.col("a").alias("node_id"), "at", F.expr("if(at = a div 64, w & shiftleft(-2L, cast(a % 64 as int)), w)").alias("w")))


def _many_steps(step: DataFrame, known: DataFrame, seeds: DataFrame, most: int) -> list[DataFrame]:
    """As `_few_steps`, for any number of steps: all bits go along the edges."""
    one = F.lit(1).cast("long")
    near = known.select("node_id").join(step, "node_id").groupBy(F.col("other").alias("node_id")).agg(F.count(one).alias("n"))
    hubs = _most_met(near, HUB)
    met, placed = None, None
    if not hubs.isEmpty():
        hubs, placed = _hub_classes(step, known, hubs, most)
        along = F.broadcast(hubs)  # HUBS rows at most
        step = step.join(along, "node_id", "left_anti").join(along.withColumnRenamed("node_id", "other"), "other", "left_anti")
        bits = _class_bits(seeds, placed)
        seeds = seeds.join(along, "node_id", "left_anti")
        met = _met(placed, most)
    so_far, parts = seeds, []
    for h, level in enumerate(levels(step, seeds, most, seeds.select("node_id")), 1):
        so_far = kept(merged(so_far.unionByName(level.join(seeds.select("node_id"), "node_id", "left_semi"))))
        if met is None:
            x = so_far.agg(F.sum(ones()).alias("x"))
        else:
            own = so_far.join(placed.select("node_id", "class"), "node_id").join(_covered(met[h], bits), ["class", "bucket"], "left")
            past = reduce(lambda a, b: a + b, [F.bit_count(F.col(b).bitwiseAND(F.bitwise_not(F.coalesce(f"_{b}", F.lit(0).cast("long"))))) for b in BITS]).cast("long")
            x = own.agg(F.sum(past).alias("x")).unionByName(met[h].agg(F.sum("n").alias("x"))).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("x"))
        parts.append(x.select(F.lit(h).cast("long").alias("h"), F.coalesce("x", F.lit(0)).alias("x")))
    return parts


def _within(most: int) -> list[str]:
    return [f"c{i}" for i in range(most + 1)]


def _hub_classes(step: DataFrame, hits: DataFrame, hubs: DataFrame, most: int, near: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The hubs that are used, and (node_id, class, c0, c1, ..) of all hits: which hubs a hit has within 0, 1, .. steps, a bit for each; equal ones are a class.

    With more than CLASSES of them the lesser half of the hubs is given up. Up to three steps, near says what lies next to hits: (other, a) of busy nodes and a hit's number, (other, near) of the others
    and their lists, and all as (node_id): then the second step goes to these and to hits alone, and the third along them.
    """
    numbers = [r.node_id for r in hubs.collect()]  # HUBS rows at most
    masks = hubs.sparkSession.createDataFrame([(x, (1 << i) - (1 << 64 if i == 63 else 0)) for i, x in enumerate(numbers)], "node_id string, m long")
    ids = hits.select("node_id")
    frontier, found = masks, [masks.join(ids, "node_id", "left_semi").withColumn("h", F.lit(0))]
    for h in range(1, most + 1):
        if near is not None and h == 3:
            busy, lists, _ = near
            on = frontier.withColumnRenamed("node_id", "other")
            rows = lists.join(on, "other").select(F.explode("near").alias("a"), "m").unionByName(busy.join(on, "other").select("a", "m"))
            reached = rows.groupBy(F.col("a").cast("long").alias("number")).agg(F.bit_or("m").alias("m"))
            found.append(reached.join(hits, "number").select("node_id", "m").withColumn("h", F.lit(3)))
            break
        along = step if h < most else step.join(ids.withColumnRenamed("node_id", "other"), "other", "left_semi")
        if near is not None and h == 1:
            along = step.where(F.col("node_id").isin(numbers))
        if near is not None and h == 2:
            asked = _sieve(near[2].select("node_id").union(ids))
            along = kept(sifted(sifted(step, "node_id", _sieve(frontier)), "other", asked))
            # what of the first step leads on is little of it
            frontier = kept(frontier.join(along.select("node_id").distinct(), "node_id", "left_semi"))
        frontier = kept(frontier.join(along, "node_id").groupBy(F.col("other").alias("node_id")).agg(F.bit_or("m").alias("m")))
        found.append(frontier.join(ids, "node_id", "left_semi").withColumn("h", F.lit(h)))
    zero = F.lit(0).cast("long")
    reached = reduce(DataFrame.unionByName, found).groupBy("node_id").agg(*[F.bit_or(F.when(F.col("h") <= i, F.col("m")).otherwise(zero)).alias(c) for i, c in enumerate(_within(most))])
    near = kept(ids.join(reached, "node_id", "left").select("node_id", *[F.coalesce(c, zero).alias(c) for c in _within(most)]))
    used = len(numbers)
    while used > 1 and near.select(*_within(most)).distinct().count() > CLASSES:
        used //= 2
        near = near.select("node_id", *[F.col(c).bitwiseAND((1 << used) - 1).alias(c) for c in _within(most)])
    classes = numbered(near.select(*_within(most)).distinct(), _within(most)).withColumnRenamed("number", "class")
    return masks.where(F.col("node_id").isin(numbers[:used])).select("node_id"), kept(near.join(classes, _within(most)))
