"""Joins of similar sets and names against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import similarity as sim


def names(seed, n):
    rng = random.Random(seed)
    parts = ["al", "ber", "ca", "dor", "el", "fin", "gar", "hal", "io", "x", " ", "st"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(n)]
    return [x[: len(x) // 2] + rng.choice("abxz") + x[len(x) // 2 + 1 :] if rng.random() < 0.3 else x for x in made + made[: n // 3]]


@pytest.mark.parametrize(("measure", "threshold", "meet"), [("jaccard", 0.45, 1), ("jaccard", 0.8, 2), ("dice", 0.82, 2), ("dice", 0.3, 2), ("dice", 1.0, 1)])
def test_similar_sets_are_all_pairs(spark, measure, threshold, meet):
    rng = random.Random(threshold)
    sets = {i: sorted({f"w{int(rng.random() ** 3 * 40)}" for _ in range(rng.randrange(0, 9))}) for i in range(150)}
    table = spark.createDataFrame([(i, s, i % 2) for i, s in sets.items()], "id long, items array<string>, g long")

    def reaches(a, b):
        same = len({*a} & {*b})
        return same and (same / (len({*a} | {*b})) if measure == "jaccard" else 2 * same / (len(a) + len(b))) >= threshold - 1e-12

    got = {(r.a, r.b) for r in sim.similar_sets(table, table, threshold, measure, meet, ordered=True).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and reaches(sets[a], sets[b])}
    keyed = {(r.a, r.b) for r in sim.similar_sets(table, table, threshold, measure, meet, ("g",)).collect()}
    assert keyed == {(a, b) for a in sets for b in sets if a % 2 == b % 2 and reaches(sets[a], sets[b])}


@pytest.mark.parametrize("threshold", [0.82, 0.5])
def test_closest_names_by_brute_force(spark, threshold):
    said = [(k, x) for k in ("p", "q") for x in names(k, 60)] + [("p", ""), ("q", "Al  BER"), ("r", "alone")]
    known = [(k, x) for k in ("p", "q") for x in names(k + "2", 60)] + [("q", " al ber "), ("p", "  ")]
    plain = lambda x: " ".join(x.lower().split())
    got = {(r.k, r.gold): (r.verdict, r.best, r.ratio) for r in sim.closest(spark.createDataFrame(known, "k string, name string"), spark.createDataFrame(said, "k string, gold string"), "k", threshold).collect()}
    assert set(got) == set(said)
    for k, x in said:
        pool = {plain(y) for j, y in known if j == k and plain(y)}
        if plain(x) in pool:
            assert got[k, x] == ("HIT", plain(x), 1.0)
            continue
        ratio, best = min(((-SequenceMatcher(None, plain(x), y).ratio(), y) for y in pool), default=(0, None))
        assert got[k, x] == (("NEAR", best, -ratio) if -ratio >= threshold else ("MISS", None, None))


def test_characters_tell_the_multiset(spark):
    assert spark.range(1).select(sim.characters(F.lit("abba a")).alias("c")).first().c == ["a#0", "b#0", "b#1", "a#1", " #0", "a#2"]
    assert spark.range(1).select(sim.characters(F.lit("")).alias("c")).first().c == []
