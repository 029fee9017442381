"""Reach by bitmaps over more starts than one bucket holds, against searches from each start."""

import random
from collections import Counter, defaultdict

import pytest

from lodegraph.operators import graph as g
from lodegraph.operators import reach


@pytest.fixture(scope="module")
def world():
    """Nodes with few neighbours, a hub that many share, a part that nothing leads to."""
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(1500)}", "x", f"n{rng.randrange(1500)}") for _ in range(1700)] + [(f"n{i}", "h", "hub") for i in range(0, 400, 3)] + [("p", "x", "q"), ("q", "x", "q")]
    near = defaultdict(set)
    for a, _, b in edges:
        near[a].add(b)
        near[b].add(a)
    return edges, near


def steps_from(near, start, most):
    """node -> least steps, 0 for the start."""
    found, frontier = {start: 0}, {start}
    for d in range(1, most + 1):
        frontier = {m for n in frontier for m in near[n]} - set(found)
        found |= dict.fromkeys(frontier, d)
    return found


def test_support_of_many_starts(spark, world):
    edges, near = world
    starts = [f"n{i}" for i in range(0, 1500) if f"n{i}" in near][: reach.SEEDS + 40] + ["p", "nowhere"]
    assert len(starts) > reach.SEEDS
    table = spark.createDataFrame(edges, "src string, rel string, dst string")
    ids = spark.createDataFrame([(x,) for x in starts + starts[:9]], "node_id string")
    support, least = Counter(), {}
    for start in starts:
        for node, d in steps_from(near, start, 2).items():
            if d and node not in starts:
                support[node] += 1
                least[node] = min(d, least.get(node, 9))
    want = sorted(((n, c, least[n]) for n, c in support.items()), key=lambda r: (-r[1], r[2], r[0]))
    assert [tuple(r) for r in g.expand(table, ids, 2, limit=10_000).collect()] == want
    kinds = spark.createDataFrame([(n, "even" if n[-1] in "02468" else "odd") for n in near], "node_id string, type string")
    even = [r for r in want if r[0][-1] in "02468"]
    assert [tuple(r) for r in g.expand(table, ids, 2, kinds, "even", limit=10_000).collect()] == even
    assert g.expand(table, ids.limit(0), 2).count() == 0


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_path_lengths(spark, world, most):
    edges, near = world
    rng = random.Random(most)
    pairs = [(f"n{rng.randrange(1500)}", f"n{rng.randrange(300)}") for _ in range(1600)] + [("n3", "n3"), ("p", "q"), ("q", "n1"), ("hub", "n6"), ("n6", "n9")]
    table = spark.createDataFrame(edges, "src string, rel string, dst string")
    found = {a: steps_from(near, a, most) for a, _ in pairs}
    got = Counter(tuple(r) for r in g.path_lengths(table, spark.createDataFrame(pairs, "a string, b string"), most).collect())
    assert got == Counter((a, b, found[a].get(b)) for a, b in pairs)


def test_distribution_counts_pairs(spark, world):
    edges, near = world
    hits = [f"n{i}" for i in range(0, 400)] + ["hub", "p", "q"]
    table = spark.createDataFrame(edges, "src string, rel string, dst string")
    want = Counter()
    for i, a in enumerate(hits):
        found = steps_from(near, a, 3)
        want.update(found.get(b) for b in hits[i + 1 :])
    got = {r.steps: r.n for r in g.path_distribution(table, spark.createDataFrame([(x,) for x in hits], "node_id string"), 3).collect()}
    assert got == want
