"""Steps whose work once grew faster than their input: same results, and rows or time that stay in proportion."""

import time
from hashlib import sha256
from math import exp, lgamma, log

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import retrieval as r
from lodegraph.operators import stats as s


@pytest.mark.parametrize("ahead", [20, 1])
def test_random_control_sorts_few_pairs(spark, monkeypatch, ahead):
    """With 1 for AHEAD some queries have too few items below the bound and are looked at again."""
    held = []
    plain = r.kept
    monkeypatch.setattr(r, "kept", lambda df: held.append(plain(df)) or held[-1])
    monkeypatch.setattr(r, "AHEAD", ahead)
    items, queries = spark.range(4000).toDF("id"), spark.createDataFrame([(f"q{i}",) for i in range(20)], "query_id string")
    got = {(x.query_id, x["rank"]): x.id for x in r.random_control(items, queries, "query_id", "id", 5).collect()}
    want = {f"q{q}": sorted(range(4000), key=lambda i: sha256(f"q{q}|{i}".encode()).hexdigest())[:5] for q in range(20)}
    assert got == {(q, k): i for q, ids in want.items() for k, i in enumerate(ids, 1)}
    assert held[0].count() < 2 * ahead * 5 * 20
    assert (held[1].count() > 0) == (ahead == 1)


def test_mcnemar_takes_as_many_steps_as_terms(spark):
    b, c = 12_000, 11_900
    want = min(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * log(2)) for i in range(c + 1)))
    df = spark.createDataFrame([(b, c)], "b long, c long")
    began = time.time()
    assert df.select(s.mcnemar(F.col("b"), F.col("c")).alias("p")).first()["p"] == pytest.approx(want, abs=1e-7)
    assert time.time() - began < 10


def test_rounded_vectors_keep_the_sign_of_zero_as_sql_does(spark):
    import duckdb

    from lodegraph.queries.attention import _rounded

    xs = [-0.000004, 0.000004, -0.000006, 0.0, -1.234567]
    got = spark.createDataFrame([(xs,)], "h array<double>").select(_rounded("h").alias("h")).first()["h"]
    assert list(map(str, got)) == [str(duckdb.execute("SELECT round(?::DOUBLE, 5)", [x]).fetchone()[0]) for x in xs]


def test_an_entity_of_many_edges_meets_no_claim_but_by_its_least_document(spark, monkeypatch):
    """Edges that lead to nothing that is mentioned aren't multiplied by claims; claims with one question share its documents."""
    from lodegraph.operators import attribution as a

    edges = spark.range(300).select(F.lit("hub").alias("src"), F.concat(F.lit("far"), "id").alias("dst"), (F.col("id") + 5).alias("doc_id")).unionByName(spark.createDataFrame([("o1", "hub", 400)], "src string, dst string, doc_id long"))
    claims = spark.range(1, 101).select(F.lit(1).cast("long").alias("item_id"), F.col("id").alias("claim_id"), F.concat(F.lit("o"), "id").alias("subject"))
    mentions = claims.select("claim_id", F.col("subject").alias("node_id")).unionByName(claims.select("claim_id", F.lit("hub").alias("node_id")))
    assert a._between(mentions, edges).count() == 1
    assert {tuple(x) for x in a.verified(claims, mentions, edges).collect()} == {(1, 400)}
    assert {tuple(x) for x in a.located(mentions, edges).collect()} == {(1, 400), *((k, 5) for k in range(2, 101))}
    near, asks = spark.createDataFrame([("q", "hub", 0.5)], "question_id string, node_id string, score double"), claims.select("claim_id", F.lit("q").alias("question_id"))
    allowed = spark.createDataFrame([(1, 7), (1, 9)], "item_id long, doc_id long")
    assert {tuple(x) for x in a.dense(claims, near, edges, allowed, asks).collect()} == {(k, 7) for k in range(1, 101)}


def test_expansion_works_out_few_ends_with_bits(spark, monkeypatch):
    """Ends whose bound is under the floor never meet the bits, and the first ones are those of all; by one, two and three hops."""
    import random

    from lodegraph.operators import graph as g
    from lodegraph.operators import reach

    rng = random.Random(4)
    pairs = [(f"s{rng.randrange(40)}", f"p{int(rng.random() ** 3 * 60)}") for _ in range(300)] + [(f"p{int(rng.random() ** 3 * 60)}", f"o{int(rng.random() ** 2 * 900)}") for _ in range(2500)] + [("s1", "o3"), ("s2", "o3"), ("s3", "s3")]
    edges = spark.createDataFrame([(a, "x", b) for a, b in pairs], "src string, rel string, dst string")
    names = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([(x, x[0]) for x in names], "node_id string, type string")
    near = {x: set() for x in names}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    held, plain = [], reach.kept
    monkeypatch.setattr(reach, "kept", lambda df: held.append(plain(df)) or held[-1])
    monkeypatch.setattr(reach, "AHEAD", 3)
    for hops in (1, 2, 3):
        seen = {}
        for seed in [x for x in names if x[0] == "s"]:
            now, met = {seed}, {}
            for h in range(1, hops + 1):
                now = {y for x in now for y in near[x]}
                for x in now:
                    met.setdefault(x, h)
            for x, h in met.items():
                seen.setdefault(x, []).append(h)
        want = sorted((-len(h), min(h), x) for x, h in seen.items() if x[0] == "o")[:10]
        held.clear()
        got = g.expand(edges, nodes.where("type = 's'"), hops, nodes, "o", limit=10).collect()
        assert [(-r.support, r.min_hops, r.node_id) for r in got] == want
        if hops == 2:
            assert held[-1].count() < sum(x[0] == "o" for x in names) / 2


@pytest.mark.parametrize("hub", [2, 6, 10_000])
def test_pairs_are_searched_one_by_one_without_bits(spark, monkeypatch, hub):
    """By loops, whatever counts as a hub; where none does, no bits are made."""
    import random

    from lodegraph.operators import graph as g
    from lodegraph.operators import reach

    rng = random.Random(hub)
    edges = [(f"n{rng.randrange(40)}", "x", f"n{int(rng.random() ** 2 * 40)}") for _ in range(60)]
    pairs = sorted({(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(150)}) + [("n1", "n1"), ("n1", "none")]
    near = {}
    for a, _, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def steps(a, b, most):
        now = {a}
        for h in range(most + 1):
            if b in now:
                return h
            now = {y for x in now for y in near.get(x, ())}

    bits = []
    monkeypatch.setattr(reach, "HUB", hub)
    plain = reach.seeds_as_bits
    monkeypatch.setattr(reach, "seeds_as_bits", lambda df: bits.append(1) or plain(df))
    e, p = spark.createDataFrame(edges, "src string, rel string, dst string"), spark.createDataFrame(pairs, "a string, b string")
    for most in (1, 2, 3):
        got = {(r.a, r.b): r.steps for r in g.path_lengths(e, p, most).collect()}
        assert got == {(a, b): steps(a, b, most) for a, b in pairs}
    assert bool(bits) == (hub < 10_000)


def test_character_sums_of_long_texts(spark):
    from collections import Counter
    from re import findall

    texts = [None, "", "--", "Ab c9 ab", "Café İx ß\nZ", " ".join(f"w{i}x{i * 7}" for i in range(240_000))]
    began = time.time()
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", r.char_sum_vector(F.col("t")).alias("v")).collect()
    assert time.time() - began < 20
    for row in rows:
        if texts[row.i] is None:
            assert row.v == [None] * 8
            continue
        n = Counter(sum(map(ord, w)) % 8 for w in findall("[a-z0-9]+", texts[row.i].lower()))
        length = sum(x * x for x in n.values()) ** 0.5 or 1.0
        assert row.v == pytest.approx([n[k] / length for k in range(8)])


def test_runs_of_capitals_are_found_once_a_text(spark):
    from lodegraph.functions import text as t

    runs = [f"Word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efghijklmn'[i // 1000]}" for i in range(5000)]
    began = time.time()
    got = spark.createDataFrame([(" and ".join([*runs, *runs, runs[7].lower(), "Yes", "Abc Def", "Abc Def"]),)], "t string").select(t.title_runs(F.col("t")).alias("v")).first()["v"]
    assert got == [*runs, "Abc Def"] and time.time() - began < 20


def test_paths_to_near_terms_look_no_farther(spark, monkeypatch):
    """Enough matches at two steps: what lies behind them, and what lies near them, is not gathered."""
    from lodegraph.operators import context as x

    edges = spark.range(1000).select(F.concat(F.when(F.col("id") < 30, "s").otherwise("c"), "id").alias("src"), F.lit("in").alias("rel"), F.lit("hub").alias("dst"))
    edges = edges.union(edges).union(spark.createDataFrame([("hub", "in", "r")], "src string, rel string, dst string"))
    nodes = edges.select(F.col("src").alias("node_id")).distinct().withColumn("label", F.when(F.col("node_id").startswith("s"), "blue").otherwise("red"))
    held, plain = [], x.kept
    monkeypatch.setattr(x, "kept", lambda df: held.append(plain(df)) or held[-1])
    got = [tuple(r) for r in x.paths_to_terms(edges, nodes, spark.createDataFrame([("r",)], "node_id string"), ["blue"]).collect()]
    assert got == [("r", s, 2, f"r>hub>{s}", 1) for s in sorted(f"s{i}" for i in range(30))[:20]]
    assert max(df.count() for df in held) <= 31


def test_rare_neighbors_sort_no_more_than_the_rarest(spark):
    from lodegraph.operators import graph as g

    edges = spark.createDataFrame([("q", "x", f"n{i}") for i in range(40)] + [(f"n{i}", "x", f"m{k}") for i in range(40) for k in range(i // 4)], "src string, rel string, dst string")
    linked = spark.createDataFrame([("a", "q")], "query_id string, node_id string")
    out = g.rare_neighbors(edges, linked, 7)
    whole = {(r.node_id, r["rank"]) for r in g.rare_neighbors(edges, linked).collect() if r["rank"] <= 7}
    assert {(r.node_id, r["rank"]) for r in out.collect()} == whole and len(whole) == 7
    assert "(degree#" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "<= _most#" in plan


@pytest.mark.parametrize("hub,classes", [(0, 2000), (2, 2000), (2, 2), (10_000, 2000)])
def test_distances_are_those_of_loops_whatever_is_a_hub(spark, monkeypatch, hub, classes):
    import random

    from lodegraph.operators import graph as g
    from lodegraph.operators import reach

    rng = random.Random(hub + classes)
    edges = [(f"n{int(rng.random() ** 3 * 60)}", "x", f"n{rng.randrange(60)}") for _ in range(75)]
    hits = sorted({f"n{rng.randrange(60)}" for _ in range(30)} | {"n0", "n1"})
    near = {}
    for a, _, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    monkeypatch.setattr(reach, "HUB", hub)
    monkeypatch.setattr(reach, "CLASSES", classes)
    e, h = spark.createDataFrame(edges, "src string, rel string, dst string"), spark.createDataFrame([(x,) for x in hits], "node_id string")
    for most in (1, 3):
        want = {}
        for i, a in enumerate(hits):
            now, met = {a}, {a: 0}
            for k in range(1, most + 1):
                now = {y for x in now for y in near.get(x, ())}
                for y in now:
                    met.setdefault(y, k)
            for b in hits[:i]:
                want[met.get(b)] = want.get(met.get(b), 0) + 1
        assert {r.steps: r.n for r in g.path_distribution(e, h, most).collect()} == want


def test_a_hub_hands_no_bits_to_its_neighbours(spark, monkeypatch):
    from lodegraph.operators import graph as g
    from lodegraph.operators import reach

    monkeypatch.setattr(reach, "HUB", 100)
    hits = spark.range(200).select(F.concat(F.lit("s"), "id").alias("node_id")).union(spark.createDataFrame([("hub",)], "node_id string"))
    edges = spark.range(700).select(F.concat(F.when(F.col("id") < 200, "s").otherwise("c"), "id").alias("src"), F.lit("in").alias("rel"), F.lit("hub").alias("dst"))
    held, plain = [], reach.kept
    monkeypatch.setattr(reach, "kept", lambda df: held.append(plain(df)) or held[-1])
    monkeypatch.setattr(reach, "discard", lambda *dfs: None)
    assert {r.steps: r.n for r in g.path_distribution(edges, hits).collect()} == {1: 200, 2: 19_900}
    assert max(df.count() for df in held if "b0" in df.columns) <= 201
