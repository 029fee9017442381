"""Message passing, gated attention and verdicts on streams against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.operators import attention as at
from lodegraph.plans.store import WorldModelStore
from lodegraph.streaming import spans

RNG = np.random.default_rng(5)


def layer(relations, ins, outs, heads):
    return at.Layer(RNG.normal(size=(relations, ins, outs)), RNG.normal(size=(heads, outs // heads)), RNG.normal(size=(heads, outs // heads)), RNG.normal(size=outs))


def passed(h, edges, p):
    """A loop over nodes and heads."""
    heads, width = p.source.shape
    out = np.tile(p.bias, (len(h), 1))
    for v in range(len(h)):
        own = [(h[s] @ p.weight[r], h[v] @ p.weight[r]) for s, r, d in edges if d == v and s < len(h)]
        for k in range(heads if own else 0):
            cut = slice(k * width, (k + 1) * width)
            z = np.array([a[cut] @ p.source[k] + b[cut] @ p.target[k] for a, b in own])
            z = np.where(z > 0, z, at.SLOPE * z)
            w = np.exp(z - z.max())
            out[v, cut] += (w[:, None] * np.array([a[cut] for a, _ in own])).sum(0) / w.sum()
    return np.maximum(out, 0)


@pytest.fixture(scope="module")
def graph(spark):
    """A hub with most edges, repeated edges, loops, a node without any, and an edge to a node that isn't there."""
    h = RNG.normal(size=(60, 5)) * 3
    edges = [(i, i % 3, 0) for i in range(60) for _ in range(1 + i % 2)] + [(0, 1, i) for i in range(1, 59)] + [(i, 2, i) for i in range(5)] + [(99, 0, 3)]
    nodes = spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(h)], "node_id string, h array<double>").repartition(3)
    return h, edges, nodes, spark.createDataFrame([(str(a), r, str(b)) for a, r, b in edges], "src string, rel int, dst string").repartition(4)


@pytest.mark.parametrize("share", [at.SHARE, 3])
def test_layers_equal_loops(graph, monkeypatch, share):
    monkeypatch.setattr(at, "SHARE", share)
    h, edges, nodes, table = graph
    layers, w, b = [layer(3, 5, 6, 2), layer(3, 6, 4, 2)], RNG.normal(size=(5, 4)), RNG.normal(size=4)
    want = passed(passed(h, edges, layers[0]), edges, layers[1]) + h @ w + b
    got = {int(r.node_id): r.h for r in at.encoded(nodes, table, layers, w, b).collect()}
    assert np.allclose([got[i] for i in range(60)], want)


def test_without_edges_only_the_linear_map_is_left(graph):
    h, _, nodes, table = graph
    w, b = RNG.normal(size=(5, 4)), RNG.normal(size=4)
    got = {int(r.node_id): r.h for r in at.encoded(nodes, table.limit(0), [layer(3, 5, 4, 2)], w, b).collect()}
    assert np.allclose([got[i] for i in range(60)], h @ w + b)


@pytest.mark.parametrize("alpha", [0.0, 0.7])
def test_gated_attention_equals_a_loop(spark, alpha):
    states = {(s, p): RNG.normal(size=4) for s in range(4) for p in range(9)}
    states[3, 8] = np.zeros(4)
    banks = {(s, u, k): RNG.normal(size=3) for s in range(3) for u in range(3) for k in range(u + 2)}
    g = at.Gate(*[RNG.normal(size=x) for x in ((4, 4), (3, 4), (3, 4), (4, 4), 4, 4)], 2, alpha)
    rows = spark.createDataFrame([(s, p, v.tolist()) for (s, p), v in states.items()], "seq long, pos long, h array<double>").repartition(3)
    bank = spark.createDataFrame([(s, u, k, v.tolist()) for (s, u, k), v in banks.items()], "seq long, chunk long, slot long, e array<double>")
    got = {(r.seq, r.pos): r for r in at.gated_attention(rows, bank, F.when(F.col("pos") >= 2, F.floor((F.col("pos") - 2) / 3)), g).collect()}
    assert len(got) == len(states)
    for (s, p), h in states.items():
        slots = [e for (q, u, _), e in banks.items() if q == s and p >= 2 and u == (p - 2) // 3]
        more = np.zeros(4)
        if slots:
            away = h - h.mean()
            q = (away / np.sqrt((away**2).mean() + 1e-5) * g.gain + g.shift) @ g.query
            k, v = np.array(slots) @ g.key, np.array(slots) @ g.value
            z = [np.exp(k[:, c] @ q[c] / np.sqrt(2)) for c in (slice(0, 2), slice(2, 4))]
            more = np.tanh(alpha) * np.concatenate([w @ v[:, c] / w.sum() for w, c in zip(z, (slice(0, 2), slice(2, 4)), strict=True)]) @ g.out
        assert np.allclose(got[s, p].h, h + more) and np.isclose(got[s, p].contribution, np.linalg.norm(more) / np.linalg.norm(h) if h.any() else 0)
    if not alpha:  # a closed gate changes nothing, bit by bit
        assert all(got[k].h == v.tolist() for k, v in states.items())


def test_spans_are_judged_by_the_version_of_their_time(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "Ada L."), ("p", "Paris"), ("r", "Rome")], "node_id string, label string")
    edges = lambda *rows: spark.createDataFrame(rows, "src string, rel string, dst string")
    store, at_ = WorldModelStore(spark, str(tmp_path / "store")), str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    v = spans.SpanValidation(spark.readStream.schema("text_id long, text string").parquet(at_), {"lives in": "home"}, store, "facts", "m")
    text = "ADA L lives in Paris! She sings. Ada L. lives in  rome. Bob lives in Rome.  lives in Rome"
    for version, e in (("v1", edges(("a", "home", "p"))), ("v2", edges(("a", "home", "r")))):
        store.save(nodes, e, "facts", version, "m")
        spark.createDataFrame([(1 if version == "v1" else 2, text), (None, None)], "text_id long, text string").write.mode("append").parquet(at_)
        v.drain()
    got = {(r.text_id, r.checkpoint): (r.verdict, r.version) for r in v.verdicts().collect()}
    assert [got[1, k] for k in range(2)] == [("SUPPORTED", "v1"), ("NOT_COVERED", "v1")] and [got[2, k][1] for k in range(2)] == ["v2", "v2"]
    assert got[2, 0] == ("CONTRADICTED", "v2")
    assert len(got) == 12
