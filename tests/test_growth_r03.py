"""Steps of round 3 that shuffled, wrote or held more than their input asks for: same results, and plans that show the difference."""

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import graph as g


@pytest.fixture
def unsent(spark):
    """No table is small enough to be sent, as with large ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def edges(spark):
    return spark.createDataFrame([("a", "r", "b"), ("a", "r", "b"), ("b", "s", "c"), ("c", "s", "a"), ("b", "r", None), ("d", "r", "b"), ("e", "s", "d"), ("f", "r", "f")], "src string, rel string, dst string")


def test_chains_shuffle_the_edges_once(unsent):
    e = edges(unsent)
    rows, front = [tuple(r) for r in e.collect()], {("a", ""), ("f", "")}
    both = [(s, r, d) for s, r, d in rows] + [(d, "~" + r, s) for s, r, d in rows]
    for _ in range(3):
        front = {(d, f"{c}>{r}" if c else r) for n, c in front for s, r, d in both if s == n and n is not None}
    want = {c: sum(x == c for _, x in front) for _, c in front}
    out = g.chains(e, unsent.createDataFrame([("a",), ("f",), (None,)], "node_id string"), 3)
    assert {r.chain: r.ends for r in out.collect()} == want
    assert plan(out).count("ReusedExchange") >= 2


def test_levels_shuffle_no_edges_for_what_was_seen(spark, monkeypatch):
    held, plain = [], g.kept
    monkeypatch.setattr(g, "kept", lambda df: held.append(plan(df)) or plain(df))
    out = g.levels(edges(spark), spark.createDataFrame([("a",)], "node_id string"), 3)
    assert {(r.depth, r.node_id) for r in out.collect()} == {(1, "b"), (1, "c"), (2, "d"), (2, None), (3, "e")}
    assert len(held) == 4 and not any("LeftAnti" in p for p in held)
    assert all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in held[1:])


def test_few_seeds_are_sent_to_the_edges(spark):
    e = spark.createDataFrame([("o1", "has", "p1"), ("o1", "has", "p1"), ("o2", "has", "p1"), ("o3", "has", "p1"), ("o3", "has", "p2"), ("o1", "has", "p2"), ("o1", "has", "x"), ("o4", "has", "x"), ("o5", "has", "p1")], "src string, rel string, dst string")
    nodes = spark.createDataFrame([(n, t) for n, t in [("o1", "order"), ("o2", "order"), ("o2", "order"), ("o3", "order"), ("o4", "order"), ("o5", "order"), ("p1", "part"), ("p1", "part"), ("p2", "part"), ("x", "other")]], "node_id string, type string")
    out = g.shared_entities(e, spark.createDataFrame([("o1",), ("o5",), ("o1",)], "node_id string"), nodes, ["part"], "order", 9)
    assert [tuple(r) for r in out.collect()] == [("o3", 2), ("o2", 1)]
    text = plan(out)
    assert "LeftAnti" not in text and "LeftSemi" not in text


def test_omissions_are_counted_without_a_row_for_each(spark):
    from lodegraph.operators import verify as v

    spans = spark.createDataFrame([(1, "s", "r", "Red Box"), (1, "t", "r", "blue box"), (2, "s", "r", None), (3, "s", "r", "red box"), (3, "s", "r", "Green"), (3, "s", "r", "blue"), (4, "u", "r", "red box"), (5, None, "r", "x")], "buffer_id long, subject string, rel string, span string")
    facts = spark.createDataFrame([("s", "r", "red box"), ("s", "r", "RED box"), ("s", "r", "green"), ("s", "r", "blue"), ("s", "r", "blue"), ("t", "r", "red box"), ("t", "r", None), ("s", "q", "other")], "subject string, rel string, name string")
    _, omitted = v.buffers(spans, facts, facts.select("name"))
    want = {r.buffer_id: r.n for r in omitted.groupBy("buffer_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = v.omission_counts(spans, facts)
    assert {r.buffer_id: r.omitted for r in out.collect()} == want and want[2] == 4 and 3 not in want
    assert "LeftAnti" not in plan(out)


def test_pairs_without_a_vector_go_by_ids(unsent):
    from lodegraph.operators import attribution as a

    vectors = unsent.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    queries = unsent.createDataFrame([(7, [1.0, 0.0]), (8, [-1.0, 0.0])], "query_id long, embedding array<double>")
    allowed = unsent.createDataFrame([(q, v) for q in (7, 8, 9) for v in (0, 3, 3, 4, 90, 91)], "query_id long, vec_id long")
    out = a.nearest_allowed(vectors, queries, allowed, 2)
    assert {(r.query_id, r.vec_id, r.score, r["rank"]) for r in out.collect()} == {(7, 4, 4.0, 1), (7, 3, 3.0, 2), (8, 0, 0.0, 1), (8, 3, -3.0, 2)}
    assert "LeftSemi" in plan(out)


@pytest.mark.parametrize("each", [1, 1000])
def test_pairs_of_members_are_dealt_to_more_tasks(spark, monkeypatch, each):
    monkeypatch.setattr(g, "MEMBERS", each)
    rows = [(1, 5), (1, 6), (1, 6), (1, 7), (2, 6), (2, 5), (3, 7), (3, 7), (4, 6), (4, 7), (None, 5), (None, 6)]
    out = g.together(spark.createDataFrame(rows, "o long, p long"))
    assert {tuple(r) for r in out.collect()} == {(5, 6, 2), (6, 7, 2)}
    assert out.rdd.getNumPartitions() == max(4, 12 // each)


def test_an_export_is_written_compressed(spark, tmp_path):
    from lodegraph.plans import corpora

    nodes = spark.range(3000).select(F.concat(F.lit("n"), "id").alias("node_id"), F.lit("a <label>").alias("label"), F.lit("k").alias("kind"))
    links = nodes.select(F.col("node_id").alias("src"), F.lit("r").alias("rel"), F.lit("n1").alias("dst"))
    size = {}
    for c in ("none", "gzip"):
        said = corpora.export_graph(nodes, links, str(tmp_path / c), {}, compression=c)
        assert said["num_nodes"] == said["num_edges"] == 3000
        size[c] = sum(f.stat().st_size for f in (tmp_path / c).rglob("part-*"))
    read = lambda c, p: sorted(r.value for r in spark.read.text(str(tmp_path / c / p)).collect())
    assert all(read("none", p) == read("gzip", p) for p in ("nodes", "edges", "graphml"))
    assert size["gzip"] * 4 < size["none"]


def test_words_of_sentences_are_counted_once_for_chunks(spark):
    import random
    import re
    import time

    from lodegraph.functions import text as t

    def chunks(text, most, overlap):
        out, now = [], []
        for s in [x for x in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", text.strip(" ")) if x]:
            n = lambda xs: sum(len(re.split(r"[ \t\n\x0b\f\r]+", x)) for x in xs)
            if now and n(now) + n([s]) > most:
                out.append(" ".join(now))
                last = []
                for x in reversed(now):
                    if n(last) + n([x]) > overlap:
                        break
                    last.insert(0, x)
                now = [*last, s]
            else:
                now.append(s)
        return out + ([" ".join(now)] if now else [])

    rng = random.Random(3)
    texts = ["", " ", "a", "a. b", *(" ".join(rng.choice(["w", "x.", "y  z!", "q?\n"]) for _ in range(rng.randrange(80))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for most, overlap in ((4, 2), (9, 3), (30, 30), (1, 0)):
        got = {r.i: r.c for r in df.select("i", t.sentence_chunks(F.col("text"), most, overlap).alias("c")).collect()}
        assert got == {i: chunks(x, most, overlap) for i, x in enumerate(texts)}
    long = spark.range(400).select(F.concat(F.repeat(F.lit("a b c. "), 500), F.col("id").cast("string")).alias("text"))
    began = time.time()
    assert long.select(F.sum(F.size(t.sentence_chunks(F.col("text"))))).first()[0] == 400 * 7
    assert time.time() - began < 5


def test_pairs_of_a_query_and_a_document_are_not_shuffled(spark):
    from lodegraph.operators import retrieval as r

    docs = spark.createDataFrame([(1, "a b b c"), (1, "a x"), (2, "c c"), (3, None), (4, "z"), (5, "b a")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a b"), (8, "c q"), (9, None)], "query_id long, text string")
    found = r.matched(docs, r.kept(asked))
    out = r.min_max(found, "query_id", docs.count(), {"score": "b", "same": "o"})
    got = {(x.query_id, x.doc_id): (x.same, round(x.b, 6), round(x.o, 6)) for x in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {(7, 1): 3, (7, 5): 2, (8, 1): 1, (8, 2): 1}
    assert max(v[1] for v in got.values()) == 1.0 and got[7, 1][2] == 1.0 and got[7, 5][2] == round(2 / 3, 6)
    assert not any("hashpartitioning(query_id" in line and "doc_id" in line for line in plan(found).splitlines())


def test_blended_search_hands_on_few_rows(spark):
    import random

    from lodegraph.operators import retrieval as r

    rng = random.Random(4)
    words = lambda: None if rng.random() < 0.05 else rng.sample("abcdefgh", rng.randrange(6))
    vector = lambda w: [None, None] if w is None else [rng.choice([0.0, 0.6, -1.0]), rng.choice([0.0, 0.8])]
    docs = [(rng.choice([None, 1, 2, 3]), i % 700, w, vector(w)) for i in range(1500) for w in [words()]]
    asked = [(q, w, vector(w)) for q in range(9) for w in [words()]]
    own = spark.createDataFrame(docs, "a long, b long, words array<string>, vector array<double>")
    queries = spark.createDataFrame(asked, "query_id long, words array<string>, vector array<double>")
    share = F.when((F.size("w") == 0) | (F.size("words") == 0), 0.0).otherwise(F.size(F.array_intersect("w", "words")) / F.size("w"))
    score = 0.65 * r.dot(F.col("v"), F.col("vector")) + 0.35 * share
    every = own.join(F.broadcast(queries.toDF("query_id", "w", "v"))).select("query_id", "a", "b", score.alias("score")).where("score > 0")
    want = every.withColumn("rank", F.row_number().over(r.Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "a", "b"))).where("rank <= 3")
    rows = lambda df: sorted(((x.query_id, x["rank"], x.a, x.b, x.score) for x in df.collect()), key=str)
    assert rows(r.blended(own, queries, ["a", "b"], 3, (0.65, 0.35))) == rows(want)
    held = [(q, w, v) for q, w, v in asked if w is not None]
    sent = own.select("a", "b", "words", "vector").mapInArrow(r._blended(held, 3, (0.65, 0.35), ["a", "b"]), "query_id long, a long, b long, score double")
    assert sent.count() <= 4 * 9 * 9 < every.count()


def test_only_edges_before_enough_near_ones_meet_the_labels(spark, monkeypatch):
    from lodegraph.operators import context

    nodes = spark.createDataFrame([("b", "red"), ("d", "blue thing"), ("e", "red thing and more"), ("x", "blue sea"), ("y", "red sky"), ("z", None)], "node_id string, label string")
    links = [("a", "r", "b"), ("a", "r", "b"), ("c", "blue", "e"), ("x", "r", "y"), ("w", "red", "x"), ("z", "r", "b"), ("d", "r", "a"), (None, "red", "x"), ("y", "red", "z")]
    e = spark.createDataFrame(links, "src string, rel string, dst string")
    held, plain = [], context.kept
    monkeypatch.setattr(context, "kept", lambda df: held.append(plain(df)) or held[-1])
    rows = lambda most, few: [tuple(r) for r in context.keyword_subgraph(nodes, e, ["red", "blue"], most, few).collect()]
    first = [(None, "red", "x"), ("a", "r", "b"), ("c", "blue", "e")]
    assert rows(3, 1) == first
    assert rows(1, 1) == first[:1]  # it has two words, and comes before the only near one
    assert held[2].count() == 1 and rows(50, 1) == sorted(set(links), key=lambda x: tuple(v or "" for v in x))


class States:
    """State of one key as a processor's handle gives it; calls are counted."""

    def __init__(self, value=None):
        self.value, self.entries, self.calls = None, [], 0

    def getValueState(self, name, schema):
        head = States()
        head.get = lambda: self.called() or self.value
        head.update = lambda value: self.called() or setattr(self, "value", value)
        return head

    def getListState(self, name, schema):
        later = States()
        later.get = lambda: self.called() or iter(self.entries)
        later.appendValue = lambda value: self.called() or self.entries.append(value)
        later.clear = lambda: self.called() or self.entries.clear()
        return later

    def registerTimer(self, at):
        self.called()

    deleteTimer = registerTimer

    def called(self):
        self.calls += 1


def pushed(states, m, parts):
    """Rows of a key whose tokens (at, pos) come part by part, each to a new worker."""
    from pyspark.sql import Row

    from lodegraph.streaming.chunks import ChunkProcessor

    out = []
    for part in parts:
        p = ChunkProcessor(m, 1000, 10**9)
        p.init(states)
        out += p.handleInputRows((7,), iter([Row(at=at, pos=pos, token=f"t{pos}") for at, pos in part]), None)
    return [tuple(r) for r in out]


def test_calls_on_the_state_of_a_key_dont_grow_with_its_tokens():
    calls = []
    for n in (4, 400):
        states = States()
        out = pushed(states, 4, [[(k, k * n + i) for i in range(1, n)] for k in range(3)] + [[(3, 0)]])
        assert [r[1] for r in out] == list(range(len(out))) and out[0][2] == "t0 t1 t2 t3"
        calls.append(states.calls)
    assert max(calls) <= 20


@pytest.mark.parametrize("seed", range(8))
def test_chunks_of_tokens_that_come_in_any_order(seed):
    import random

    rng = random.Random(seed)
    pos = list(range(120))
    rng.shuffle(pos)
    near = sorted(range(120), key=lambda p: p + rng.randrange(30))
    for order in (pos, near):
        states, parts, at = States(), [], 0
        while at < len(order):
            n = rng.randrange(1, 12)
            parts.append([(at + i, p) for i, p in enumerate(order[at : at + n])])
            at += n
        out = pushed(states, 3, parts)
        assert out == [(7, k, f"t{3 * k} t{3 * k + 1} t{3 * k + 2}", "complete", 3) for k in range(40)]
        assert sum(len(p) for p, _ in states.entries) == states.value[4] == 0


@pytest.mark.parametrize("sent", [200_000, 0])
def test_edges_of_relations_without_a_triple_are_not_shuffled(unsent, monkeypatch, sent):
    from lodegraph.plans import rules

    monkeypatch.setattr(rules, "SENT_NODES", sent)
    rows = [("a", "r", "b"), ("b", "r", "a"), ("a", "r", "a"), ("a", "q", "b"), ("a", "q", "b"), ("t", "q", "t"), ("t", None, "a"), ("a", "q", "gone"), ("gone", "q", "b"), (None, "q", "a"), ("a", "q", None), ("a", "r", "t"), ("u", "q", "u"), ("e", "r", "b")]
    kinds = [("a", "A"), ("b", "B"), ("t", "A"), ("t", "B"), ("u", None), ("e", ""), ("alone", "A"), (None, "A")]
    e, n = unsent.createDataFrame(rows, "src string, rel string, dst string"), unsent.createDataFrame(kinds, "node_id string, type string")
    triples = [("A", "r", "B"), ("x", "s", "y")]
    want = [(s, r, d) for s, r, d in rows for i, x in kinds for j, y in kinds if s is not None and d is not None and i == s and j == d and not any(r == q and {(x or "concept", y or "concept")} & {(a, b), (b, a)} for a, q, b in triples)]
    got = rules.invalid_edges(e, n, unsent.createDataFrame(triples, "a string, rel string, b string"))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect()) and ("t", "q", "t") in want
    assert rules.invalid_edges(e, n, unsent.createDataFrame([], "a string, rel string, b string")).count() == 0
    assert ("hashpartitioning" in plan(rules.between(e, n))) == (sent == 0)
