"""Operators on small hand-built inputs with known answers."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodegraph.functions import text as t
from lodegraph.operators import graph as g
from lodegraph.operators import retrieval as r
from lodegraph.operators import stats as s
from lodegraph.operators import verify as v
from lodegraph.plans import builders, report, rules
from lodegraph.plans.store import WorldModelStore
from lodegraph.sources import code, readers
from lodegraph.streaming import chunks as c

EDGES = [("a", "x", "b"), ("b", "y", "c"), ("c", "x", "d"), ("a", "x", "b"), ("e", "z", "e"), ("a", "y", "d")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, rel string, dst string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_loop_is_once_or_twice(edges):
    assert g.incident(edges).where("node_id = 'e'").count() == 1
    assert g.incident(edges, loops_twice=True).where("node_id = 'e'").count() == 2


def test_neighbors_keep_orientation_and_duplicates(spark, edges):
    got = sorted(tuple(x) for x in g.neighbors(edges, ids(spark, "b")).select("src", "rel", "dst").collect())
    assert got == [("a", "x", "b"), ("a", "x", "b"), ("b", "y", "c")]
    assert g.neighbors(edges, ids(spark, "nobody")).count() == 0


def test_expand_counts_seeds_and_least_hops(spark, edges):
    got = [tuple(x) for x in g.expand(edges, ids(spark, "b", "d"), 2).collect()]
    assert got == [("a", 2, 1), ("c", 2, 1)]


def test_chain_against_edges(spark, edges):
    assert [x.node_id for x in g.chain(edges, ids(spark, "d"), ["~x", "~y"]).collect()] == ["b"]


def test_walk_takes_the_least_simple_path(spark, edges):
    got = {(x.node_id, x.hops): x.path for x in g.walk(edges, ids(spark, "a"), 2).collect()}
    assert got == {("b", 1): ["a", "b"], ("d", 1): ["a", "d"], ("c", 2): ["a", "b", "c"]}


def test_levels_without_revisits(spark, edges):
    assert sorted((x.depth, x.node_id) for x in g.levels(edges, ids(spark, "a"), 3).collect()) == [(1, "b"), (1, "d"), (2, "c")]


def test_shortest_paths(spark, edges):
    pairs = spark.createDataFrame([("a", "c"), ("a", "e")], "a string, b string")
    assert {x.b: x.steps for x in g.path_lengths(edges, pairs).collect()} == {"c": 2, "e": None}


def test_upsert_keeps_the_last_value_that_is_not_null(spark):
    rows = spark.createDataFrame([("n", "old", 1, 1), ("n", None, 2, 2)], "node_id string, a string, b int, ord int")
    assert tuple(g.upsert(rows).first()) == ("n", "old", 2)


def test_stored_edges_merge_and_need_both_ends(spark, edges):
    n = ids(spark, "a", "b", "c").withColumn("type", F.lit("t"))
    assert sorted(tuple(x) for x in g.stored(edges, n).collect()) == [("a", "x", "b"), ("b", "y", "c")]


def test_token_f1_is_a_multiset(spark):
    assert one(spark, t.token_f1(F.lit("the cat cat"), F.lit("cat"))) == pytest.approx(2 / 3)
    assert one(spark, t.token_f1(F.lit("the"), F.lit("a"))) == 1.0
    assert one(spark, t.exact_match(F.lit("The Cat!"), F.lit("cat"))) == 1


def test_answer_sets(spark):
    assert one(spark, t.answer_set(F.lit("Paris, the Rome and Paris"))) == ["paris", "rome"]


def test_sentence_chunks_overlap_by_whole_sentences(spark):
    assert one(spark, t.sentence_chunks(F.lit("a b. c d. e f."), 4, 2)) == ["a b. c d.", "c d. e f."]


def test_word_windows(spark):
    assert one(spark, t.word_windows(F.lit("a b c d e"), 3, 1)) == ["a b c", "c d e"]
    assert one(spark, t.word_windows(F.lit(""), 3)) == []


def test_json_array(spark):
    assert one(spark, t.json_array(F.lit('say ```json\n[{"a": [1]}]\n``` done'))) == '[{"a": [1]}]'
    assert one(spark, t.json_array(F.lit("none"))) is None


def test_hash_bucket_of_a_known_token(spark):
    bucket, sign = t.hash_bucket(F.lit("hello"))
    assert (one(spark, bucket), one(spark, sign)) == (300, -1.0)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.booleans()), min_size=1, max_size=12))
def test_auc_equals_all_pairs(spark, rows):
    pos, neg = [x for x, p in rows if p], [x for x, p in rows if not p]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else 0.5
    df = spark.createDataFrame([("g", x, p) for x, p in rows], "g string, v int, p boolean")
    assert s.auc(df, ["g"], "v", "p").first()["auc"] == pytest.approx(want)


def test_mcnemar(spark):
    from math import comb

    assert one(spark, s.mcnemar(F.lit(1), F.lit(9))) == pytest.approx(2 * sum(comb(10, i) for i in range(2)) / 2**10)
    assert one(spark, s.mcnemar(F.lit(0), F.lit(0))) == 1.0


def test_bootstrap_repeats_and_brackets(spark):
    df = spark.createDataFrame([(i, float(i % 5) - 1) for i in range(60)], "i int, d double")
    a, b = (s.bootstrap(df, "d", 300, 1).first() for _ in range(2))
    assert tuple(a) == tuple(b)
    assert a.low < a["mean"] < a.high and a.n == 60


def test_stratified_sample_has_every_category(spark):
    df = spark.createDataFrame([("a", i) for i in range(99)] + [("b", 100)], "c string, i int")
    got = s.stratified(df, "c", "i", 10, "x").groupBy("c").count().collect()
    assert {x.c: x["count"] for x in got} == {"a": 10, "b": 1}


def test_nearest_is_exact_with_ties_by_id(spark):
    vec = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [x.vec_id for x in r.nearest(vec, q, 2).orderBy("rank").collect()] == [1, 3]
    assert r.nearest(vec, q.limit(0), 2).count() == 0


def test_interleave_and_fallback(spark):
    row = lambda q, xs: [(q, x, i + 1) for i, x in enumerate(xs)]
    a = spark.createDataFrame(row(1, "abc"), "q int, id string, rank long")
    b = spark.createDataFrame(row(1, "xa") + row(2, "z"), "q int, id string, rank long")
    assert [x.id for x in r.interleaved(a, b, "q", "id", 9).where("q = 1").orderBy("rank").collect()] == ["a", "x", "b", "c"]
    assert {x.q for x in r.or_else(a, b, "q").collect()} == {1, 2}


def test_verdict_table(spark):
    e = spark.createDataFrame([("s", "TREATS", "d"), ("d", "IN", "far")], "src string, rel string, dst string")
    claims = spark.createDataFrame([(1, "s", "treats"), (2, "s", "treats"), (3, "s", "treats"), (4, "nobody", "treats"), (5, "s", None)], "claim_id int, subject string, rel string")
    men = spark.createDataFrame([(1, "d"), (2, "other"), (4, "d"), (5, "far")], "claim_id int, node_id string")
    got = {x.claim_id: (x.verdict, x.hops) for x in v.scoped_verdicts(claims, men, e, 2).collect()}
    assert got == {1: ("SUPPORTED", 1), 2: ("CONTRADICTED", None), 3: ("NOT_COVERED", None), 4: ("NOT_COVERED", None), 5: ("SUPPORTED", 2)}


def test_longest_match_wins_without_overlap(spark):
    aliases = spark.createDataFrame([("new york", "city"), ("york", "town"), ("new york times", "paper")], "alias string, node_id string")
    texts = spark.createDataFrame([(1, "The New York Times of York"), (2, None)], "id int, text string")
    assert sorted((x.pos, x.node_id) for x in v.link(texts, aliases, "id", "text").collect()) == [(1, "paper"), (5, "town")]


def test_polarity(spark):
    said = lambda text: one(spark, v.polarity(F.lit(text), F.lit("aspirin")))
    assert said("It does not treat aspirin") == "denied"
    assert said("It is not new, but aspirin helps") == "affirmed"
    assert said("nothing here") is None


def test_prefixes_end_only_after_a_name(spark):
    got = v.allowed_next(spark.createDataFrame([("red box",)], "name string")).collect()
    assert sorted(tuple(x) for x in got) == [("", "red"), ("red", "box"), ("red box", "<end>")]


@pytest.mark.parametrize("m", [1, 2, 3, 5, 8])
def test_chunk_geometry(spark, m):
    n = spark.range(0, 18).select(F.col("id").cast("int").alias("n"))
    for x in n.select("n", c.spans(F.col("n"), m).alias("s"), c.window_plan(F.col("n"), m).alias("w")).collect():
        assert [p for a, b in x.s for p in range(a, b)] == list(range(x.n))
        assert [p for a, b, _ in x.w for p in range(a, b)] == list(range(x.n))
        for a, b, u in x.w:
            for p in range(a, b):
                assert u == ((p - (m - 1)) // m if p >= m - 1 else None)
                assert u is None or (u + 1) * m - 1 <= p


def test_stream_waits_for_missing_tokens(spark, tmp_path):
    rows = [(1, 1, "b"), (1, 0, "a"), (1, 2, "c"), (1, 3, "d"), (2, 1, "y")]
    got = streamed_chunks(spark, tmp_path, [[(*r, k + 1) for r in part] for k, part in enumerate((rows[:1] + rows[4:], rows[1:4]))], 2, "1 day")
    assert got == [(1, 0, "a b", "complete", 2), (1, 1, "c d", "complete", 2)]


def streamed_chunks(spark, tmp_path, batches, m, patience):
    """Rows of the stream of batches of (key, pos, token, second), a trigger each."""
    for part in batches:
        rows = spark.createDataFrame(part, "key long, pos long, token string, at long")
        rows.select("key", "pos", "token", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, pos long, token string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return sorted((tuple(x) for x in c.drained(c.chunk_stream(stream, m, patience), "chunks").collect()), key=str)


def test_a_timer_closes_a_key_with_a_hole(spark, tmp_path):
    """Key 1 never gets its second token; key 2 moves the time on; then a token comes too late, and one goes on behind the closed chunk."""
    batches = [[(1, 0, "a", 1), (1, 2, "c", 2), (1, 3, "d", 3)], [(2, 0, "x", 5)], [(2, 1, "y", 500)], [(1, 1, "b", 501), (1, 4, "e", 502), (1, 5, "f", 503)], [(2, 2, "z", 2000)]]
    got = streamed_chunks(spark, tmp_path, batches, 2, "100 seconds")
    assert got == sorted([(1, 0, "a", "incomplete", 1), (1, 1, "c d", "complete", 2), (1, 2, "e f", "complete", 2), (1, None, None, "late", 1), (2, 0, "x", "incomplete", 1), (2, None, None, "late", 1)], key=str)


def test_sessions_equal_the_stream_on_random_tokens(spark, tmp_path):
    rng, rows = random.Random(8), []
    for k in range(12):
        at = 0
        for pos in range(rng.randrange(1, 40)):
            at += rng.choice([1, 2, 3, 90])
            if rng.random() > 0.15:
                rows.append((k, pos, f"{k}.{pos}", at))
    rows.sort(key=lambda r: r[3])
    table = spark.createDataFrame(rows, "key long, pos long, token string, at long").select("key", "pos", "token", F.timestamp_seconds("at").alias("ts"))
    want = sorted((tuple(x) for x in c.chunk_sessions(table, 3, "50 seconds").collect()), key=str)
    cut = len(rows) // 3
    assert streamed_chunks(spark, tmp_path, [rows[:cut], rows[cut : 2 * cut], rows[2 * cut :]], 3, "50 seconds") == want
    assert {r[3] for r in want} == {"complete", "incomplete", "late"}


def test_store_round_trip(spark, edges, tmp_path):
    store, calls = WorldModelStore(spark, str(tmp_path)), []
    build = lambda: (calls.append(1) or ids(spark, "a"), edges)
    for _ in range(2):
        n, e = store.get_or_build("src", "v1", "m", build)
    assert (n.count(), e.count(), len(calls)) == (1, len(EDGES), 1)
    assert store.manifest("src", "v1")["edges"] == len(EDGES)
    assert store.list_versions("src") == ["v1"] and store.list_models("src", "v1") == ["m"]
    store.delete_version("src", "v1")
    assert store.list_versions("src") == []
    with pytest.raises(FileNotFoundError):
        store.load("src", "v1", "m")


def test_document_tree(spark, tmp_path):
    for place, body in (("slack/general/dsid_1__hello.txt", "x\ny"), ("odd.txt", "z")):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text(body)
    got = sorted(tuple(x) for x in readers.document_tree(spark, str(tmp_path)).collect())
    assert got == [("", "", "unknown", "", "z"), ("dsid_1", "hello", "slack", "general", "x\ny")]


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    (tmp_path / "b.json").write_text('[{"id": "3"}]')
    assert readers.json_documents(spark, str(tmp_path / "a.jsonl"), "id string").count() == 2
    assert readers.json_documents(spark, str(tmp_path / "b.json"), "id string").count() == 1
    with pytest.raises(ValueError, match="not a JSON"):
        readers.json_documents(spark, "c.txt")


def test_graph_json(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a"}], "edges": [{"source": "a", "relation": "r", "target": "b"}, {"source": "a", "relation": "", "target": "b"}]}')
    n, e = readers.graph_json(spark, str(tmp_path / "g.json"))
    assert (n.count(), e.count()) == (1, 2)


def test_unknown_question_category_is_an_error(spark):
    raw = spark.createDataFrame([("1", "odd", "why")], "id string, type string, query string")
    with pytest.raises(Exception, match="unknown category"):
        readers.questions(raw, ["known"]).collect()


def test_turtle(spark):
    lines = [":Dog a owl:Class .", ":owns a owl:ObjectProperty .", ":owns rdfs:domain :Person .", ':owns rdfs:label "Owns" .', ":Dog rdfs:subClassOf :Animal ."]
    classes, props, subs = readers.turtle(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [x.name for x in classes.collect()] == ["Dog"]
    assert tuple(props.first()) == ("person", "OWNS", "entitynode")
    assert tuple(subs.first()) == ("Dog", "Animal")


def test_class_models_and_defects(spark):
    text = "Class a::B extends a::C { x: String[1]; y: a::C[0..1]; x: Integer[1]; }\nClass a::Empty { }"
    got = code.class_models(spark.createDataFrame([("f", text)], "path string, value string")).collect()
    assert [(m.name, m.parent, [p.name for p in m.properties]) for m in got] == [("a::B", "a::C", ["x", "y"])]
    src = "def f(x=[]):\n    try:\n        pass\n    except:\n        pass\n"
    found = code.python_defects(spark.createDataFrame([("p.py", src), ("q.py", "def")], "path string, value string"))
    assert sorted(x.defect for x in found.collect()) == ["bare_except", "mutable_default", "swallowed_error", "unparsed"]


def test_empty_ontology_permits_everything(spark, edges):
    n = ids(spark, "a", "b").withColumn("type", F.lit(None).cast("string"))
    assert rules.invalid_nodes(n, spark.createDataFrame([], "type string")).count() == 0
    assert rules.invalid_nodes(n, spark.createDataFrame([("concept",)], "type string")).count() == 0
    assert rules.invalid_nodes(n, spark.createDataFrame([("thing",)], "type string")).count() == 2


def test_enterprise_graph_has_both_directions(spark):
    d = spark.createDataFrame([(1, "Anna Lee: see ABC-12", "slack", "general")], "doc_id int, text string, source string, container string")
    _, e = builders.enterprise_graph(d)
    assert {x.rel for x in e.collect()} == {"in_channel", "has_in_channel", "references", "has_references", "spoken_by", "has_spoken_by"}


def test_degraded_runs_have_no_manifest(spark):
    with pytest.raises(ValueError, match="degraded"):
        report.manifest(spark, "r", {}, {"rows": 1}, ["fallback encoder"])
    assert report.manifest(spark, "r", {"k": 1}, {"rows": 1})["counts"] == {"rows": 1}
    df = spark.createDataFrame([("a", 0.5, None), ("b", None, None)], "arm string, m double, n double")
    assert report.markdown(df, "arm", ["m", "n"]).splitlines()[2:] == ["| a | 0.500 | n/a |", "| b | n/a | n/a |"]
