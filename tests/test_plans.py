"""Plan scores, bridges, traversable nodes, paths to terms, links between pages and the graphs of questions."""

from lodegraph.operators import context as x
from lodegraph.operators import graph as g
from lodegraph.plans import builders as b


def test_plan_scores(spark):
    schema = "question_id long, tables array<string>, path array<string>"
    gold = spark.createDataFrame([(1, ["A", "b", "c"], ["a->b", "b->c"], ["b"]), (2, ["a"], [], []), (3, ["a", "b"], ["a->b"], []), (4, ["a"], None, None), (5, ["a", "b", "c"], ["a->b", "b->c"], ["b"])], schema + ", bridges array<string>")
    plans = spark.createDataFrame([(1, ["public.a", "B ", "C"], ["A->B", "b->c"]), (2, ["a"], ["a->z"]), (3, ["a", "q"], ["b->a"]), (5, ["a", "c"], ["a->b", "b->c", "no step"])], schema)
    got = {r.question_id: tuple(r)[1:] for r in x.plan_scores(gold, plans).collect()}
    assert got == {1: (1.0, 1.0, 1.0, True), 2: (1.0, 0.0, 1.0, False), 3: (0.5, 0.0, 1.0, False), 4: (0.0, 1.0, 1.0, False), 5: (2 / 3, 1.0, 0.0, False)}


def test_bridge_within_a_label(spark):
    gold = spark.createDataFrame([(1, "The New York!"), (2, "york"), (3, None), (4, "x")], "question_id long, bridge string")
    paths = spark.createDataFrame([(1, ["USA", "new york (city)"]), (2, ["Rome"]), (2, ["a", "York"]), (3, ["x"])], "question_id long, path array<string>")
    assert {r.question_id: r.recalled for r in x.bridge_recalled(paths, gold).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_traversable(spark):
    edges = spark.createDataFrame([("a", "born", "1900"), ("a", "knows", "b"), ("b", "in", "c"), ("c", "born", "1900"), ("d", "born", "a")], "src string, rel string, dst string")
    got = {r.node_id: r.traversable for r in g.traversable(edges, ["born", "in"]).collect()}
    assert got == {"a": True, "b": True, "c": True, "d": True, "1900": False}


def test_paths_to_terms_in_label_and_summary(spark):
    edges = spark.createDataFrame([("s", "r", "a"), ("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"), ("d", "r", "e"), ("a", "r", "z"), ("s", "r", "y")], "src string, rel string, dst string")
    nodes = spark.createDataFrame([("a", "plain", ""), ("b", "Blue thing", None), ("d", "x", "a red and blue one"), ("e", "blue", ""), ("s", "blue", "")], "node_id string, label string, summary string")
    starts = spark.createDataFrame([("s",)], "node_id string")
    want = [("s", "b", 2, "s>a>b", 1), ("s", "d", 4, "s>a>b>c>d", 2)]
    assert [tuple(r) for r in x.paths_to_terms(edges, nodes, starts, ["blue", "red"]).collect()] == want
    assert [tuple(r) for r in x.paths_to_terms(edges, nodes, starts, ["blue", "red"], width=1).collect()] == want[:1]
    assert x.paths_to_terms(edges, nodes, starts, ["green"]).count() == 0


def test_links_between_pages(spark):
    docs = spark.createDataFrame([(1, "Rome", "see [[PARIS|the city]], [[paris]] and [[Nowhere]] [[rome]]"), (2, "Paris", "[[Rome]]"), (3, "paris", None), (4, None, "[[Paris]] [[Rome]]")], "doc_id long, title string, text string")
    assert {(r.src, r.dst) for r in b.page_links(docs).collect()} == {("page::1", "page::3"), ("page::2", "page::1"), ("page::4", "page::3"), ("page::4", "page::1")}
    assert {(r.src, r.dst) for r in b.page_links(docs, 1).collect()} == {("page::1", "page::3"), ("page::2", "page::1"), ("page::4", "page::3")}


def test_graphs_of_questions(spark):
    facts = spark.createDataFrame([(1, "A", 0, "x"), (1, "A", 2, "y"), (1, "A", 2, "y"), (1, "B", 0, "z"), (2, "A", 5, "w")], "question_id long, title string, sent_id long, sentence string")
    nodes, edges = b.fact_graph(facts)
    assert nodes.count() == 7
    assert {(r.question_id, r.src, r.rel, r.dst) for r in edges.collect()} == {(1, "article::A", "contains", "fact::A::0"), (1, "article::A", "contains", "fact::A::2"), (1, "article::B", "contains", "fact::B::0"), (2, "article::A", "contains", "fact::A::5"), (1, "fact::A::0", "follows", "fact::A::2")}
    paragraphs = spark.createDataFrame([(1, 0, "T", "a"), (1, 1, None, "b"), (1, 2, "T", "c")], "question_id long, k long, title string, paragraph string")
    nodes, edges = b.paragraph_graph(paragraphs)
    assert {(r.node_id, r.text) for r in nodes.collect()} == {("para::T", "c"), ("para::para-1", "b")}
    assert {(r.src, r.dst) for r in edges.collect()} == {("para::T", "para::para-1"), ("para::para-1", "para::T")}
