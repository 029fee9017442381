"""Built corpora, exports, constrained answers: edges of their inputs, and plain versions."""

import itertools
from xml.etree import ElementTree

from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.operators import loops
from lodegraph.plans import corpora
from lodegraph.sources import code, readers, samples


def test_graphml_is_one_document(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A & <b>", "x"), ("b", 'say "b"', None), ("c", None, "y")], "node_id string, label string, kind string")
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("a", "q<", "c")], "src string, rel string, dst string")
    said = corpora.export_graph(nodes, edges, str(tmp_path), {"corpus": "small"}, {"extract": 2})
    assert said == {"corpus": "small", "num_nodes": 3, "num_edges": 3, "relation_distribution": {"r": 2, "q<": 1}, "failures": {"extract": 2}}
    text = "".join(p.read_text() for p in sorted((tmp_path / "graphml").glob("part-*")))
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    graph = ElementTree.fromstring(text).find(f"{ns}graph")
    assert [(x.get("id"), *[d.text or "" for d in x]) for x in graph.findall(f"{ns}node")] == [("a", "A & <b>", "x"), ("b", 'say "b"', ""), ("c", "", "y")]
    assert {(x.get("source"), x[0].text, x.get("target")) for x in graph.findall(f"{ns}edge")} == {("a", "r", "b"), ("b", "r", "c"), ("a", "q<", "c")}


def test_training_records_and_distractors(spark):
    questions = spark.createDataFrame([(k, "ab"[k % 2], f"q{k}", None if k == 3 else f" a{k} ", k == 4) for k in range(12)], "question_id long, category string, query string, answer string, unanswerable boolean")
    memory = spark.createDataFrame([(q, k, f"d{q}_{k}") for q in range(11) for k in range(4)], "question_id long, k int, doc_id string")
    texts = spark.createDataFrame([(f"d{q}_{k}", f"text {q} {k}" * 9) for q in range(11) for k in range(4) if k != 1], "doc_id string, text string")
    records = corpora.training_records(questions, memory, texts, doc_chars=8, max_slots=3)
    got = {r.question_id: r for r in records.collect()}
    assert set(got) == set(range(11)) - {3} and got[4].answer == "I don't know" and got[5].answer == "a5"
    assert got[6].memory_doc_ids == ["d6_0", "d6_2"] and got[6].memory_texts == ["text 6 0", "text 6 2"]
    drawn = {r.question_id: r for r in corpora.with_distractors(records, 0.5, "s").collect()}
    changed = [sum(a != b for a, b in zip(r.memory_doc_ids, got[q].memory_doc_ids, strict=True)) for q, r in drawn.items()]
    assert set(drawn) == set(got) and all(n <= 1 for n in changed) and sum(changed) >= 5
    assert all(len(r.memory_texts) == 2 and set(r.memory_doc_ids) - set(got[q].memory_doc_ids) <= {f"d{k}_0" for k in range(11) if k != q} for q, r in drawn.items())
    assert corpora.with_distractors(records.limit(0), 0.5, "s").count() == 0
    split = {r.question_id: r.split for r in corpora.split_records(records, 0.3, "s").collect()}
    assert sorted(split) == sorted(got) and [sum(split[q] == "test" for q in split if q % 2 == b) for b in (0, 1)] == [2, 1]


def test_rows_with_empty_fields_are_no_triples(spark):
    schema = "source string, source_kind string, target string, target_kind string, relation string, chunk_id string, doc_id string, ord long"
    rows = [(" A  b ", "x", "C", "y", "Is In", "c1", "d1", 1), ("a B", "z", "c", "y", "is_in", "c2", "d2", 2), ("a", "x", " ", "y", "r", "c", "d", 3), (None, "x", "c", "y", "r", "c", "d", 4)]
    nodes, edges = corpora.merged_triples(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, nodes.collect())) == [("a b", "A  b", "x", 2), ("c", "C", "y", 2)]
    assert list(map(tuple, edges.collect())) == [("a b", "is_in", "c", "x", "y", "c1", "d1")]
    assert corpora.merged_triples(spark.createDataFrame(rows, schema), by_document=True)[1].count() == 2
    assert corpora.merged_triples(spark.createDataFrame([], schema))[1].count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), min_size=1, max_size=3), min_size=1, max_size=4, unique_by=tuple), st.integers(1, 2), st.integers(0, 6))
def test_automaton_allows_what_leads_to_names(names, least, steps):
    """A token is allowed if a list of different names, separated, begins so; the end where such a list is whole."""
    automaton = loops.NameAutomaton(names, [[","] + n for n in names], "end", least)
    lists = [tuple(itertools.chain.from_iterable(([","] if k else []) + names[i] for k, i in enumerate(p))) for n in range(len(names) + 1) for p in itertools.permutations(range(len(names)), n)]
    said: list = []
    for k in range(steps):
        allowed = automaton.allowed(said)
        assert allowed and all(any(x[: len(said) + 1] == (*said, t) for x in lists) for t in allowed - {"end"})
        if "end" in allowed and allowed != {"end"}:
            assert tuple(said) in lists and len(automaton.read(said)[0]) >= least
        on = sorted(allowed - {"end"})
        if not on:
            break
        said.append(on[k % len(on)])


def test_services_and_rdf_of_odd_files(spark):
    text = """Service a::One { query: |db::P.all()->project([p|$p.x.y, p|$p.z], ['X', 'Z']); } Service a::Two { query: |let(1); } Service { }
    Service a::Three { documentation: 'none'; }"""
    again = "Service b::Later { query: |db::P.all()->project([p|$p.x.y,   p|$p.z], ['X', 'Z']); }".replace(",   ", ", ")
    got = code.services(spark.createDataFrame([("1", text), ("2", again), ("3", "")], "path string, value string")).collect()
    assert [(r.service, r["class"], r.columns, r.paths) for r in got] == [("b::Later", "db::P", ["X", "Z"], ["x.y", "z"])]
    xml = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:s="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">
    <owl:Class rdf:about="http://x/o#Dog"><s:subClassOf><owl:Class rdf:ID="Animal"/></s:subClassOf></owl:Class>
    <rdf:Description rdf:about="http://x/o/eats"><rdf:type rdf:resource="http://www.w3.org/2002/07/owl#ObjectProperty"/><s:domain rdf:resource="#Animal"/></rdf:Description></rdf:RDF>"""
    classes, props, below = readers.ontology(readers.rdf_xml(spark.createDataFrame([("1", xml)], "path string, value string")))
    assert {r.name for r in classes.collect()} == {"Dog", "Animal"} and [tuple(r) for r in below.collect()] == [("Dog", "Animal")]
    assert [tuple(r) for r in props.collect()] == [("animal", "EATS", "entitynode")]


def test_samples_in_lists(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"id": "1", "question": "q", "answer": "a", "supporting_facts": {"title": ["T", "U"], "sent_id": [1, 0], "text": ["own", "words"]}}, {"id": "2", "question": "q", "answer": "a", "supporting_facts": {"title": ["T"], "sent_id": [7]}, "context": {"title": ["T", "T"], "sentences": [["x"], ["y", "z"]]}}]')
    got = {(r.question_id, r.k): (r.title, r.sent_id, r.sentence, r.level) for r in samples.fact_samples(spark, str(tmp_path / "f.json")).collect()}
    assert got == {("1", 0): ("T", 1, "own", ""), ("1", 1): ("U", 0, "words", ""), ("2", 0): ("T", 7, None, "")}
    (tmp_path / "p.json").write_text('[{"id": "1", "question": "q", "answer": "a", "paragraphs": [{"title": "t", "paragraph": "p"}]}, {"id": "2", "question": "q", "answer": "a"}]')
    assert [tuple(r)[3:] for r in samples.paragraph_samples(spark, str(tmp_path / "p.json")).orderBy("question_id").collect()] == [(0, "t", "p"), (None, None, None)]
