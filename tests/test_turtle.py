"""Turtle documents, term by term, and source trees."""

import pytest
from pyspark.sql import functions as F

from lodegraph.sources import code, turtle

R = turtle.RDF


def terms(text):
    return [(s, p, o, kind, datatype, lang) for s, p, o, kind, datatype, lang in turtle.Document(text).read()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        ("# nothing\n", []),
        ("<a> <b> <c> .", [("a", "b", "c", "iri", None, None)]),
        ("@prefix x: <h:/> .\nx:a a x:b, x:c;x:d 'e'@fr ;; .", [("h:/a", R + "type", "h:/b", "iri", None, None), ("h:/a", R + "type", "h:/c", "iri", None, None), ("h:/a", "h:/d", "e", "literal", None, "fr")]),
        ("prefix : <h#> BASE <http://e.org/d/> <p> :q.r \"\"\"a \"quoted\" \\u00e9\\n\"\"\"^^:t.", [("http://e.org/d/p", "h#q.r", 'a "quoted" é\n', "literal", "h#t", None)]),
        ("_:x <p> 1, -2.50, 3e4, true .", [("_:x", "p", v, "literal", turtle.XSD + t, None) for v, t in (("1", "integer"), ("-2.50", "decimal"), ("3e4", "double"), ("true", "boolean"))]),
        ("[] <p> [ <q> 'v' ] .", [("_:n2", "q", "v", "literal", None, None), ("_:n1", "p", "_:n2", "blank", None, None)]),
        ("[ <q> <v> ] .", [("_:n1", "q", "v", "iri", None, None)]),
        ("<s> <p> ( 'a' ) , () .", [("_:n1", R + "first", "a", "literal", None, None), ("_:n1", R + "rest", R + "nil", "iri", None, None), ("s", "p", "_:n1", "blank", None, None), ("s", "p", R + "nil", "iri", None, None)]),
        ("a:b.c a:d\\,e a:f%20g .", [("a:b.c", "a:d,e", "a:f%20g", "iri", None, None)]),
        ("<s> <p> '' , \"\" , '''it's''' .", [("s", "p", v, "literal", None, None) for v in ("", "", "it's")]),
    ],
)
def test_documents(text, want):
    assert terms(text) == want


@pytest.mark.parametrize("text", ["<a> <b>", "<a> <b> <c>", "'s' <b> <c> .", "<a> 'b' <c> .", "<a> <b> [ <c> <d> .", "<a> <b> ( 1 .", "@prefix x <y> .", "<a> <b> \"c .", "a b c .", "^"])
def test_what_is_no_turtle_is_an_error(spark, text):
    with pytest.raises(ValueError):
        terms(text)
    with pytest.raises(Exception, match="f.ttl"):
        turtle.triples(spark.createDataFrame([("f.ttl", text)], "path string, value string")).count()


def test_names_of_several_files(spark):
    files = [("1", "_:x <http://a/b#type> <http://a/c/D> ; <l> 'http://not/a#name' ."), ("2", "_:x <p> <urn:q> ."), ("3", None)]
    got = {tuple(r) for r in turtle.local_names(turtle.triples(spark.createDataFrame(files, "path string, value string"))).collect()}
    assert got == {("_:x@1", "type", "D"), ("_:x@1", "l", "http://not/a#name"), ("_:x@2", "p", "q")}


def test_source_trees(spark):
    files = [("a/x.py", "x = 1"), ("a/y.py", ""), ("a/z.py", None), ("a/tests/t.py", "x"), ("a/test_q.py", "x"), ("a/q_test.py", "x"), ("a/notes.txt", "x"), ("b/p.py", "def (\r\ny\r\n"), ("b/q.py", "try:\n  a\nexcept:\n  pass\n"), ("c/docs/x.py", "x")]
    got = {r.repo: (r.files, r.lines, r.unparsed, r.findings) for r in code.python_report(spark.createDataFrame(files, "path string, value string"), F.substring_index("path", "/", 1)).collect()}
    assert got == {"a": (3, 1, 0, 0), "b": (2, 6, 1, 2)}
