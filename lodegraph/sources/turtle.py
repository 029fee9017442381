"""Turtle as it is written: a reader of whole files into triples.

A file is one document: prefixes hold from where they stand. Files are parsed side by side in Arrow batches; triples are
plain rows, and everything after that is joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPLES = "path string, s string, p string, o string, kind string, datatype string, lang string"
IRI, BLANK, LITERAL = "iri", "blank", "literal"
#: Names of the language's own vocabulary.
RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"

_TOKEN = re.compile(
    r"""(?P<space>(?:\s|\#[^\n]*)+)
    |(?P<iri><[^\x00-\x20<>"{}|^`]*>)
    |(?P<long>\"{3}(?:(?:\"{0,2})(?:[^"\\]|\\.))*\"{3}|'{3}(?:(?:'{0,2})(?:[^'\\]|\\.))*'{3})
    |(?P<short>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<blank>_:[\w](?:[\w.-]*[\w-])?)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>[^\W\d_](?:[\w.-]*[\w-])?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\.)(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\.)*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\.))?)?|:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\.)(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\.)*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\.))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<sign>[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescaped(s: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), s, flags=re.S) if "\\" in s else s


class Document:
    """Recursive descent over one text's tokens; a term is (value, kind, datatype, language)."""

    def __init__(self, text: str):
        self.text, self.at, self.kind, self.value = text, 0, "", ""
        self.prefixes: dict[str, str] = {}
        self.base, self.blanks = "", 0
        self.rows: list[tuple] = []
        self.next()

    def error(self, what: str) -> ValueError:
        return ValueError(f"{what} expected at character {self.at}, not {self.value[:40]!r}")

    def next(self) -> None:
        while True:
            if self.at >= len(self.text):
                self.kind, self.value = "end", ""
                return
            m = _TOKEN.match(self.text, self.at)
            if not m:
                self.value = self.text[self.at : self.at + 40]
                raise self.error("a token")
            self.at, self.kind, self.value = m.end(), m.lastgroup, m[0]
            if self.kind != "space":
                return

    def take(self, value: str) -> None:
        if self.value != value:
            raise self.error(repr(value))
        self.next()

    def iri(self) -> str:
        if self.kind == "iri":
            out = _unescaped(self.value[1:-1])
            out = urljoin(self.base, out) if self.base else out
        elif self.kind == "name":
            prefix, local = self.value.split(":", 1)
            local = re.sub(r"\\(.)", r"\1", local)
            out = self.prefixes[prefix] + local if prefix in self.prefixes else f"{prefix}:{local}"
        else:
            raise self.error("a name")
        self.next()
        return out

    def fresh(self) -> tuple:
        self.blanks += 1
        return f"_:n{self.blanks}", BLANK, None, None

    def read(self) -> list[tuple]:
        while self.kind != "end":
            word = self.value.lower()
            if self.kind == "at" and word in ("@prefix", "@base") or self.kind == "word" and word in ("prefix", "base"):
                self.next()
                if word.endswith("prefix"):
                    if self.kind != "name" or not self.value.endswith(":"):
                        raise self.error("a prefix")
                    prefix = self.value[:-1]
                    self.next()
                    self.prefixes[prefix] = self.iri()
                else:
                    self.base = self.iri()
                if word[0] == "@":
                    self.take(".")
                continue
            bare = self.value == "["
            subject = self.term(subject=True)
            if not (bare and self.value == "."):
                self.statements(subject)
            self.take(".")
        return self.rows

    def statements(self, subject: tuple) -> None:
        while True:
            if self.kind == "word" and self.value == "a":
                verb = RDF + "type"
                self.next()
            else:
                verb = self.iri()
            while True:
                o = self.term()
                self.rows.append((subject[0], verb, *o))
                if self.value != ",":
                    break
                self.next()
            if self.value != ";":
                return
            while self.value == ";":
                self.next()
            if self.value in (".", "]"):
                return

    def term(self, subject: bool = False) -> tuple:
        if self.value == "[" and self.kind == "sign":
            self.next()
            node = self.fresh()
            if self.value != "]":
                self.statements(node)
            self.take("]")
            return node
        if self.value == "(" and self.kind == "sign":
            self.next()
            items = []
            while self.value != ")" or self.kind != "sign":
                items.append(self.term())
            self.next()
            rest: tuple = (RDF + "nil", IRI, None, None)
            for item in reversed(items):
                node = self.fresh()
                self.rows += [(node[0], RDF + "first", *item), (node[0], RDF + "rest", *rest)]
                rest = node
            return rest
        if self.kind == "blank":
            out = (self.value, BLANK, None, None)
            self.next()
            return out
        if self.kind in ("iri", "name"):
            return self.iri(), IRI, None, None
        if subject:
            raise self.error("a subject")
        if self.kind in ("long", "short"):
            quote = 3 if self.kind == "long" else 1
            value = _unescaped(self.value[quote:-quote])
            self.next()
            if self.kind == "at":
                lang = self.value[1:]
                self.next()
                return value, LITERAL, None, lang
            if self.kind == "type":
                self.next()
                return value, LITERAL, self.iri(), None
            return value, LITERAL, None, None
        if self.kind == "number":
            value = self.value
            self.next()
            return value, LITERAL, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None
        if self.kind == "word" and self.value in ("true", "false"):
            value = self.value
            self.next()
            return value, LITERAL, XSD + "boolean", None
        raise self.error("a term")


def triples(files: DataFrame) -> DataFrame:
    """TRIPLES of Turtle files (path, value): names in full, blank nodes as _:x within their file, literals with what their type or language is. A file that is no Turtle is an error that names it; null is an empty one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for path, text in zip(f["path"], f["value"], strict=True):
                try:
                    rows += [(path, *r) for r in Document(text or "").read()]
                except (ValueError, RecursionError) as e:
                    raise ValueError(f"{path}: {e}") from e
            yield pd.DataFrame(rows, columns=["path", "s", "p", "o", "kind", "datatype", "lang"], dtype=object)

    return files.select("path", "value").mapInPandas(run, TRIPLES)


def local_names(found: DataFrame) -> DataFrame:
    """(s, p, o) of `triples`: what stands behind the last # of a name, or else its last / or :; literals as they are. Blank nodes carry their file."""
    local = lambda c: F.when(F.contains(c, F.lit("#")), F.substring_index(c, "#", -1)).otherwise(F.regexp_replace(c, r"^.*[/:]", ""))
    name = lambda c: F.when(F.startswith(c, F.lit("_:")), F.concat_ws("", c, F.lit("@"), F.coalesce("path", F.lit("")))).otherwise(local(c))
    return found.select(name(F.col("s")).alias("s"), local(F.col("p")).alias("p"), F.when(F.col("kind") == LITERAL, F.col("o")).otherwise(name(F.col("o"))).alias("o"))
