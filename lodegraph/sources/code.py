"""Sources that need a parser: class models with nested braces, and Python files."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.operators.durable import kept

CLASSES = "name string, parent string, ord long, properties array<struct<name:string,type:string,multiplicity:string>>"
FINDINGS = "path string, line long, defect string"
_CLASS = re.compile(r"\bClass\b\s*(?:<<[^>]*>>\s*)?(?:\{[^}]*\}\s*)?([\w:]+)(?:\s+extends\s+([\w:]+))?\s*\{")
_PROPERTY = re.compile(r"(?:^|(?<=;)|(?<=\}))\s*(?:<<[^>]*>>\s*)?(?:\{[^}]*\}\s*)?(\w+)\s*:\s*([\w:]+)\s*\[([^\]]+)\]\s*;", re.M)


_SERVICE = re.compile(r"\bService\b\s*(?:<<[^>]*>>\s*)?(?:\{[^}]*\}\s*)?([\w:]+)\s*\{")
_QUERY = re.compile(r"\bquery\s*:\s*\|([^;]+);")
#: How queries label their columns, in order of preference: 'Label' before a colon, a list of labels after the columns, a bare name before a colon.
_LABELLED, _LISTED, _BARE = re.compile(r"~?\[\s*'([^']+)'\s*:"), re.compile(r"\],\s*\[([^\]]*)\]"), re.compile(r"~\[\s*(\w+)\s*:")
SERVICES = "service string, class string, columns array<string>, paths array<string>, query string"


def _body(text: str, at: int) -> str:
    """From after an opening brace to the brace that closes it."""
    depth, i = 1, at
    while i < len(text) and depth:
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        i += 1
    return text[at : i - 1] if not depth else text[at:]


def _service(name: str, body: str) -> tuple | None:
    """A service's row; None unless it starts at all of a class and has as many labels as property paths."""
    found = _QUERY.search(body)
    query = " ".join(found[1].split()) if found else ""
    start = re.match(r"([\w:]+)\.all\(\)", query)
    if not start:
        return None
    labels = _LABELLED.findall(query)
    if not labels and (listed := _LISTED.search(query)):
        labels = [x.strip().strip("'") for x in listed[1].split(",")]
    labels = labels or _BARE.findall(query)
    paths = re.findall(r"\$\w+\.([\w.]+)", query)
    return (name, start[1], labels, paths, query) if paths and len(labels) == len(paths) else None


def services(files: DataFrame) -> DataFrame:
    """(service, class, columns, paths, query) of service definitions in files (path, value): of equal queries the last by path and place."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, m.start(), *row) for p, text in zip(f["path"], f["value"], strict=True) for m in _SERVICE.finditer(text) if (row := _service(m[1], _body(text, m.end())))]
            yield pd.DataFrame(rows, columns=["path", "at", "service", "class", "columns", "paths", "query"])

    found = files.select("path", "value").mapInPandas(parse, "path string, at long, " + SERVICES)
    last = found.groupBy("query").agg(F.max_by(F.struct("service", "class", "columns", "paths"), F.struct("path", "at")).alias("s"))
    return last.select("s.*", "query")


def class_models(files: DataFrame) -> DataFrame:
    """(name, parent, properties) of class definitions in files (path, value).

    Of a name's properties the first counts; a class needs one; a later file's
    definition, by path, wins only if it has more properties.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for text in f["value"]:
                for k, m in enumerate(_CLASS.finditer(text)):
                    seen: dict[str, tuple] = {}
                    for p in _PROPERTY.finditer(_body(text, m.end())):
                        seen.setdefault(p[1], (p[1], p[2], p[3]))
                    if seen:
                        rows.append((m[1], m[2], k, [dict(zip(("name", "type", "multiplicity"), x, strict=True)) for x in seen.values()]))
            yield pd.DataFrame(rows, columns=["name", "parent", "ord", "properties"])

    numbered = files.select("path", "value")
    found = numbered.mapInPandas(parse, CLASSES)
    w = Window.partitionBy("name").orderBy(F.desc(F.size("properties")), "ord", F.to_json("properties"))
    return found.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("name", "parent", "properties")


def python_defects(files: DataFrame) -> DataFrame:
    """(path, line, defect) of Python files (path, value): swallowed errors, mutable defaults, bare excepts; `unparsed` for a file that isn't Python."""

    def scan(path: str, text: str) -> Iterator[tuple[str, int, str]]:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            yield path, 0, "unparsed"
            return
        for node in ast.walk(tree):
            if isinstance(node, ast.ExceptHandler):
                if node.type is None:
                    yield path, node.lineno, "bare_except"
                if all(isinstance(x, ast.Pass) or isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) for x in node.body):
                    yield path, node.lineno, "swallowed_error"
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) and any(isinstance(d, ast.List | ast.Dict | ast.Set) for d in [*node.args.defaults, *node.args.kw_defaults]):
                yield path, node.lineno, "mutable_default"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [x for p, t in zip(f["path"], f["value"], strict=True) for x in scan(p, t)]
            yield pd.DataFrame(rows, columns=["path", "line", "defect"])

    return files.select("path", "value").mapInPandas(run, FINDINGS)


#: Folders that hold no code to be measured.
SKIPPED = [".git", ".venv", "venv", "node_modules", "__pycache__", "build", "dist", ".tox", ".mypy_cache", "site-packages", ".pytest_cache", "tests", "test", "testing", "examples", "example", "docs", "benchmarks_legacy", "scripts", "notebooks"]


def python_files(files: DataFrame) -> DataFrame:
    """files (path, value) of Python code: without folders of SKIPPED and without tests, by the path's parts."""
    parts = F.split("path", "/")
    base = F.element_at(parts, -1)
    own = F.endswith("path", F.lit(".py")) & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED))) & ~F.startswith(base, F.lit("test_")) & ~F.endswith(base, F.lit("_test.py"))
    return files.where(own)


def python_report(files: DataFrame, root: Column) -> DataFrame:
    """(repo, files, lines, unparsed, findings) of each source tree: root gives a file's tree by its path. Trees without a file of their own have no row.

    Lines end as Python's do; a finding is counted once for its file, line and defect.
    """
    own = python_files(files).select(root.alias("repo"), "path", F.coalesce("value", F.lit("")).alias("value"))
    ended = F.split(F.regexp_replace("value", "\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n"), "\n")
    lines = F.size(ended) - F.when(F.element_at(ended, -1) == "", 1).otherwise(0)
    found = python_defects(own).distinct().groupBy("path").agg(F.count(F.when(F.col("defect") == "unparsed", 1)).alias("u"), F.count(F.when(F.col("defect") != "unparsed", 1)).alias("d"))
    each = own.select("repo", "path", lines.alias("n")).join(found, "path", "left")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return each.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), total("n", "lines"), total("u", "unparsed"), total("d", "findings"))


def resolved_types(classes: DataFrame) -> DataFrame:
    """(name, property, type, target): the class that a property's type names: in full, else by a short name that one class has, else the candidate of the longest package prefix shared with the owner."""
    short = lambda c: F.substring_index(c, "::", -1)
    props = classes.select("name", F.explode("properties").alias("p")).select("name", F.col("p.name").alias("property"), F.col("p.type").alias("type"))
    exact = classes.select(F.col("name").alias("type"), F.col("name").alias("exact"))
    by_short = classes.select(short("name").alias("_s"), F.col("name").alias("candidate"))
    a, b = F.split("name", "::"), F.split("candidate", "::")
    prefix = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.struct(F.lit(0).alias("n"), F.lit(1).alias("on")), lambda s, x: F.struct((s["n"] + s["on"] * x).alias("n"), (s["on"] * x).alias("on")), lambda s: s["n"])
    cand = props.withColumn("_s", short("type")).join(by_short, "_s").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name", "property"))).withColumn("shared", prefix)
    best = cand.where("n = 1 or shared > 0").groupBy("name", "property").agg(F.max_by("candidate", F.struct("shared", "candidate")).alias("near"))
    return props.join(exact, "type", "left").join(best, ["name", "property"], "left").select("name", "property", "type", F.coalesce("exact", "near").alias("target"))


def inherited(classes: DataFrame, depth: int = 20) -> DataFrame:
    """(name, property, type, owner, distance) with what parents declare; the nearest declaration wins."""
    parents = classes.select(F.col("name").alias("at"), "parent")
    frontier = classes.select("name", F.col("name").alias("at"), F.lit(0).alias("distance"))
    reached, seen = frontier, frontier.select("name", "at")
    for d in range(1, depth + 1):
        frontier = kept(frontier.join(parents, "at").where("parent is not null").select("name", F.col("parent").alias("at"), F.lit(d).alias("distance")).join(seen, ["name", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        seen, reached = seen.union(frontier.select("name", "at")), reached.unionByName(frontier)
    own = classes.select(F.col("name").alias("at"), F.explode("properties").alias("p")).select("at", F.col("p.name").alias("property"), F.col("p.type").alias("type"))
    w = Window.partitionBy("name", "property").orderBy("distance")
    return reached.join(own, "at").withColumn("_k", F.row_number().over(w)).where("_k = 1").select("name", "property", "type", F.col("at").alias("owner"), "distance")


def path_steps(classes: DataFrame, paths: DataFrame, depth: int = 8) -> DataFrame:
    """(path_id, reached, ok) of property paths (path_id, class, steps array): the class or leaf type that the steps lead to; ok is false where a step has no property.

    A step that reaches a leaf type ends the path, also if steps remain.
    """
    props = inherited(classes).select(F.col("name").alias("at"), F.col("property").alias("step"), "type")
    known = classes.select(F.col("name").alias("type"), F.lit(True).alias("is_class"))
    now = paths.select("path_id", "steps", F.col("class").alias("at"), F.lit(True).alias("ok"), F.lit(False).alias("leaf"))
    for i in range(depth):
        step = F.when(F.col("ok") & ~F.col("leaf"), F.get("steps", F.lit(i)))
        moved = now.withColumn("step", step).join(props, ["at", "step"], "left").join(known, "type", "left")
        on = F.col("step").isNotNull()
        now = moved.select("path_id", "steps", F.when(on & F.col("type").isNotNull(), F.col("type")).otherwise(F.col("at")).alias("at"), (F.col("ok") & (~on | F.col("type").isNotNull())).alias("ok"), (F.col("leaf") | on & F.col("type").isNotNull() & F.col("is_class").isNull()).alias("leaf"))
    return now.select("path_id", F.col("at").alias("reached"), "ok")


def two_hop_routes(classes: DataFrame, wanted: list[str]) -> DataFrame:
    """(name, first, second, type): the only way, over one class, to a property of a wanted leaf type that the class itself lacks."""
    own = classes.select("name", F.explode("properties").alias("p")).select("name", F.col("p.name").alias("property"), F.col("p.type").alias("type"))
    far = own.toDF("type", "second", "leaf").where(F.col("leaf").isin(wanted))
    routes = own.withColumnRenamed("property", "first").join(far, "type").select("name", "first", "second", "leaf").distinct()
    only = routes.groupBy("name", "leaf").agg(F.count(F.lit(1)).alias("n"), F.first("first").alias("first"), F.first("second").alias("second")).where("n = 1")
    return only.join(own.select("name", F.col("type").alias("leaf")), ["name", "leaf"], "left_anti").select("name", "first", "second", F.col("leaf").alias("type"))
