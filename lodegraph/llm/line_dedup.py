"""Line dedup: of runs of lines that occur more than once, the copies after the first are deleted.

Lines become 128-bit ids; prefix doubling ranks the suffixes of all documents'
id sequences (`doubling`). A group of suffixes with a longest common prefix of at least
`min_lines` is a repeated run; every group keeps the copy that comes first by document and
line, and the lines of the others go. The union of the deleted stretches is
the later copies of the maximal repeated runs. Unless a number of lines is asked for, a
run of `MIN_LINES` goes whatever its lines are, and a single line goes if it has a letter or a
digit: blank lines, rules and lone brackets are layout and stay outside of runs.

The union over all lengths is that over the shortest, so ranks at one and two lines
tell what is deleted. Doubling goes on as long as runs repeat; from its intervals come the
maximal runs, and `longest_run` is the exact length of a document's longest.

Defined cases: a null text has no lines and is kept as it is; an empty text is one
empty line; documents are ordered by id, null last, then by row key; rows of one id
are documents of their own, equal rows are one document and lose the same lines; a run may
repeat within a document and overlap its copy; columns with the names of outputs
are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.llm import doubling
from lodegraph.llm.common import append, discard, fresh, map_in_arrow, materialise, order_key, row_key, with_columns_schema

#: Runs of so many lines go whatever is on them; shorter ones by their lines' contents.
MIN_LINES = 2


def line_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rk, ord, pos, a, b): the lines' ids a, b."""
    line = F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line")
    texts = docs.select(row_key(id_col, text_col).alias("rk"), order_key(id_col).alias("ord"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    return texts.select("rk", "ord", line).select("rk", "ord", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(17), "line").alias("b"))


def line_dedup(docs: DataFrame, min_lines: int | None = None, id_col: str = "doc_id", text_col: str = "text", single_words: int = 1, longest_runs: bool = True) -> DataFrame:
    """docs with n_lines, n_removed, longest_run and kept_text, the lines left (null if the text is null).

    With min_lines, runs of so many lines go and nothing else does; without, runs of MIN_LINES and single lines that say something: those of at least
    single_words words and with a letter or a digit. Without longest_runs, longest_run is null, which spares all ranks but those that the deletion needs.
    """
    alone, min_lines = min_lines is None, min_lines or MIN_LINES
    outputs = [("n_lines", T.LongType()), ("n_removed", T.LongType()), ("longest_run", T.LongType()), ("kept_text", T.StringType())]
    first = doubling.first_ranks(line_ids(docs, id_col, text_col), ["a", "b"])
    levels = doubling.all_lengths(first) if longest_runs else []
    known = dict(levels)
    ranks = known[min_lines] if min_lines in known else doubling.at_length(first, min_lines)
    later = doubling.later_copies(ranks)
    if alone:  # single lines are below 0: -1 is the line at 0
        later = later.unionByName(doubling.later_copies(first).select("rk", (-1 - F.col("pos")).alias("pos")))
    kept, schema = with_columns_schema(docs, [n for n, _ in outputs], outputs)
    own = fresh(kept)
    key, gone, longest = f"{own}rk", f"{own}gone", f"{own}longest"
    runs = doubling.longest(levels) if levels else first.select("rk", F.lit(0 if longest_runs else None).cast("long").alias("longest")).distinct()
    marks = materialise(later.groupBy("rk").agg(F.collect_list("pos").alias(gone)).join(runs, "rk", "full").withColumnsRenamed({"rk": key, "longest": longest}))
    discard(first, ranks, *known.values())
    joined = kept.withColumn(key, row_key(id_col, text_col)).join(marks.hint("shuffle_hash"), key, "left").select(*[F.col(f"`{c}`") for c in kept.columns], gone, longest)

    none = 0 if longest_runs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(a, 256)
                rows = []
                for text, starts, run_length in zip(*[part.column(c).to_pylist() for c in (text_col, gone, longest)], strict=True):
                    if text is None:
                        rows.append((0, 0, run_length or none, None))
                        continue
                    lines = text.split("\n")
                    out = bytearray(len(lines))
                    for s in starts or ():
                        if s >= 0:
                            out[s : s + min_lines] = b"\1" * min_lines
                        elif any(map(str.isalnum, lines[-1 - s])) and (single_words < 2 or len(lines[-1 - s].split()) >= single_words):
                            out[-1 - s] = 1
                    left = [x for x, o in zip(lines, out, strict=True) if not o]
                    rows.append((len(lines), len(lines) - len(left), run_length or none, "\n".join(left)))
                values = list(zip(*rows, strict=True)) or [[]] * 4
                yield append(part.drop_columns([gone, longest]), {n: pa.array(v, t) for (n, _), v, t in zip(outputs, values, [pa.int64()] * 3 + [pa.string()], strict=True)})

    return map_in_arrow(joined, run, schema)
