"""Benchmark decontamination: approximate occurrences of test items in documents.

An item of m characters may occur with up to k = m // ERRORS edits. Cut into k + 1
pieces, at least one of them must stand in the document unchanged; an automaton of all
pieces finds these places in one pass. Around each, Myers' bit-parallel algorithm
computes the least edit distance of the whole item to any stretch of the text.
Both sides are compared with letters in lower case and words joined by one space.

The items are the stated query set. They are read in blocks of at most BLOCK
characters, by their share of all characters; each block is one pass over the
documents, so the broadcast items never grow with their number. A Python worker builds
a block's automaton once and keeps it for its later tasks.

An item is found inside of words too, and one of less than ERRORS characters only unchanged: very
short items strike wherever their letters stand.

Defined cases: null or empty texts match nothing, on either side; an item that
occurs often in a document is one row, with its least distance; equal items match
under each of their ids, repeated rows of documents each; null ids are kept; other
columns play no part; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import discard, map_in_arrow, materialise

#: One edit is allowed for each ERRORS characters.
ERRORS = 12
#: Characters of items that one pass over the documents looks for.
BLOCK = 1_600_000
MATCHES = "doc_id long, item_id long, n_errors long"


def normal(text: str | None) -> str:
    return b" ".join(text.lower().encode().split()).decode() if text else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def profile(item: str) -> dict[str, int]:
    """For each character, the bits of its places in the item."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def least_distance(bits: dict[str, int], m: int, text: str) -> int:
    """Of all stretches of text, the least edit distance to an item of m characters, whole columns of the matrix at once."""
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score = full, 0, m
    best = m
    for c in text:
        eq = bits.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        grows = down | ~(diagonal | up) & full
        falls = up & diagonal
        if grows & top:
            score += 1
        elif falls & top:
            score -= 1
            if score < best:
                best = score
        # a stretch may begin anywhere, so nothing is carried into the first row
        grows = grows << 1 & full
        falls = falls << 1 & full
        up = falls | ~(diagonal | grows) & full
        down = grows & diagonal
    return best


class Finder:
    def __init__(self, items: list[tuple[int | None, str]], errors: int):
        import ahocorasick

        self.items = [(i, t, len(t) // errors) for i, t in items]
        self.bits: dict[int, dict[str, int]] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, of in where.items():
            self.automaton.add_word(piece, (len(piece), of))
        self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, int]:
        """Of a normal text: the items within their error budgets, by number, with their least distances."""
        if not self.items:
            return {}
        spans: dict[int, list[list[int]]] = {}
        for end, (length, of) in self.automaton.iter(text):
            for n, offset in of:
                _, item, k = self.items[n]
                begin = end + 1 - length - offset - k
                span = [max(0, begin), begin + len(item) + 2 * k]
                known = spans.setdefault(n, [])
                if known and known[-1][0] <= span[0] <= known[-1][1]:
                    known[-1][1] = max(known[-1][1], span[1])
                else:
                    known.append(span)
        out: dict[int, int] = {}
        for n, found in spans.items():
            _, item, k = self.items[n]
            if n not in self.bits:
                self.bits[n] = profile(item)
            found.sort()
            done, best = -1, k + 1
            for a, b in found:
                if b > done and best:
                    best = min(best, least_distance(self.bits[n], len(item), text[a:b]))
                    done = b
            if best <= k:
                out[n] = best
        return out


#: The last block's automaton of this Python worker, under the block's name.
_built: dict[str, Finder] = {}


def _blocks(spark: SparkSession, items: DataFrame, errors: int) -> list:
    """For each block of items (item_id, text) a function that gives its Finder; its items are broadcast, BLOCK characters or so."""
    asked = items.where("length(text) > 0")
    chars = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = -(-chars // BLOCK) or 1
    out = []
    for i in range(parts):
        block = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i)
        held, name = spark.sparkContext.broadcast([(r.item_id, t) for r in block.toLocalIterator() if (t := normal(r.text))]), uuid.uuid4().hex

        def finder(held=held, name=name) -> Finder:
            if name not in _built:
                _built.clear()
                _built[name] = Finder(held.value, errors)
            return _built[name]

        out.append(finder)
    return out


def _search(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = block()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    rows += [(doc, finder.items[n][0], d) for n, d in finder.matches(normal(text)).items()]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_errors"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, errors: int = ERRORS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_errors): which items each document contains, with the least number of edits."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    return reduce(DataFrame.unionByName, [texts.mapInArrow(_search(block), MATCHES) for block in _blocks(docs.sparkSession, asked, errors)])


def without_leaks(docs: DataFrame, items: DataFrame, errors: int = ERRORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text contains no item. Judged by row: texts are read and dropped in one pass for each block, and what is left is written before the next."""
    out, written = docs, []
    for k, block in enumerate(_blocks(docs.sparkSession, items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")), errors)):
        if k:  # a task holds one automaton at a time
            left = materialise(out)
            discard(*written)
            written, out = [left], left
        out = map_in_arrow(out, _drop(block, text_col), out.schema)
    return out


def _drop(block, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = block()
        for batch in batches:
            clean = pa.array([not (t and finder.matches(normal(t))) for t in batch.column(text_col).to_pylist()], pa.bool_())
            yield batch.filter(clean)

    return run
