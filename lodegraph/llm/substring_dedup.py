"""Substring dedup: every window of `window` words that an earlier document has too is removed.

A Rabin-Karp hash stands for each window. Windows are counted in three steps, so
that only what can repeat travels.

1. A window's anchor is the least hash among its runs of `gram` words; equal windows
   have equal anchors. Neighbouring windows of one anchor form a run, which is sent
   as (anchor, hash of all its words, id, place): about a row for 18 windows.
2. By anchor: if one document has it, none of its windows repeats. If all its runs
   have the same words, they repeat as a whole, and all but the first document's go.
3. What is left are anchors whose runs differ. Their windows are counted one by one
   under 128-bit hashes; those of an earlier document win.

Before anything is sent, a map task settles what it can: of equal runs or windows
that it sees, only those of its smallest id are sent, the others are removed
already. Runs of one anchor that differ, as of a passage in documents that go on differently,
go to step 3 at once where a task sees more than FEW of them; two of
different documents are sent for all, so that other tasks' runs of the anchor
learn of them. So a passage in a third of all documents is a row or two for each batch. Marks
meet their texts in one join; maximal intervals are their union.

Defined cases: a null text has no words; a null id comes after all others; two rows
of one id aren't earlier than one another, each row is judged by its own text;
texts shorter than a window lose nothing; columns with the names of outputs are
replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.llm import rolling
from lodegraph.llm.common import append, discard, fresh, map_in_arrow, materialise, order_key, row_key, with_columns_schema

WINDOW, GRAM = 50, 16
#: state: ASK by anchor; KNOWN, an earlier document in the same map task has the same; DIFFER, its windows are counted. Rows that don't ask lie anywhere, not with their anchor.
ASK, KNOWN, DIFFER = 0, 1, 2
RUNS = "anchor long, state int, span long, ord long, rk long, s int, n int"
#: Runs of an anchor that a map task sends for others to see, if they differ.
FEW = 8
#: known: an earlier document in the same map task has the window; such rows lie anywhere, not with their hash.
HITS = "h1 long, h2 long, known boolean, ord long, rk long, pos array<int>"
#: Rows whose texts a map task holds at once.
BATCH = 2048


def _starts(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows that lie within one text: their first words, and the text's number."""
    counts = np.maximum(0, np.diff(first) - window + 1)
    doc = np.repeat(np.arange(len(counts)), counts)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][doc], doc


def _runs(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, anchor, hash of all words, first window and number of windows of every run."""
    words = rolling.Words(texts)
    at, doc = _starts(words.first, window)
    if not len(at):
        return (np.empty(0, np.int64),) * 5
    sums = rolling.prefix(words.hashes())
    anchor = rolling.sliding_min(rolling.windows(sums, gram), window - gram + 1)[at]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    n = np.diff(np.append(new, len(at)))
    begin = at[new]
    span = rolling.span(rolling.prefix(words.hashes(1), 1), begin, begin + n - 1 + window, 1)
    return doc[new], anchor[new].view(np.int64), span.view(np.int64), begin - words.first[doc[new]], n


def _least(keys: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """For each row the smallest id among the rows that have its keys."""
    order = np.lexsort([ids, *keys])
    new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)]) if len(order) else np.empty(0, bool)
    out = np.empty(len(ids), dtype=ids.dtype)
    out[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _states(anchor: np.ndarray, span: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What becomes of each run: KNOWN, DIFFER or ASK."""
    state = np.where(ids > _least([anchor, span], ids), KNOWN, ASK)
    left = np.flatnonzero(state == ASK)
    order = left[np.lexsort([ids[left], anchor[left]])]
    if not len(order):
        return state
    new = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
    size = np.diff(np.append(new, len(order)))
    # runs that are left have the same words only within one document, so a first and a last of different ids differ
    many = (size > FEW) & (ids[order[new]] != ids[order[new + size - 1]])
    inner = np.repeat(many, size)
    inner[new] = inner[new + size - 1] = False
    state[order[inner]] = DIFFER
    return state


def _send_runs(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                ids, keys, parts = part.column(0).to_numpy(), part.column(1).to_numpy(), []
                for begin, _, texts in rolling.chunks(part.column(2).to_pylist()):
                    doc, *rest = _runs(texts, window, gram)
                    parts.append((doc + begin, *rest))
                doc, anchor, span, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                state = _states(anchor, span, ids[doc])
                anchor = np.where(state == ASK, anchor, anchor ^ keys[doc])
                columns = [pa.array(anchor), pa.array(state, pa.int32()), pa.array(span), pa.array(ids[doc]), pa.array(keys[doc]), pa.array(s, pa.int32()), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "state", "span", "ord", "rk", "s", "n"])

    return run


def _send_windows(window: int):
    """Of (ord, rk, text, runs): the windows of the runs, each with its 128-bit hash, or s and n where it is settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                ids, keys, runs, parts = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(3).to_pylist(), []
                for begin, end, texts in rolling.chunks(part.column(2).to_pylist()):
                    words = rolling.Words(texts)
                    own = [(i - begin, r["s"], r["n"]) for i in range(begin, end) for r in runs[i]]
                    d, s, n = (np.array(x, dtype=np.int64) for x in zip(*own, strict=True))
                    place = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    doc = np.repeat(d, n)
                    at = words.first[doc] + place
                    h = [rolling.span(rolling.prefix(words.hashes(k), k), at, at + window, k).view(np.int64) for k in (0, 1)]
                    parts.append((doc + begin, place, *h))
                doc, place, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
                known = ids[doc] > _least([h1, h2], ids[doc])
                h1, h2 = np.where(known, keys[doc], h1), np.where(known, 0, h2)
                # the places of one window, and those of all known ones, in one row of the table are sent together
                o = np.lexsort([place, doc, h2, h1, known])
                doc, place, h1, h2, known = doc[o], place[o], h1[o], h2[o], known[o]
                new = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in (known, h1, h2, doc)], axis=0)]))
                pos = pa.ListArray.from_arrays(pa.array(np.append(new, len(doc)), pa.int32()), pa.array(place, pa.int32()))
                columns = [pa.array(h1[new]), pa.array(h2[new]), pa.array(known[new]), pa.array(ids[doc[new]]), pa.array(keys[doc[new]]), pos]
                yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "known", "ord", "rk", "pos"])

    return run


def marks(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rk, marks): in the row of key rk, for each (s, n) of marks n windows from s on, each of which an earlier document has too."""
    texts = docs.select(order_key(id_col).alias("ord"), row_key(id_col, text_col).alias("rk"), F.col(f"`{text_col}`").alias("text"))
    runs = texts.where("text is not null").mapInArrow(_send_runs(window, gram), RUNS)
    by_anchor = Window.partitionBy("anchor", "state")
    judged = runs.select("*", F.min("ord").over(by_anchor).alias("lo"), F.max("ord").over(by_anchor).alias("hi"), (F.min("span").over(by_anchor) == F.max("span").over(by_anchor)).alias("same"))
    known = F.col("state") == KNOWN
    found = materialise(judged.where(f"state <> {ASK} or lo < hi").select("rk", "s", "n", (known | (F.col("state") == ASK) & F.col("same")).alias("sure"), (known | (F.col("ord") > F.col("lo"))).alias("later")))
    whole = found.where("sure and later").select("rk", "s", "n")
    asked = found.where("not sure").groupBy("rk").agg(F.collect_list(F.struct("s", "n")).alias("runs"))
    hits = texts.join(asked.hint("shuffle_hash"), "rk").select("ord", "rk", "text", "runs").mapInArrow(_send_windows(window), HITS)
    later = hits.withColumn("lo", F.min("ord").over(Window.partitionBy("h1", "h2", "known"))).where("known or ord > lo")
    out = materialise(whole.unionByName(later.select("rk", F.explode("pos").alias("s"), F.lit(1).alias("n"))).groupBy("rk").agg(F.collect_list(F.struct("s", "n")).alias("marks")))
    discard(found)
    return out


def intervals(places: list[dict], window: int) -> list[list[int]]:
    """The maximal intervals of words, end exclusive, that the marked windows cover."""
    out: list[list[int]] = []
    for s, e in sorted((p["s"], p["s"] + p["n"] - 1 + window) for p in places):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed, removed (maximal intervals of words, end exclusive) and kept_text, the words left joined by one space."""
    outputs = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("removed", T.ArrayType(T.ArrayType(T.IntegerType()))), ("kept_text", T.StringType())]
    kept, schema = with_columns_schema(docs, [n for n, _ in outputs], outputs)
    own = fresh(kept)
    key, mark = f"{own}rk", f"{own}marks"
    found = marks(docs, window, gram, id_col, text_col).withColumnsRenamed({"rk": key, "marks": mark})
    keyed = kept.withColumn(key, row_key(id_col, text_col))
    joined = keyed.join(found.hint("shuffle_hash"), key, "left").select(*[F.col(f"`{c}`") for c in kept.columns], mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(a, 256)
                rows = []
                for text, places in zip(part.column(text_col).to_pylist(), part.column(mark).to_pylist(), strict=True):
                    words = text.encode().split() if text else []
                    gone = intervals(places or [], window)
                    left, at = [], 0
                    for s, e in gone:
                        left += words[at:s]
                        at = e
                    left += words[at:]
                    rows.append((len(words), len(words) - len(left), gone, b" ".join(left).decode()))
                values = list(zip(*rows, strict=True)) or [[]] * 4
                types = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.string()]
                yield append(part.drop_columns([mark]), {n: pa.array(v, t) for (n, _), v, t in zip(outputs, values, types, strict=True)})

    return map_in_arrow(joined, run, schema)
