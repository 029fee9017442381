"""SentencePiece encoding by a table of distinct marked words, and decoding by a table of pieces.

A text is marked: a space becomes the marker, and one marker goes before the text. Where no piece
has a marker after another character, no piece crosses from one marked word (markers, then
what follows up to the next marker) to the next, so a text's ids are its words' ids
side by side. A word is therefore segmented once and its ids are joined back to all places where it stands.

`word_table` counts the corpus's words in Spark and segments the most frequent ones, each once: as many
as a broadcast may hold by a bound on their number and bytes. A task joins these ids by position and makes the same
kind of table, of its own, of the distinct words outside it; texts are never shuffled. What the table
holds changes no result.

Decoding looks up each id's bytes and reads the whole as UTF-8; bytes that are none become U+FFFD one by one.

Defined cases: a null text encodes as an empty one; empty texts have no tokens; null ids decode as none; rows
stay as they are, repeated or not; a column that has the name of an output is replaced; an empty table gives an empty
table. An id outside the vocabulary is an error, as is a model whose pieces cross markers or that changes characters.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.llm.common import append, discard, frequent, map_in_arrow, materialise, with_columns_schema

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*")
#: Most words, and most bytes of words and ids, that the broadcast table holds.
HELD, HELD_BYTES = 200_000, 16_000_000
#: Words that a task counts, or keeps beyond the table, before it starts anew; rows at once; of longer texts, fewer.
OWN, ROWS = 400_000, 256


def marked_words(text: str) -> list[str]:
    return WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


class Pieces:
    """A vocabulary: ids of marked words, and texts of ids."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = p = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", x) for x in pieces):
            raise ValueError("pieces of this model cross markers")
        probe = " ﬁ  ａ "
        if p.decode(p.encode(probe)) != probe:
            raise ValueError("this model changes characters or white space")
        self.bare = np.array([p.piece_to_id(MARK)], np.int32).tobytes()
        self.bytes = [self._bytes(i, x) for i, x in enumerate(pieces)]
        self.silent = {i for i in range(len(pieces)) if p.is_control(i)}
        self.single = {i for i in range(len(pieces)) if p.is_byte(i)}

    def _bytes(self, i: int, piece: str) -> bytes:
        if self.library.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        if self.library.is_control(i):
            return b""
        return self.library.decode([i]).encode() if self.library.is_unknown(i) else piece.replace(MARK, " ").encode()

    def segmented(self, words: Iterable[str]) -> dict[str, bytes]:
        """Each word's ids as 32-bit integers. The library puts a marker before what it is given, so the word's first one is left out."""
        words = list(words)
        found = self.library.encode([w[1:] for w in words], num_threads=1)
        return {w: np.array(ids, np.int32).tobytes() if len(w) > 1 else self.bare for w, ids in zip(words, found, strict=True)}

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding put before it goes."""
        parts = list(map(self.bytes.__getitem__, ids))
        for k, i in enumerate(ids):  # the first id that says anything
            if i in self.single:
                break
            if parts[k].startswith(b" ") and not self.library.is_unknown(i):
                parts[k] = parts[k][1:]
                break
            if parts[k]:
                break
        if self.silent.isdisjoint(ids):
            return b"".join(parts).decode("utf-8", "lodegraph_each_byte")
        runs: list[list[bytes]] = [[]]  # bytes on two sides of a control id make no character
        for i, x in zip(ids, parts, strict=True):
            runs.append([]) if i in self.silent else runs[-1].append(x)
        return "".join(b"".join(r).decode("utf-8", "lodegraph_each_byte") for r in runs)


def _each_byte(e: UnicodeError):
    if not isinstance(e, UnicodeDecodeError):
        raise e
    return "�", e.start + 1


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    codecs.register_error("lodegraph_each_byte", _each_byte)
    return Pieces(model)


def counted_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n: the marked words that some task meets twice, with their number there. Words are counted in the task before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def sent() -> pa.RecordBatch:
            often = {w: n for w, n in counts.items() if n > 1}
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(often), pa.string()), pa.array(list(often.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(marked_words(text))
                if len(counts) > OWN:
                    yield sent()
        yield sent()

    own = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return own.groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, model: str, text_col: str = "text", held: int = HELD, held_bytes: int = HELD_BYTES) -> DataFrame:
    """word, ids: the most frequent words of docs, each segmented once; by powers of two of their number, as many classes as fit both bounds."""
    counted = materialise(counted_words(docs, text_col))
    least, _ = frequent(counted, "n", held, F.octet_length("word") * 5, held_bytes)  # an id for each byte at most, of four bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pieces(model).segmented(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.string()), pa.array(list(ids.values()), pa.binary())], names=["word", "ids"])

    table = materialise(counted.where(F.col("n") >= least).select("word").mapInArrow(run, "word string, ids binary"))
    discard(counted)
    return table


class _Joined:
    """A task's words and their ids: the broadcast table and the words that the task met outside it."""

    def __init__(self, table: dict[str, bytes], model: str):
        self.table, self.pieces, self.known = table, pieces(model), dict(table)

    def ids(self, texts: list[str | None]) -> pa.Array:
        words = [marked_words(t) if t else [] for t in texts]
        if len(self.known) > len(self.table) + OWN:
            self.known = dict(self.table)
        new = set(chain.from_iterable(words)).difference(self.known)
        self.known.update(self.pieces.segmented(new))
        rows = [b"".join(map(self.known.__getitem__, w)) for w in words]
        ends = np.cumsum([0, *[len(r) // 4 for r in rows]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", back_col: str | None = None, drop_text: bool = False, table: DataFrame | None = None) -> DataFrame:
    """docs with ids_col: array of int, the ids of every whole text; with back_col also the text that they decode to.

    model: the path of a SentencePiece model, which every executor must have. table: what `word_table` returned; if it isn't given, it is made of docs.
    """
    own = table if table is not None else word_table(docs, model, text_col)
    held = {r["word"]: bytes(r["ids"]) for r in own.toLocalIterator()}  # HELD words and HELD_BYTES bytes at most
    if table is None:
        discard(own)
    sent = docs.sparkSession.sparkContext.broadcast(held)
    added = [(ids_col, T.ArrayType(T.IntegerType())), *([(back_col, T.StringType())] if back_col else [])]
    kept, schema = with_columns_schema(docs, [n for n, _ in added], added)
    if drop_text:
        schema = T.StructType([f for f in schema.fields if f.name != text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = _Joined(sent.value, model)
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), ROWS):
                part = batch.slice(a, ROWS)
                new = {ids_col: joined.ids(part.column(text_col).cast(pa.string()).to_pylist())}
                if back_col:
                    new[back_col] = _decoded(new[ids_col], model)
                yield append(part.drop_columns([text_col]) if drop_text else part, new)

    return map_in_arrow(kept, run, schema)


def _lists(ids: pa.Array) -> list[list[int] | None]:
    """ids as lists, by NumPy where nothing is null: an Arrow array makes an object of its own of each id first."""
    if ids.null_count or ids.values.null_count:
        return ids.to_pylist()
    values, ends = ids.values.to_numpy(), ids.offsets.to_pylist()
    return [values[a:b].tolist() for a, b in zip(ends, ends[1:])]


def _decoded(ids: pa.Array, model: str) -> pa.Array:
    return pa.array([pieces(model).decode(x) if x else "" for x in _lists(ids)], pa.string())


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text", drop_ids: bool = False) -> DataFrame:
    """encoded with text_col: the text of the ids."""
    kept, schema = with_columns_schema(encoded, [text_col], [(text_col, T.StringType())])
    if drop_ids:
        schema = T.StructType([f for f in schema.fields if f.name != ids_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), ROWS):
                part = batch.slice(a, ROWS)
                yield append(part.drop_columns([ids_col]) if drop_ids else part, {text_col: _decoded(part.column(ids_col), model)})

    return map_in_arrow(kept, run, schema)
