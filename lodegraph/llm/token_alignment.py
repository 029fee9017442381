"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and how often which ids do.

A is a byte-level vocabulary of the tokenizers library, B a SentencePiece model; both encode a space and the text. Neither has a token that
goes on over a space after a solid character (one that is surely neither white space nor invisible): A's pattern starts anew there, B has no piece with a marker inside.
So a text is cut there into words, and a task aligns each distinct word of its texts once. For new words it makes
two tables of token intervals, which DuckDB joins: a token is the last of its group if a token of the other side ends with
it, a window sum over those ends numbers the groups, an ASOF join finds each group's word. Within a group the two sides' ends differ, so of its tokens one pair less
overlaps than there are tokens. Texts are then put together from their words.

The task also sums how often it linked each pair of ids, and these partial counts merge in Spark. Texts and partial counts are written once;
the links of the texts then meet the whole counts: the most frequent pairs, up to HELD of them, by a broadcast, all others by a shuffle.

Defined cases: a text that is null or empty, or that a vocabulary doesn't give back byte for byte (one with the marker U+2581), has no tokens: zeros, and empty
groups. Strings of special tokens are plain text. Repeated rows are aligned each and count each. A column that has the name of an output is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.llm.common import append, discard, frequent, map_in_arrow, materialise, with_columns_schema
from lodegraph.llm.sentence_pieces import MARK

#: What isn't solid: white space, controls, and characters that a class of white space may hold in one library and not in another.
SOFT = r"\s\x00-\x20\x7f-\xa0\xad ᠎ -‏ -  -⁯　﻿"
WORDS = re.compile(rf" [^ ]*(?:(?<=[{SOFT}]) [^ ]*)*")
ENDS_SOFT = re.compile(rf"[{SOFT}]\Z")
#: Characters of new words that are aligned at once, of a string that the libraries get, and words that a task keeps before it starts anew.
LOT, STRING, KEPT = 1_000_000, 50_000, 400_000
ROWS = 256
#: Pairs of ids that are sent to all tasks.
HELD = 1_000_000
#: MB that DuckDB may take in a task; it writes nothing to disk.
MEMORY = 600

ALIGN = """
WITH t AS (
  SELECT 0 AS side, id, s, e, e IN (SELECT e FROM b) AS last FROM a
  UNION ALL SELECT 1, id, s, e, e IN (SELECT e FROM a) FROM b),
g AS (SELECT *, coalesce(sum(last::INT) OVER (PARTITION BY side ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM t)
SELECT g.side, g.id, g.last, w.w FROM g ASOF JOIN w ON g.s >= w.s ORDER BY g.g, g.side, g.e"""


@lru_cache(maxsize=1)
def _unbyte() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on in their order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class Aligner:
    """Words and what is known of them: numbers of tokens, groups, overlaps, the groups as a string, the links as pairs of ids in one long each."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import duckdb
        import sentencepiece
        import tokenizers

        self.a, self.b = tokenizers.Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces of this model cross markers")
        back = _unbyte()
        self.a_bytes = [bytes(back[c] for c in t) if t is not None and all(c in back for c in t) else None for t in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x or b"") for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.bare = self.b.piece_to_id(MARK)
        # a token's text by (last of its group, side): what follows it is a comma, a bar or a semicolon
        size = self.size = max(len(self.a_bytes), len(self.b_bytes))
        self.shown = [f"{i}{after}" for after in (",", ",", "|", ";") for i in range(size)]
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": ""})
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.counts: list[tuple[int, int, int, int]] = []
        self.groups: list[str] = []
        self.links: list[bytes] = []

    def _tokens(self, strings: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for strings that begin with a space; no ids where one of them doesn't give the string back."""
        a = [e.ids for e in self.a.encode_batch(strings, add_special_tokens=False)]
        b = [ids if len(s) > 1 else [self.bare] for s, ids in zip(strings, self.b.encode([s[1:] for s in strings], num_threads=1), strict=True)]
        for k, s in enumerate(strings):
            want = s.encode()
            if b"".join([self.a_bytes[i] or b"" for i in a[k]]) != want or b"".join(map(self.b_bytes.__getitem__, b[k])) != want:
                a[k] = b[k] = []
        return [np.array(x, np.int64) for x in a], [np.array(x, np.int64) for x in b]

    def learn(self, words: list[str]) -> None:
        """Align words that are new. Those that end in a solid character go to the libraries side by side, the others each for itself."""
        solid, soft, strings, owners = [], [], [], []
        for w in words:
            (soft if ENDS_SOFT.search(w) else solid).append(w)
        run: list[str] = []
        size = 0
        for w in solid:
            if size + len(w) > STRING and run:
                strings.append("".join(run))
                owners.append(run)
                run, size = [], 0
            run.append(w)
            size += len(w)
        for own in [run] * bool(run) + [[w] for w in soft]:
            strings.append("".join(own))
            owners.append(own)
        a, b = self._tokens(strings)
        bad = [k for k, x in enumerate(a) if not len(x)]
        if bad:  # a string that has no ids: its words each for itself, and those that have none again are known to have none
            alone = [w for k in bad for w in owners[k]]
            for k in bad:
                owners[k] = []
            more = self._tokens(alone)
            for w, x, y in zip(alone, *more, strict=True):
                if len(x):
                    owners.append([w]), a.append(x), b.append(y)
                else:
                    self._add(w, (0, 0, 0, 0), "", b"")
        names = list(chain.from_iterable(owners))
        if names:
            self._join(names, np.concatenate(a), np.concatenate(b))

    def _join(self, names: list[str], a: np.ndarray, b: np.ndarray) -> None:
        def intervals(ids: np.ndarray, lengths: np.ndarray) -> pa.Table:
            ends = np.cumsum(lengths[ids])
            return pa.table({"id": ids, "s": ends - lengths[ids], "e": ends})

        starts = np.cumsum([0, *[len(w.encode()) for w in names[:-1]]])
        for name, table in (("a", intervals(a, self.a_len)), ("b", intervals(b, self.b_len)), ("w", pa.table({"w": np.arange(len(names)), "s": starts}))):
            self.duck.register(name, table)
        t = self.duck.execute(ALIGN).fetchnumpy()
        side, ids, last, w = (np.asarray(t[c]) for c in ("side", "id", "last", "w"))
        side = side.astype(np.int64)
        n_b, n_all, n_groups = (np.bincount(w, weights=x, minlength=len(names)).astype(np.int64) for x in (side, np.ones(len(w)), last & (side == 1)))
        texts = list(map(self.shown.__getitem__, ((2 * last + side) * self.size + ids).tolist()))
        ends = ids[last].reshape(-1, 2)  # the last ids of a group, A's and B's
        links = ((ends[:, 0] << 32) | ends[:, 1]).astype("<i8")
        at, first = np.cumsum([0, *n_all]).tolist(), np.cumsum([0, *n_groups]).tolist()
        for k, name in enumerate(names):
            self._add(name, (int(n_all[k] - n_b[k]), int(n_b[k]), int(n_groups[k]), int(n_all[k] - n_groups[k])), "".join(texts[at[k] : at[k + 1]]), links[first[k] : first[k + 1]].tobytes())

    def _add(self, word: str, counts: tuple[int, int, int, int], groups: str, links: bytes) -> None:
        self.number[word] = len(self.counts)
        self.counts.append(counts)
        self.groups.append(groups)
        self.links.append(links)

    def texts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str, bytes, list[int]]]:
        """Of each text its counts (tokens of A and B, groups, overlaps), groups, links and words' numbers, which hold until this is called again."""
        if len(self.number) > KEPT:
            self.clear()
        cut = [WORDS.findall(" " + t) if t else [] for t in texts]
        new, size = [], 0
        for w in set(chain.from_iterable(cut)).difference(self.number):
            new.append(w)
            size += len(w)
            if size > LOT:
                self.learn(new)
                new, size = [], 0
        if new:
            self.learn(new)
        for words in cut:
            at = list(map(self.number.__getitem__, words))
            counts = np.array([self.counts[i] for i in at], np.int64).reshape(-1, 4)
            if not len(at) or not counts[:, 0].all():  # a word without tokens: the whole text has none
                yield np.zeros(4, np.int64), "", b"", []
            else:
                yield counts.sum(0), "".join(map(self.groups.__getitem__, at))[:-1], b"".join(map(self.links.__getitem__, at)), at


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, max(1, batch.num_rows), ROWS):
            yield batch.slice(a, ROWS)


def groups(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", groups_col: str = "groups") -> DataFrame:
    """docs with groups_col: the groups of ids as a string `a1,a2|b1;a3|b2,b3`, A's and B's in order. Both paths must be there on every executor."""
    kept, schema = with_columns_schema(docs, [groups_col], [(groups_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slabs(batches):
            found = aligner(a_path, b_path).texts(part.column(text_col).cast(pa.string()).to_pylist())
            yield append(part, {groups_col: pa.array([g for _, g, *_ in found], pa.string())})

    return map_in_arrow(kept, run, schema)


#: kind 0: a text with its counts and links; kind 1: how often a task linked a pair of ids.
FOUND = "kind int, row long, id long, n_a long, n_b long, n_groups long, n_overlaps long, groups_sha256 string, links array<long>, pair long, n long"


def found(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FOUND: the texts, and each task's partial counts of linked pairs. A pair is A's id times 2**32 plus B's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_overlaps", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.list_(pa.int64())), ("pair", pa.int64()), ("n", pa.int64())])

        def batch_of(rows: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

        own = aligner(a_path, b_path)
        row = TaskContext.get().partitionId() << 40

        def pairs() -> pa.RecordBatch:
            """The counts so far: every word's links as often as the word was met, summed by DuckDB."""
            times = np.array([met.get(i, 0) for i in range(len(own.links))], np.int64)
            per = np.array([len(x) // 8 for x in own.links], np.int64)
            own.duck.register("met", pa.table({"pair": np.frombuffer(b"".join(own.links), "<i8"), "n": np.repeat(times, per)}))
            t = own.duck.execute("SELECT pair, sum(n)::BIGINT AS n FROM met WHERE n > 0 GROUP BY 1").fetchnumpy()
            met.clear()
            n = len(t["pair"])
            return batch_of(n, kind=pa.array(np.ones(n, np.int32)), pair=pa.array(np.asarray(t["pair"])), n=pa.array(np.asarray(t["n"])))

        met: dict[int, int] = {}
        for part in _slabs(batches):
            if len(own.number) > KEPT:  # the words are about to go
                yield pairs()
            counts, hashes, links = [], [], []
            for c, g, pair, at in own.texts(part.column(1).to_pylist()):
                counts.append(c)
                hashes.append(sha256(g.encode()).hexdigest() if g else "")
                links.append(pair)
                for i in at:
                    met[i] = met.get(i, 0) + 1
            n = part.num_rows
            table = np.array(counts, np.int64).reshape(-1, 4)
            ends = np.cumsum([0, *[len(x) // 8 for x in links]]).astype(np.int32)
            yield batch_of(
                n,
                kind=pa.array(np.zeros(n, np.int32)),
                row=pa.array(np.arange(row, row + n)),
                id=part.column(0),
                groups_sha256=pa.array(hashes, pa.string()),
                links=pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(links), "<i8"))),
                **{c: pa.array(table[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_overlaps"))},
            )
            row += n
        yield pairs()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, FOUND)


def pair_counts(parts: DataFrame) -> DataFrame:
    """pair, n, best: how many links of the corpus hold the pair, and whether no other pair of its B id has more. parts: what `found` returned."""
    merged = parts.where("kind = 1").groupBy("pair").agg(F.sum("n").alias("n"))
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    counted = materialise(merged.withColumn("b", b_id.cast("int")))
    most = counted.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B at most
    out = materialise(counted.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    discard(counted)
    return out


def _summed(links: DataFrame) -> DataFrame:
    best: Column = F.col("best").cast("long")
    return links.groupBy("row").agg(F.sum(best).alias("n_best"), F.sum("n").alias("count_sum"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups_sha256: a row for each row of docs.

    n_overlaps counts the pairs of tokens that share bytes. n_best and count_sum are of the links' counts in all docs.
    """
    parts = materialise(found(docs, a_path, b_path, id_col, text_col))
    counts = pair_counts(parts)
    least, all_held = frequent(counts, "n", held)
    texts = parts.where("kind = 0")
    links = texts.select("row", F.explode("links").alias("pair"))
    hot = F.broadcast(counts.where(F.col("n") >= least))  # held rows at most
    if all_held:
        sums = _summed(links.join(hot, "pair"))
    else:
        rest = links.join(hot, "pair", "left_anti").join(counts.where(F.col("n") < least), "pair")
        sums = _summed(links.join(hot, "pair").unionByName(rest))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return texts.join(sums, "row", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_overlaps", *zero, "groups_sha256")
