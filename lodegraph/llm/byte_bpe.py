"""Byte-level BPE as a lazily determinised transducer, and streaming decode by a UTF-8 state machine.

Encoding. A text is cut into pieces by the vocabulary's pattern. Within a piece a
sequence of tokens is the BPE encoding exactly if every two neighbours are: the
pair of them, merged from bytes, gives the same two tokens again. So the encoding
of every prefix of a piece has one last token, which begins where a token can begin
that the bytes so far don't end: the live places. The merges thus make a nondeterministic machine
that guesses where tokens begin. `Transducer` determinises it: a state stands for all live
places at once and the tokens that lead to them, named by the last token emitted and the bytes
since. Reading a byte leads to the next state and emits the tokens on which all live places
agree, so a token waits for the few bytes that can still change it, no longer than tokens are.
Transitions (state, byte) -> (state, ids) are built when first met and kept in a table of
bounded size; a full table is emptied, which costs time and changes no result.

Decoding. `Utf8Machine` steps over whole tokens by a table (state, token) -> state
which is filled when first used; bytes of a code point that is still open wait for
the next token.

Defined cases: a null text encodes as an empty one; empty texts have no tokens;
rows stay as they are, repeated or not; a column that has the name of an output
is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodegraph.llm.common import append, map_in_arrow, with_columns_schema

#: Transitions and pairs of tokens that are kept; beyond it the tables start anew.
MOVES, FITS = 800_000, 200_000
#: In place of a byte: the piece ends.
END = 256
#: Bytes of pieces that step together; a longer piece than LONG steps alone.
PASS, LONG = 1 << 16, 256
#: Rows that are turned into Python objects at once; of a text of over WHOLE characters, SLAB pieces; ids that are decoded at once.
ROWS, WHOLE, SLAB, CHUNK = 256, 100_000, 20_000, 4096
#: An odd multiplier that spreads keys over the table.
SPREAD = 0x9E3779B97F4A7C15


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class State(NamedTuple):
    """`prev` is the token emitted last, `open` the bytes since. Of `open`'s k first bytes the last token begins at
    last[k - 1]; live are the places from which the rest of `open` begins a token."""

    prev: bytes | None
    open: bytes
    last: tuple[int, ...]
    live: tuple[int, ...]

    def tokens(self, end: int) -> list[bytes]:
        """Of the first `end` open bytes."""
        out = []
        while end:
            begin = self.last[end - 1]
            out.append(self.open[begin:end])
            end = begin
        return out[::-1]


class Transducer:
    """Reads pieces' bytes and emits their tokens. State 0 begins a piece, END leads back to it.

    The table is an open-addressing hash table in arrays: `key` holds state * 257 + byte, `to` the next
    state, `at` and `n` the place and number of the emitted ids in `flat`. Many pieces step together, a byte each.
    """

    def __init__(self, ranks: dict[bytes, int], max_moves: int = MOVES, max_fits: int = FITS):
        self.ranks, self.max_moves, self.max_fits = ranks, max_moves, max_fits
        #: 1: a token, 2: what begins a longer one, 3: both.
        self.kinds = dict.fromkeys({t[:k] for t in ranks for k in range(1, len(t))}, 2)
        self.kinds |= {t: self.kinds.get(t, 0) | 1 for t in ranks}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        # half empty at most: a pass begins with max_moves or fewer and adds no more than its bytes and ends
        self.bits = (2 * (max_moves + 2 * (PASS + LONG))).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.key, self.to, self.at, self.n = np.full(1 << self.bits, -1, np.int64), *np.zeros((3, 1 << self.bits), np.int32)
        self.flat, self.written, self.held = np.zeros(1 << 16, np.uint32), 0, 0
        self.states, self.numbers = [State(None, b"", (), ())], {(None, b"", ()): 0}

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge gives token; None for a byte. What the merges of lower rank leave of it."""
        found = self.halves.get(token, False)
        if found is False:
            rank, parts = self.ranks[token], [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                ranked = [self.ranks.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
                best = ranked.index(low := min(ranked))
                if low >= rank:
                    raise ValueError(f"token {rank} isn't the merge of two others")
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            found = self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return found

    def _fit(self, a: bytes | None, b: bytes) -> bool:
        """Whether no merge joins bytes over the border of a and b.

        Undone from the last merge to the first, a's right part and b's left part
        stand at the border for a while each; a merge over the border would have
        to come before the merge that ended that while.
        """
        if a is None:
            return True
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) >= self.max_fits:
                self.fits.clear()
            found = self.fits[a, b] = self._undone(a, b)
        return found

    def _undone(self, x: bytes, y: bytes) -> bool:
        ranks, before = self.ranks, 1 << 60
        while True:
            # a merge at the border wins against one of the same rank only if it stands further left
            if ranks.get(x + y, before) < before:
                return False
            left, right = self._halves(x), self._halves(y)
            if left is None and right is None:
                return True
            if right is None or left is not None and ranks[x] > ranks[y]:
                before, x = ranks[x], left[1]
            else:
                before, y = ranks[y] + 1, right[0]

    def _number(self, state: State) -> int:
        # the tokens that lead to a live place are the encoding of the bytes before it; prev matters only to a token that begins right after it
        name = (state.prev if 0 in state.live or not state.open else None, state.open, state.live)
        number = self.numbers.setdefault(name, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def _move(self, state: State, byte: int) -> tuple[State, list[bytes]]:
        """Where a byte leads, and the tokens that are final with it."""
        s, n = state.open + bytes((byte,)), len(state.open) + 1
        begin, live = -1, []
        for i in (*state.live, n - 1):
            rest = s[i:]
            kind = self.kinds.get(rest, 0)
            if kind & 1 and begin < 0 and self._fit(s[state.last[i - 1] : i] if i else state.prev, rest):
                begin = i
            if kind & 2:
                live.append(i)
        if begin < 0:
            raise ValueError(f"{s!r} has no tokens: the vocabulary lacks single bytes")
        to = State(state.prev, s, (*state.last, begin), tuple(live))
        # tokens before the place where the ways to all live places part are final
        places = [*live, n]
        while len(places) > 1:
            before = to.last[places.pop() - 1]
            if before not in places:
                insort(places, before)
        done = places[0]
        if not done:
            return to, []
        out = to.tokens(done)
        return State(out[-1], s[done:], tuple([k - done for k in to.last[done:]]), tuple([k - done for k in live])), out

    def _build(self, key: int) -> int:
        """Fills the table's slot for a key that it doesn't hold."""
        number, byte = divmod(key, 257)
        state = self.states[number]
        to, out = (self.states[0], state.tokens(len(state.open))) if byte == END else self._move(state, byte)
        if self.written + len(out) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(out)), np.uint32)])
        self.flat[self.written : self.written + len(out)] = [self.ranks[t] for t in out]
        slot = self._home(key)
        while self.key[slot] != -1:
            slot = (slot + 1) & (len(self.key) - 1)
        self.key[slot], self.to[slot], self.at[slot], self.n[slot] = key, self._number(to), self.written, len(out)
        self.written += len(out)
        self.held += 1
        return slot

    def _home(self, key: int) -> int:
        return (key * SPREAD & (1 << 64) - 1) >> 64 - self.bits

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slots of the keys, built where they are missing."""
        slot = (keys.view(np.uint64) * np.uint64(SPREAD) >> np.uint64(64 - self.bits)).view(np.int64)
        left = np.flatnonzero(self.key[slot] != keys)
        while len(left):
            at, wanted = slot[left], keys[left]
            if len(missing := wanted[self.key[at] == -1]):
                for key in np.unique(missing).tolist():
                    self._build(key)
            left = left[self.key[at] != wanted]
            slot[left] = slot[left] + 1 & len(self.key) - 1
        return slot

    def _together(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pieces one after another, and how many each has."""
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        state, who, said = np.zeros(len(order), np.int64), [], []
        for k in range(length[0]):
            m = np.searchsorted(-length, -k)
            slot = self._slots(state[:m] * 257 + data[begin[:m] + k])
            state[:m] = self.to[slot]
            speaks = np.flatnonzero(self.n[slot])
            who.append(order[speaks])
            said.append(slot[speaks])
        who, said = np.concatenate([*who, order]), np.concatenate([*said, self._slots(state * 257 + END)])
        counts = np.bincount(who, self.n[said], len(order)).astype(np.int64)
        said = said[np.argsort(who, kind="stable")]
        n = self.n[said].astype(np.int64)
        return self.flat[np.repeat(self.at[said] - np.cumsum(n) + n, n) + np.arange(n.sum())], counts

    def _alone(self, data: bytes) -> np.ndarray:
        """The ids of one long piece."""
        number, out = 0, []
        for byte in (*data, END):
            if self.held > self.max_moves:
                state = self.states[number]
                self._clear()
                number = self._number(state)
            key, slot = number * 257 + byte, self._home(number * 257 + byte)
            while self.key[slot] != key:
                slot = self._build(key) if self.key[slot] == -1 else (slot + 1) & (len(self.key) - 1)
            number = int(self.to[slot])
            if n := self.n[slot]:
                out.append(self.flat[self.at[slot] : self.at[slot] + n])
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def run(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, none empty, one after another, and how many each has."""
        if not pieces:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        data = np.frombuffer("".join(pieces).encode(), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
        if bounds[-1] < len(data):  # from code points to bytes
            bounds = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[bounds]
        length = np.diff(bounds)
        long = np.flatnonzero(length > LONG)
        edges = np.unique(np.concatenate([[0, len(pieces)], np.searchsorted(bounds, np.arange(PASS, len(data), PASS)), long, long + 1]))
        ids, counts = [], []
        for a, z in pairwise(edges.tolist()):
            if self.held > self.max_moves:
                self._clear()
            if length[a] > LONG:
                ids.append(self._alone(data[bounds[a] : bounds[z]].tobytes()))
                counts.append([len(ids[-1])])
            else:
                found = self._together(data, bounds[a:z], length[a:z])
                ids.append(found[0])
                counts.append(found[1])
        return np.concatenate(ids), np.concatenate(counts)

    def encoded(self, texts: list[str], cut) -> list[np.ndarray]:
        """The ids of each text, which `cut`, a compiled pattern, cuts into pieces. A long text's pieces are cut SLAB at a time."""
        out: list[np.ndarray] = []
        some: list[list[str]] = []

        def flush() -> None:
            ids, counts = self.run(list(chain.from_iterable(some)))
            ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, some)])]
            out.extend(ids[a:z] for a, z in pairwise(ends.tolist()))
            some.clear()

        for text in texts:
            if len(text) <= WHOLE:
                some.append(cut.findall(text))
                continue
            flush()
            found = (m[0] for m in cut.finditer(text))
            parts = []
            while slab := list(islice(found, SLAB)):
                parts.append(self.run(slab)[0])
            out.append(np.concatenate(parts) if parts else np.empty(0, np.uint32))
        flush()
        return out


def utf8_next(state: int, byte: int) -> int:
    """0: between code points; 1, 2, 3: as many bytes to come; 4 to 7: after E0, ED, F0, F4, whose next byte has a smaller range; 8: not UTF-8."""
    if state == 0:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte < 0xE0:
            return 1
        if 0xE0 <= byte < 0xF0:
            return 4 if byte == 0xE0 else 5 if byte == 0xED else 2
        if 0xF0 <= byte < 0xF5:
            return 6 if byte == 0xF0 else 7 if byte == 0xF4 else 3
        return 8
    low, high = {4: (0xA0, 0xBF), 5: (0x80, 0x9F), 6: (0x90, 0xBF), 7: (0x80, 0x8F)}.get(state, (0x80, 0xBF))
    if not low <= byte <= high:
        return 8
    return {1: 0, 2: 1, 3: 2, 4: 1, 5: 1, 6: 2, 7: 2}[state]


class Utf8Machine:
    """Turns ids into text as they come. `feed` returns the text that is complete; `finish` what an open code point leaves: a replacement character."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.ends = np.cumsum([0, *map(len, self.tokens)])
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        #: steps[state][token]: the state after the token if it began in state; -1 where not yet asked for.
        self.steps = np.full((9, len(self.tokens)), -1, np.int8)
        self.clear()

    def clear(self) -> None:
        self.state, self.waiting = 0, b""

    @staticmethod
    def _run(state: int, data: bytes) -> int:
        for byte in data:
            state = utf8_next(state, byte)
            if state == 8:
                return 8
        return state

    def _after(self, ids: np.ndarray) -> np.ndarray:
        """The state after each token if it began in state 0."""
        found = self.steps[0][ids]
        if found.min() < 0:
            for i in np.unique(ids[found < 0]).tolist():
                self.steps[0][i] = self._run(0, self.tokens[i])
            found = self.steps[0][ids]
        return found

    def feed(self, ids: np.ndarray) -> str:
        # in state 0, tokens of whole code points lead to state 0: only from one that doesn't on are steps taken one by one
        leaving, state, k, done = np.flatnonzero(self._after(ids)).tolist(), self.state, 0, 0
        while True:
            if not state:
                later = bisect_left(leaving, k)
                done = k = leaving[later] if later < len(leaving) else len(ids)
            if k == len(ids):
                break
            i = int(ids[k])
            to = self.steps[state][i]
            if to < 0:
                to = self.steps[state][i] = self._run(state, self.tokens[i])
            if to == 8:
                return self._repair(ids)
            state, k = int(to), k + 1
        self.state = state
        if state and not done:
            self.waiting += self._bytes(ids)
            return ""
        out = self.waiting + self._bytes(ids[:done])
        self.waiting = self._bytes(ids[done:])
        return out.decode()

    def _bytes(self, ids: np.ndarray) -> bytes:
        begin = self.ends[ids]
        n = self.ends[ids + 1] - begin
        return self.flat[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()

    def _repair(self, ids: np.ndarray) -> str:
        """Bytes that aren't UTF-8: each longest beginning of a code point that fails becomes one U+FFFD."""
        data, out, state, begun = self.waiting + self._bytes(ids), [], 0, 0
        for k, byte in enumerate(data):
            to = utf8_next(state, byte)
            if to == 8:
                out.append("�")
                begun = k
                to = utf8_next(0, byte) if state else 8
                if to == 8:
                    if state:
                        out.append("�")
                    to, begun = 0, k + 1
            if to == 0 and begun <= k:
                out.append(data[begun : k + 1].decode("utf-8"))
                begun = k + 1
            state = to
        self.state, self.waiting = state, data[begun:]
        return "".join(out)

    def finish(self) -> str:
        left = "�" if self.waiting else ""
        self.clear()
        return left

    def decode(self, ids: np.ndarray) -> str:
        """All of one text, CHUNK ids at once."""
        self.clear()
        out = [self.feed(ids[a : a + CHUNK]) for a in range(0, len(ids), CHUNK)]
        return "".join(out) + self.finish()


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(read_ranks(path))


@lru_cache(maxsize=2)
def machine(path: str) -> Utf8Machine:
    return Utf8Machine({i: t for t, i in read_ranks(path).items()})


def _encoded(texts: pa.Array, vocabulary: str, pattern: str) -> pa.Array:
    import regex

    ids = transducer(vocabulary).encoded([x or "" for x in texts.to_pylist()], regex.compile(pattern))
    return pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())


def _decoded(ids: pa.Array, vocabulary: str) -> pa.Array:
    m = machine(vocabulary)
    return pa.array([m.decode(np.frombuffer(x, dtype="<u4")) if x else "" for x in ids.to_pylist()], pa.string())


def _mapped(df: DataFrame, columns: list[tuple[str, T.DataType]], gone: str | None, make) -> DataFrame:
    """df with the columns that make(batch) gives, a few rows at a time, and without the column `gone`."""
    kept, schema = with_columns_schema(df, [n for n, _ in columns], columns)
    if gone:
        schema = T.StructType([f for f in schema.fields if f.name != gone])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), ROWS):
                part = batch.slice(a, ROWS)
                yield append(part.drop_columns([gone]) if gone else part, make(part))

    return map_in_arrow(kept, run, schema)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "ids", drop_text: bool = False) -> DataFrame:
    """docs with ids_col: binary, the token ids as little-endian unsigned 32-bit integers.

    vocabulary: the path of a rank file, which every executor must have. pattern: what cuts a text into pieces; without groups.
    """
    return _mapped(docs, [(ids_col, T.BinaryType())], text_col if drop_text else None, lambda part: {ids_col: _encoded(part.column(text_col), vocabulary, pattern)})


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "text", drop_ids: bool = False) -> DataFrame:
    """encoded with text_col: the text of the ids. Null ids are as none; an id outside the vocabulary is an error."""
    return _mapped(encoded, [(text_col, T.StringType())], ids_col if drop_ids else None, lambda part: {text_col: _decoded(part.column(ids_col), vocabulary)})


def encode_and_decode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "ids", back_col: str = "decoded") -> DataFrame:
    """docs without text_col, with ids_col as `encode` gives it and back_col as `decode` does of it, in one pass."""

    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        ids = _encoded(part.column(text_col), vocabulary, pattern)
        return {ids_col: ids, back_col: _decoded(ids, vocabulary)}

    return _mapped(docs, [(ids_col, T.BinaryType()), (back_col, T.StringType())], text_col, make)
